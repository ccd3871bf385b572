"""Checked equi-joins, nearest and tiered choices, cascades and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import permit_key, permit_letters

#: Rows and bytes up to which one side of a join may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small(frame: DataFrame) -> DataFrame:
    """The frame, marked for a broadcast where a count of its rows and of their bytes shows that it is small."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in frame.schema.fields if f.dataType.typeName() in ("string", "binary")]
    sizes += [F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in frame.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    each = sum(sizes, F.lit(16 * len(frame.columns)))
    found = frame.limit(BROADCAST_ROWS + 1).select(each.cast("long").alias("bytes")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(frame) if found["rows"] <= BROADCAST_ROWS and found["bytes"] <= BROADCAST_BYTES else frame


def duplicate_keys(frame: DataFrame, *keys: str) -> int:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").count()


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """An equi-join that raises where a side that must be unique has duplicate keys; null keys match nothing."""
    one_left, one_right = validate.startswith("one_"), validate.endswith("_one")
    for side, frame, needed in (("left", left, one_left), ("right", right, one_right)):
        if needed and (n := duplicate_keys(frame, *on)):
            raise ValueError(f"{n} duplicate keys on the {side} side of a {validate} join on {', '.join(on)}")
    return left.join(right, on, how)


def preserving_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows keep their number: a many-to-one join whose count is proved."""
    out = checked_join(left, right, on)
    if (a := left.count()) != (b := out.count()):
        raise ValueError(f"{a} rows became {b}")
    return out


def indicated_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join with `matched`."""
    return left.join(right.withColumn("__hit", F.lit(True)), on, "left").withColumn("matched", F.col("__hit").isNotNull()).drop("__hit")


def masked_join(left: DataFrame, right: DataFrame, on: list[str], accepted: Column) -> DataFrame:
    """A left join whose right columns are null unless the left row is accepted."""
    extra = [c for c in right.columns if c not in on]
    out = left.withColumn("__ok", accepted).join(right, on, "left")
    return out.select(*left.columns, *(F.when(F.col("__ok"), F.col(c)).alias(c) for c in extra))


def mapped(frame: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, fill=None) -> DataFrame:
    """frame with the value that a lookup, unique by its key, holds for each row's key, aligned by key and never by position; `fill` where it holds none."""
    own = lookup.select(F.col(lookup_key).alias("__key"), F.col(value).alias("__value"))
    if n := duplicate_keys(own, "__key"):
        raise ValueError(f"{n} keys stand more than once in the lookup")
    out = frame.join(own, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumn(value, F.col("__value") if fill is None else F.coalesce("__value", F.lit(fill))).drop("__value")


def stable_order(frame: DataFrame, by: list[str], order: list[str], then: list[str]) -> DataFrame:
    """`place`, the number of each row within its group by `order`; rows that tie stand by `then`, which names the input's own order, so the result doesn't depend on how rows arrive."""
    return frame.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order, *then)))


#: Parts that a global order is cut into.
PARTS = 64


def numbered(frame: DataFrame, lead: Column, order: list[Column | str], name: str) -> DataFrame:
    """`name`: each row's number, from 1, in the order of lead, a number, and then `order`; nulls of lead stand last.

    The order is cut at approximate quantiles of lead; each part is numbered by itself and moved on by the rows of the
    parts before it, so no task sorts the whole table unless all of it ties.
    """
    from pyspark.sql.types import LongType

    cuts = frame.agg(F.percentile_approx(lead, [k / PARTS for k in range(1, PARTS)], 1000)).first()[0] or []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + F.when(lead > c, 1).otherwise(0)
    own = frame.withColumn("__part", F.when(lead.isNull(), PARTS).otherwise(part))
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row a part
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.asc_nulls_last(lead), *order))
    return own.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, (F.col("__place") + F.col("__before")).cast(LongType())).drop("__part", "__place", "__before")


def nearest(sensors: DataFrame, works: DataFrame, by: str, limit: float) -> DataFrame:
    """Each sensor's nearest works of its own group, the first by key on ties, dropped beyond the limit after ranking.

    sensors: (sensor, by, x, y); works: (works, by, works_x, works_y). Works are entered in their square of `limit` and
    the eight around it, so a sensor meets only those of its own square's neighbourhood, by an equi-join; the minimum is
    pre-aggregated, so no group of pairs is sorted.
    """
    d = F.hypot(F.col("x") - F.col("works_x"), F.col("y") - F.col("works_y"))
    at = lambda c: F.floor(F.col(c) / limit).cast("long")
    spread = works
    for name, c in (("__cx", "works_x"), ("__cy", "works_y")):
        spread = spread.withColumn(name, F.explode(F.sequence(at(c) - 1, at(c) + 1)))
    pairs = sensors.withColumn("__cx", at("x")).withColumn("__cy", at("y")).join(spread, [by, "__cx", "__cy"])
    best = F.min(F.struct(d.alias("distance"), F.col("works").alias("works")))
    return pairs.groupBy("sensor").agg(best.alias("b")).select("sensor", "b.works", "b.distance").where(F.col("distance") <= limit)


def rounded_half_up(value: Column, digits: int) -> Column:
    """round(value, digits) of numbers from 0 to 4e9 / 10**digits and of whole ones in plain arithmetic: Spark's own goes through a decimal text for each row. Others go that way."""
    scale = float(10**digits)
    quick = F.floor(value * scale + 0.5) / scale
    # next to a half, what a product in doubles says is not what the number's own digits say
    off = F.abs(value * scale - F.floor(value * scale) - 0.5)
    sure = (value >= 0) & (value < 4e9 / scale) & (off > 1e-6)
    return F.when(F.rint(value) == value, value).when(sure, quick).otherwise(F.round(value, digits))


def distances(sensors: DataFrame, works: DataFrame, by: str, digits: int) -> DataFrame:
    """(sensor, works, distance) for every sensor and every works of its group, rounded.

    sensors: (sensor, by, x, y); works: (works, by, works_x, works_y). All pairs are the result, so the sensors are dealt
    over four tasks a core, whatever group they are of: a few bytes of them make thousands of rows, which neither file
    splits nor the sizes of shuffled partitions show. Works go to each of these tasks where they are counted as small;
    otherwise both sides meet by the group and a part of the sensors.
    """
    spark = sensors.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dx, dy = F.col("x") - F.col("works_x"), F.col("y") - F.col("works_y")
    right = small(works)
    if right is works:
        part = F.pmod(F.xxhash64("sensor"), F.lit(tasks))
        pairs = sensors.withColumn("__part", part).repartition(tasks, by, "__part").join(works.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long")))), [by, "__part"])
    else:
        pairs = sensors.repartition(tasks, "sensor").join(right, by)
    return pairs.select("sensor", "works", rounded_half_up(F.sqrt(dx * dx + dy * dy), digits).alias("distance"))


def cascade(locations: DataFrame, keys: DataFrame) -> DataFrame:
    """Permits matched exactly, else without white space and case, else by letters and digits; more than one at the first level that matches is ambiguous.

    locations: (location, permit); keys: (key). Returns key, level (1 to 3, null), n, status.
    """
    forms = (F.col("permit"), permit_key(F.col("permit")), permit_letters(F.col("permit")))
    of_key = (F.col("key"), permit_key(F.col("key")), permit_letters(F.col("key")))
    hits = [
        keys.select("key", of_key[k].alias("form")).join(locations.select(forms[k].alias("form")).groupBy("form").agg(F.count("*").alias("n")), "form").where("form <> ''").select("key", F.lit(k + 1).alias("level"), "n")
        for k in range(3)
    ]
    first = reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.min(F.struct("level", "n")).alias("m"))
    out = keys.join(first, "key", "left").select("key", "m.level", F.coalesce("m.n", F.lit(0)).alias("n"))
    return out.withColumn("status", F.when(F.col("n") == 0, "unmatched").when(F.col("n") > 1, "ambiguous").otherwise(F.element_at(F.array(F.lit("exact"), F.lit("normalised"), F.lit("alphanumeric")), F.col("level"))))


def candidate_distances(pairs: DataFrame, tiers: tuple[float, ...] = (1000.0, 2000.0, 3000.0), tolerance: float = 1.0) -> DataFrame:
    """Distances of accepted pairs, the discrepancy from an audited distance, the radius label and the two ranks within (company, code)."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("works_x").isNotNull() & F.col("works_y").isNotNull()
    out = pairs.withColumn("eligible", ok).withColumn("distance", F.when(ok, F.hypot(F.col("x") - F.col("works_x"), F.col("y") - F.col("works_y"))))
    label = F.lit("outside_max_radius")
    for t in reversed(tiers):
        label = F.when(F.col("distance") <= t, f"within_{int(t)}m").otherwise(label)
    out = out.withColumn("radius", F.when(~F.col("eligible"), "coordinate_ineligible").otherwise(label))
    out = out.withColumn("discrepancy", F.abs(F.col("distance") - F.col("audited"))).withColumn("discrepant", F.coalesce(F.col("discrepancy") > tolerance, F.lit(False)))
    by = Window.partitionBy("company", "code")
    near = by.orderBy(F.asc_nulls_last("distance"), F.desc("exact"), F.desc("score"), F.desc("margin"), "sensor")
    out = out.withColumn("distance_rank", F.when(F.col("eligible"), F.row_number().over(near)))
    return out.withColumn("name_rank", F.row_number().over(by.orderBy(F.desc("score"), F.desc("margin"), F.desc("exact"), "sensor")))


def primary(universe: DataFrame, ranked: DataFrame, tiers: tuple[float, ...] = (1000.0, 2000.0, 3000.0)) -> DataFrame:
    """For each works the best candidate of the first radius tier that has any, and why there is none otherwise.

    universe: (company, code, works_ok); ranked: candidate_distances. Outcomes aren't among the columns that decide.
    """
    d = F.when(F.col("eligible"), F.col("distance"))
    order = F.struct(d.alias("d"), (~F.col("exact")).alias("e"), (-F.col("score")).alias("s"), (-F.col("margin")).alias("m"), F.col("sensor").alias("sensor"))
    group = ranked.groupBy("company", "code").agg(
        F.count("*").alias("candidates"), F.count_if("eligible").alias("with_coordinates"),
        *(F.count_if(d <= t).alias(f"within_{int(t)}m") for t in tiers),
        F.min(F.when(F.col("eligible"), order)).alias("best"), F.max("score").alias("top_score"),
        F.array_sort(F.collect_list(d)).alias("ds"), F.max("discrepant").alias("inconsistent"),
    )
    tier = F.lit(None).cast("double")
    for t in reversed(tiers):
        tier = F.when(F.col("best.d") <= t, F.lit(t)).otherwise(tier)
    out = universe.join(group, ["company", "code"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0))).withColumn("tier", F.when(F.col("works_ok"), tier))
    inside = F.lit(None).cast("long")
    for t in tiers:
        inside = F.when(F.col("tier") == t, F.col(f"within_{int(t)}m")).otherwise(inside)
    status = (
        F.when(F.col("candidates") == 0, "unassigned_no_accepted_name_candidate")
        .when(~F.col("works_ok"), "unassigned_missing_wwtw_coordinates")
        .when(F.col("with_coordinates") == 0, "unassigned_no_coordinate_eligible_candidate")
        .when(F.col("tier").isNull(), "unassigned_no_candidate_within_max_radius")
        .otherwise(F.concat(F.lit("selected_"), F.when(inside == 1, "unique").otherwise("nearest_of_multiple"), F.lit("_within_"), F.col("tier").cast("int").cast("string"), F.lit("m")))
    )
    nearest_, second = F.try_element_at("ds", F.lit(1)), F.try_element_at("ds", F.lit(2))
    return out.select(
        "company", "code", "candidates", F.coalesce("with_coordinates", F.lit(0)).alias("with_coordinates"), "tier",
        F.when(F.col("tier").isNotNull(), F.col("best.sensor")).alias("sensor"), nearest_.alias("nearest"), second.alias("second"), (second - nearest_).alias("gap"),
        F.when(F.col("tier").isNotNull(), ~F.col("best.e")).alias("exact"), F.when(F.col("tier").isNotNull(), F.abs(F.col("top_score") + F.col("best.s")) <= 1e-6).alias("top_name"), F.coalesce("inconsistent", F.lit(False)).alias("inconsistent"), status.alias("status"),
    )


def review(selection: DataFrame, near_tie: float = 100.0) -> DataFrame:
    """The reasons to look at a selection, in their order, and the priority."""
    assigned = F.col("sensor").isNotNull()
    cases = (
        (F.col("inconsistent"), F.lit("source_or_distance_inconsistency")), (~assigned, F.col("status")),
        (F.col("candidates") > 1, F.lit("multiple_accepted_matching_candidates")), (F.col("tier") > 1000, F.concat(F.lit("selected_outside_1000m_tier_"), F.col("tier").cast("int").cast("string"), F.lit("m"))),
        (assigned & ~F.col("exact"), F.lit("selected_candidate_not_exact_place_core")), (F.col("gap") < near_tie, F.lit("near_distance_tie_under_100m")),
        (assigned & ~F.col("top_name"), F.lit("nearest_candidate_not_highest_name_score")), (F.col("candidates") > F.col("with_coordinates"), F.lit("accepted_candidate_missing_coordinates")),
    )
    reasons = F.array_compact(F.array(*(F.when(when, text) for when, text in cases)))
    out = selection.withColumn("reasons", F.concat_ws(" | ", reasons))
    has = lambda word: F.col("reasons").contains(word)
    priority = F.when(has("inconsistency") | has("conflict"), "critical").when(~assigned | has("missing_coordinate") | has("near_distance_tie") | F.coalesce(F.col("tier") >= 3000, F.lit(False)), "high").when(F.col("reasons") != "", "medium").otherwise("low")
    return out.withColumn("priority", priority).withColumn("review", F.col("reasons") != "")


def override(selection: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manual decisions (company, code, action, chosen) over automatic ones: accept keeps, select replaces, none empties."""
    if n := duplicate_keys(decisions, "company", "code"):
        raise ValueError(f"{n} works have several decisions")
    out = selection.join(decisions, ["company", "code"], "left")
    sensor = F.when(F.col("action") == "select", F.col("chosen")).when(F.col("action") == "none", F.lit(None)).otherwise(F.col("sensor"))
    return out.withColumn("final", sensor).withColumn("overridden", F.col("action").isin("select", "none") & ~F.col("final").eqNullSafe(F.col("sensor"))).withColumn("overridden", F.coalesce("overridden", F.lit(False)))


def top_with_ties(frame: DataFrame, by: str, score: str, k: int, slack: float = 1e-6) -> DataFrame:
    """All rows of a group that reach its k-th best score, less the slack."""
    w = Window.partitionBy(by)
    cut = frame.withColumn("__n", F.row_number().over(w.orderBy(F.desc(score)))).where(F.col("__n") <= k).groupBy(by).agg(F.min(score).alias("__cut"))
    return frame.join(cut, by).where(F.col(score) >= F.col("__cut") - slack).drop("__cut")


def margins(frame: DataFrame, by: str, score: str) -> DataFrame:
    """Best and second score of each group, their margin, and each row's dense rank on scores rounded to six places."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, 6)))
    out = frame.withColumn("dense", F.dense_rank().over(w))
    two = frame.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score)))).where("__n <= 2").groupBy(by).agg(F.max(F.when(F.col("__n") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("__n") == 2, F.col(score))).alias("second"))
    return out.join(two, by).withColumn("margin", F.col("best") - F.coalesce("second", F.lit(0.0)))


def key_differences(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The keys that stand on one side only, each with its side."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def union_filled(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def is_partition(whole: DataFrame, parts: list[DataFrame], on: list[str]) -> bool:
    """Whether the parts' keys are disjoint and cover the whole's."""
    joined = union_filled(*(p.select(*on).distinct() for p in parts))
    return duplicate_keys(joined, *on) == 0 and key_differences(whole, joined, on).isEmpty()
