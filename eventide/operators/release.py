"""Release tables: sensor masters, manual decisions, linked pairs, primary sensors, and the gates that they pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, inside_grid
from . import gates, master
from .joins import checked_join, duplicate_keys, key_differences, preserving_join

BLANK = ""


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == BLANK)


def _demand_unique(frame: DataFrame, what: str, *keys: str) -> None:
    if n := duplicate_keys(frame, *keys):
        raise ValueError(f"{what}: {n} keys ({', '.join(keys)}) stand more than once")


# --- sensor master -----------------------------------------------------------------------------------------------


def sensor_population(parts: dict[str, DataFrame], key: str = "permit_number") -> DataFrame:
    """One frame of the companies' frames: the same columns in the same order, each of its own company alone, keys present and unique."""
    first = next(iter(parts.values())).columns
    for name, part in parts.items():
        if part.columns != first:
            raise ValueError(f"{name}: columns differ from the first company's")
    own = [p.withColumn("company", F.trim("company")).withColumn(key, F.trim(F.col(key).cast("string"))).withColumn("__of", F.lit(n)) for n, p in parts.items()]
    every = reduce(DataFrame.unionByName, own)
    bad = every.agg(F.count_if(~F.col("company").eqNullSafe(F.col("__of"))).alias("company"), F.count_if(_blank(key)).alias("key"), F.countDistinct("__of").alias("parts")).first()
    if bad["company"] or bad["key"] or bad["parts"] != len(parts):
        raise ValueError(f"{bad['company']} rows of another company, {bad['key']} blank keys, {len(parts) - bad['parts']} companies without rows")
    every = every.drop("__of")
    _demand_unique(every, "sensor population", "company", key)
    return every


def coordinate_audit(frame: DataFrame, key: str) -> DataFrame:
    """The audit's rows that have a sensor-side key, which becomes permit_number; a key that stands twice is an error, as no row is chosen."""
    own = frame.withColumn("company", F.trim("company")).withColumn(key, F.trim(key)).where(~_blank(key)).withColumnRenamed(key, "permit_number")
    _demand_unique(own, "coordinate audit", "company", "permit_number")
    return own


def sensor_master(population: DataFrame, audit: DataFrame, accepted: tuple[str, ...], threshold: float = 240.0) -> DataFrame:
    """Each sensor of the population with its coordinates, location, quality and issues.

    population: (company, permit_number, location_name, the fit's columns); audit: (company, permit_number, match,
    conflict, coordinate_valid, x, y, json_location_name, strict). The location falls back on the audit's where the
    population has none and the match is accepted. The audit's own strict flag must agree with the one made here.
    """
    _demand_unique(population, "sensor population", "company", "permit_number")
    out = preserving_join(population, audit, ["company", "permit_number"])
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("conflict", "coordinate_valid", "strict")})
    out = master.coordinate_status(out, accepted)
    fallback = _blank("location_name") & F.coalesce(F.col("match").isin(*accepted), F.lit(False))
    out = out.withColumn("location_name", F.when(fallback, F.coalesce("json_location_name", F.lit(BLANK))).otherwise(F.coalesce("location_name", F.lit(BLANK))))
    out = out.withColumn("sensor_uid", F.concat_ws("::", "company", "permit_number")).withColumn("threshold", F.lit(threshold)).withColumn("threshold_operator", F.lit(">"))
    out = master.with_issues(master.beta_quality(out))
    if n := out.where("strict <> eligible_for_beta").count():
        raise ValueError(f"{n} sensors whose strict eligibility differs from the audit's")
    return out


def joined_master(base: DataFrame, extra: DataFrame, keys: list[str], deprecated: tuple[str, ...]) -> DataFrame:
    """base without columns of a deprecated prefix, extra joined one to one; the rest of base's columns are proved unchanged."""
    kept = [c for c in base.columns if not c.startswith(deprecated)]
    own = base.select(*kept)
    _demand_unique(own, "master", *keys)
    out = preserving_join(own, extra, keys)
    gates.demand(gates.unchanged(own, out, kept))
    return out.select(*kept, *(c for c in extra.columns if c not in keys))


# --- manual decisions --------------------------------------------------------------------------------------------


def validate_manual(lines: DataFrame, works: DataFrame, sensors: DataFrame, base: DataFrame, slack: float = 1e-9) -> DataFrame:
    """What each manual line leads to: status (its first issue, or valid_manual_assignment), notes, and the sensor it selects.

    lines: (line_no, code, ids array, parsed boolean); works: (company, code); sensors: (sensor, company, x, y), no
    outcomes; base: (company, code, works_x, works_y, sensor), the automatic selection. Ids that fail the counts aren't
    looked at further; then companies, earlier selections and geometry are. Of several ids the nearest is taken, the
    smallest of those within `slack` of it. One row a line; equal lines repeat.
    """
    if leaked := [c for c in sensors.columns if "beta" in c.lower() or "tail" in c.lower()]:
        raise ValueError(f"outcomes among the columns that select: {leaked}")
    lines = lines.select("line_no", "code", "ids", "parsed")
    each = lines.select("line_no", "code", F.posexplode("ids").alias("k", "sensor"))
    listed = each.groupBy("sensor").agg((F.count("*") > 1).alias("listed_twice"))
    known = sensors.groupBy("sensor").agg(F.count("*").alias("sensor_rows"), F.first("company").alias("sensor_company"), F.first("x").alias("x"), F.first("y").alias("y"))
    # the last of several works that chose one sensor; a clean base has one
    taken = base.where("sensor is not null and sensor <> ''").groupBy("sensor").agg(F.max("code").alias("taken_by"))
    of_works = works.groupBy("code").agg(F.count("*").alias("works_rows"), F.first("company").alias("works_company"))
    of_base = base.groupBy("code").agg(F.first("company").alias("base_company"), F.first("works_x").alias("works_x"), F.first("works_y").alias("works_y"), F.first("sensor").alias("previous"))
    codes = lines.groupBy("code").agg((F.count("*") > 1).alias("code_twice"))
    head = lines.select("line_no", "code", "parsed").join(codes, "code", "left").join(of_works, "code", "left").join(of_base, "code", "left")

    full = each.join(listed, "sensor", "left").join(known, "sensor", "left").join(taken, "sensor", "left")
    full = full.join(head.select("line_no", "works_company", "works_x", "works_y"), "line_no")
    usable = finite(F.col("x")) & finite(F.col("y"))
    distance = F.when(usable, F.hypot(F.col("x") - F.col("works_x"), F.col("y") - F.col("works_y")))
    uid = F.col("sensor")
    full = full.select(
        "line_no", "k", "sensor", F.coalesce("listed_twice", F.lit(False)).alias("twice"),
        F.when(F.coalesce("sensor_rows", F.lit(0)) != 1, F.concat(F.lit("manual_sensor_not_exactly_once:"), uid)).alias("count_issue"),
        F.when(~F.col("sensor_company").eqNullSafe(F.col("works_company")), F.concat(F.lit("manual_company_conflict:"), uid)).alias("company_issue"),
        F.when(F.col("taken_by") != F.col("code"), F.concat(F.lit("manual_sensor_selected_for_other_wwtw:"), uid, F.lit(":"), F.col("taken_by"))).alias("taken_issue"),
        usable.alias("usable"), distance.alias("distance"),
    )
    in_order = lambda what: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", F.array_compact(F.array(*what)).alias("v")))), lambda r: r["v"]))
    sums = full.groupBy("line_no").agg(
        F.max("twice").alias("twice"), in_order(["count_issue"]).alias("count_issues"), in_order(["company_issue", "taken_issue"]).alias("company_issues"),
        F.max("usable").alias("any_usable"), F.array_sort(F.collect_list(F.struct("distance", "sensor", "usable"))).alias("found"), F.array_sort(F.collect_list(F.struct("k", "sensor"))).alias("all"),
    )
    out = head.join(sums, "line_no", "left")
    text = lambda when, what: F.when(when, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    first = F.concat(
        text(~F.col("parsed"), "manual_parse_error"), text(F.col("code_twice"), "duplicate_manual_wwtw_record"), text(F.coalesce("works_rows", F.lit(0)) != 1, "manual_wwtw_not_exactly_once"),
        text(F.coalesce("twice", F.lit(False)), "duplicate_manual_sensor_record"), F.coalesce("count_issues", empty),
    )
    grid = finite(F.col("works_x")) & finite(F.col("works_y"))
    second = F.concat(text(~F.col("base_company").eqNullSafe(F.col("works_company")), "base_wwtw_company_inconsistency"), F.coalesce("company_issues", empty), text(~grid, "manual_wwtw_geometry_missing"))
    third = text(~F.coalesce("any_usable", F.lit(False)), "manual_sensor_geometry_missing")
    out = out.withColumn("issues", first)
    out = out.withColumn("issues", F.when(F.size("issues") == 0, second).otherwise(F.col("issues")))
    out = out.withColumn("issues", F.when(F.size("issues") == 0, third).otherwise(F.col("issues")))
    ok = F.size("issues") == 0
    near = F.filter("found", lambda r: r["usable"])
    least = F.array_min(F.transform(near, lambda r: r["distance"]))
    out = out.withColumn("least", F.when(ok, least))
    chosen = F.array_min(F.transform(F.filter(near, lambda r: r["distance"] <= F.col("least") + slack), lambda r: r["sensor"]))
    out = out.withColumn("chosen", F.when(ok, chosen))
    others = F.array_join(F.transform(F.filter("all", lambda r: r["sensor"] != F.col("chosen")), lambda r: r["sensor"]), " | ")
    method = F.when(F.size("all") == 1, "explicit_manual_single_sensor").otherwise("nearest_of_manually_approved_candidates_outcome_blind")
    return out.select(
        "line_no", "code", F.when(ok, "valid_manual_assignment").otherwise(F.try_element_at("issues", F.lit(1))).alias("status"), F.array_join("issues", "; ").alias("notes"),
        F.when(ok, F.col("works_company")).alias("company"), "chosen", F.when(ok, others).alias("alternatives"), F.when(ok, F.col("previous")).alias("previous"), F.when(ok, method).alias("method"),
        F.when(ok, F.array_min(F.transform(F.filter(near, lambda r: r["sensor"] == F.col("chosen")), lambda r: r["distance"]))).alias("distance"),
    )


def frozen(base: DataFrame, applied: DataFrame) -> DataFrame:
    """The final sensor of each works: the manual one, else the automatic one; a sensor that two works share is an error. No outcome is read."""
    manual = applied.where("chosen is not null").select("code", F.col("chosen").alias("manual"))
    _demand_unique(manual, "manual assignments", "code")
    own = base.select("company", "code", F.when(_blank("sensor"), None).otherwise(F.col("sensor")).alias("previous")).join(manual, "code", "left")
    by_hand = F.col("manual").isNotNull()
    out = own.withColumn("sensor", F.coalesce("manual", "previous"))
    out = out.withColumn("status", F.when(by_hand, "assigned_manual").when(F.col("sensor").isNotNull(), "assigned_automatic").otherwise("unmatched_treatment_works"))
    out = out.withColumn("source", F.when(by_hand, "manual_inspection").when(F.col("sensor").isNotNull(), "automatic_primary_spatial").otherwise("none_after_manual_review"))
    _demand_unique(out.where("sensor is not null"), "final sensors", "sensor")
    return out.select("company", "code", "previous", "sensor", "status", "source")


def final_tables(works: DataFrame, identities: DataFrame, sensors: DataFrame) -> DataFrame:
    """Works and outcomes joined after the identities are frozen, with final_pair_uid; every selected sensor must be found."""
    out = preserving_join(works, identities, ["company", "code"])
    out = preserving_join(out, sensors.withColumn("__found", F.lit(True)), ["sensor"])
    if n := out.where("sensor is not null and __found is null").count():
        raise ValueError(f"{n} selected sensors aren't in the sensor table")
    return out.drop("__found").withColumn("final_pair_uid", F.when(F.col("sensor").isNotNull(), F.concat_ws("::", "company", "code", "sensor")).otherwise(BLANK))


def sensor_classes(sensors: DataFrame, candidates: DataFrame, final: DataFrame) -> DataFrame:
    """Each sensor as matching, a candidate that isn't selected, or unmatched."""
    chosen = final.where("sensor is not null").select("sensor").distinct().withColumn("__chosen", F.lit(True))
    named = candidates.select("sensor").distinct().withColumn("__named", F.lit(True))
    out = sensors.select("sensor").join(chosen, "sensor", "left").join(named, "sensor", "left")
    return out.select("sensor", F.when(F.col("__chosen"), "matching_cso_sensor").when(F.col("__named"), "nonselected_matching_candidate").otherwise("unmatched_cso_sensor").alias("class"))


def _one(gate: str, violations: DataFrame) -> DataFrame:
    """A gate from a frame of violations."""
    return violations.agg(F.count("*").alias("violations")).select(F.lit(gate).alias("gate"), "violations", (F.col("violations") == 0).alias("passed"))


def _duplicates(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def equal_counts(gate: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """The gate that two frames have as many rows: the difference is its violations."""
    rows = a.select(F.lit(1).alias("n")).unionByName(b.select(F.lit(-1).alias("n")))
    n = F.abs(F.coalesce(F.sum("n"), F.lit(0)))
    return rows.agg(n.alias("violations")).select(F.lit(gate).alias("gate"), "violations", (F.col("violations") == 0).alias("passed"))


def manual_release_gates(final: DataFrame, works: DataFrame, classes: DataFrame, outcomes: list[str]) -> DataFrame:
    """The gates of the final release: one row a gate."""
    assigned = final.where("sensor is not null")
    rows = gates.violations(final, {
        "assignment_partition": F.col("sensor").isNotNull() == (F.col("status") != "unmatched_treatment_works"),
        "unassigned_sensor_fields_blank": F.col("sensor").isNotNull() | reduce(lambda a, b: a & b, (F.col(c).isNull() for c in outcomes)),
    })
    parts = [
        equal_counts("supervisor_row_count", final, works), _one("supervisor_key_unique", _duplicates(final, "company", "code")), rows, _one("selected_sensor_unique", _duplicates(assigned, "sensor")),
        _one("sensor_partition_unique", _duplicates(classes, "sensor")), gates.violations(classes, {"sensor_classes_exact": F.col("class").isin("matching_cso_sensor", "nonselected_matching_candidate", "unmatched_cso_sensor")}),
        equal_counts("matching_count_equals_assigned", classes.where("class = 'matching_cso_sensor'"), assigned),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- linked pairs and primary sensors ----------------------------------------------------------------------------


def pair_master(chosen: DataFrame, previous: DataFrame, sensors: DataFrame, works: DataFrame) -> DataFrame:
    """The accepted pairs with the sensor's and the works' own columns, whether a pair is new, and how many sensors its works has.

    chosen: (company, code, sensor, accepted, ...); previous: (pair_uid); sensors and works bring their columns, keyed by
    sensor and by (company, code). A works with one sensor has its primary by name alone.
    """
    own = chosen.where("accepted").withColumn("pair_uid", F.concat_ws("::", "company", "code", "sensor"))
    _demand_unique(own, "pairs", "pair_uid")
    _demand_unique(own, "pairs", "sensor")
    seen = previous.select("pair_uid").distinct().withColumn("__seen", F.lit(True))
    out = own.join(seen, "pair_uid", "left").withColumn("newly_accepted", F.col("__seen").isNull()).drop("__seen")
    out = preserving_join(out, sensors, ["sensor"])
    out = preserving_join(out, works, ["company", "code"])
    n = out.groupBy("company", "code").agg(F.countDistinct("sensor").alias("sensors"))
    out = out.join(n, ["company", "code"])
    return out.withColumn("is_primary", F.col("sensors") == 1).withColumn("primary_status", F.when(F.col("sensors") == 1, "unique_name_primary").otherwise("multiple_matching_sensors_requires_later_primary_selection"))


def own_company(pairs: DataFrame, sensors: DataFrame) -> DataFrame:
    """One row: how many pairs' companies were compared with their sensors' own, how many agree, and whether all do."""
    both = checked_join(pairs.select("sensor", F.col("company").alias("of_pair")), sensors.select("sensor", F.col("company").alias("of_sensor")), ["sensor"], "inner", "one_to_one")
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("of_pair") == F.col("of_sensor")).alias("agreeing"), F.coalesce(F.bool_and(F.col("of_pair") == F.col("of_sensor")), F.lit(True)).alias("same_company_only"))


def pair_gates(pairs: DataFrame, chosen: DataFrame, sensors: DataFrame, works: DataFrame) -> DataFrame:
    """The gates of the name match."""
    of = pairs.select("sensor", F.col("company").alias("of_pair")).join(sensors.select("sensor", "company"), "sensor")
    leaked = [c for c in pairs.columns if "beta" in c.lower() and c != "beta"]
    spark = pairs.sparkSession
    parts = [
        _one("accepted_sensors_authoritative", pairs.join(sensors, "sensor", "left_anti")), _one("accepted_wwtw_authoritative", pairs.join(works, ["company", "code"], "left_anti")),
        _one("same_company_only", of.where("of_pair <> company")), _one("pair_uid_unique", _duplicates(pairs, "pair_uid")),
        gates.violations(chosen, {"exact_scores_100": ~F.col("exact") | (F.col("score") == 100), "qualifier_conflicts_not_accepted": ~(F.col("qualifier") & F.col("accepted"))}),
        equal_counts("multiple_sensors_retained", pairs, chosen.where("accepted")),
        _one("sensor_beta_unchanged", pairs.select("sensor", F.col("beta").alias("b")).join(sensors.select("sensor", "beta"), "sensor").where("not (b <=> beta)")),
        _one("no_wwtw_beta_leakage", spark.createDataFrame([(c,) for c in leaked], "c string")), _one("treatment_work_unique", _duplicates(works, "company", "code")),
    ]
    return reduce(DataFrame.unionByName, parts)


def accepted_pair_gates(pairs: DataFrame, universe: DataFrame) -> DataFrame:
    """The gates under which a table of accepted pairs may be read: all accepted, pairs and sensors unique, works known."""
    parts = [gates.violations(pairs, {"all accepted": F.col("accepted")}), _one("pair unique", _duplicates(pairs, "pair_uid")), _one("sensor unique", _duplicates(pairs, "sensor")), _one("works known", pairs.join(universe, ["company", "code"], "left_anti"))]
    return reduce(DataFrame.unionByName, parts)


def works_universe(characteristics: DataFrame, points: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The works that both authoritative tables name: equal key sets, each unique; columns that speak of outcomes go."""
    own = characteristics.select(*(c for c in characteristics.columns if not any(h in c.lower() for h in hidden)))
    for what, frame in (("characteristics", own), ("points", points)):
        if n := frame.where(_blank("company") | _blank("code")).count():
            raise ValueError(f"{what}: {n} blank keys")
        _demand_unique(frame, what, "company", "code")
    if not (d := key_differences(own, points, ["company", "code"])).isEmpty():
        raise ValueError(f"the sources name different works: {[tuple(r) for r in d.limit(20).collect()]}")
    return checked_join(own, points, ["company", "code"], "left", "one_to_one")


def primary_master(universe: DataFrame, selection: DataFrame, candidates: DataFrame, sensors: DataFrame) -> DataFrame:
    """Each works of the universe with its selection, the chosen candidate's evidence and the sensor's outcomes, which are joined last."""
    chosen = candidates.join(selection.where("sensor is not null").select("company", "code", "sensor"), ["company", "code", "sensor"], "left_semi")
    chosen = chosen.select("company", "code", F.concat_ws("::", "company", "code", "sensor").alias("primary_pair_uid"), F.col("distance").alias("primary_distance"), F.col("score").alias("selected_score"), F.col("margin").alias("selected_margin"))
    out = preserving_join(universe, selection, ["company", "code"])
    out = preserving_join(out, chosen, ["company", "code"])
    return preserving_join(out, sensors, ["sensor"])


def candidate_audit(candidates: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Each candidate with its works' review and whether it is the primary."""
    flags = reviewed.select("company", "code", F.col("sensor").alias("__chosen"), "review", "priority", "reasons")
    out = preserving_join(candidates, flags, ["company", "code"])
    return out.withColumn("selected_as_primary", F.coalesce(F.col("sensor") == F.col("__chosen"), F.lit(False))).drop("__chosen")


def review_queue(reviewed: DataFrame, audit: DataFrame) -> DataFrame:
    """The works to look at, with their candidates and distances in order; place: where each stands, the most pressing first."""
    far = F.coalesce("distance", F.lit(float("inf")))
    lists = audit.groupBy("company", "code").agg(F.array_sort(F.collect_list(F.struct(far.alias("d"), "sensor", F.coalesce(F.format_string("%.3f", "distance"), F.lit(BLANK)).alias("t"), F.col("distance").isNull().alias("none")))).alias("c"))
    joined = lambda part: F.array_join(F.transform("c", part), " | ")
    lists = lists.select("company", "code", joined(lambda r: r["sensor"]).alias("candidate_sensors"), joined(lambda r: F.when(r["none"], BLANK).otherwise(r["t"])).alias("candidate_distances"))
    out = reviewed.where("review").join(lists, ["company", "code"], "left").withColumns({c: F.coalesce(c, F.lit(BLANK)) for c in ("candidate_sensors", "candidate_distances")})
    rank = F.array_position(F.array(*(F.lit(p) for p in ("critical", "high", "medium", "low"))), F.col("priority"))
    return out.withColumn("rank", rank)


def primary_gates(universe: DataFrame, final: DataFrame, audit: DataFrame, tiers: tuple[float, ...] = (1000.0, 2000.0, 3000.0)) -> DataFrame:
    """The gates of the primary selection."""
    assigned = final.where("sensor is not null")
    chosen = audit.where("selected_as_primary")
    parts = [
        equal_counts("primary_master_row_count", final, universe), _one("primary_master_key_unique", _duplicates(final, "company", "code")), _one("assigned_exactly_one_sensor", _duplicates(assigned, "company", "code")),
        _one("selected_sensor_unique", _duplicates(assigned, "sensor")), _one("automatic_selected_from_accepted_pairs", assigned.join(audit, ["company", "code", "sensor"], "left_anti")), equal_counts("selected_key_consistency", chosen, assigned),
        gates.violations(assigned, {"automatic_distance_finite_and_bounded": finite(F.col("nearest")) & (F.col("nearest") <= max(tiers)), "automatic_radius_tiers_valid": F.col("tier").isin(*tiers)}),
        gates.violations(chosen, {"automatic_selected_nearest": F.col("distance_rank") == 1, "missing_coordinates_not_automatic": F.col("eligible")}),
        _one("table_assignment_partition", final.where("(sensor is null) = startswith(status, 'selected_')")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- assignment and capacity -------------------------------------------------------------------------------------


def sensor_scope(sensors: DataFrame, known: DataFrame, company: str | None = None) -> DataFrame:
    """The sensors of one company or all; keys present and unique, companies known, not empty."""
    _demand_unique(sensors, "sensor master", "sensor")
    if not (strange := sensors.where("company is not null").select("company").distinct().join(known, "company", "left_anti")).isEmpty():
        raise ValueError(f"unknown companies: {sorted(r[0] for r in strange.limit(20).collect())}")
    out = sensors if company is None else sensors.where(F.col("company") == company)
    if out.isEmpty():
        raise ValueError("no sensors in scope")
    return out


def alias_conflicts(configured: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(company, configured, expected) where a configured alias (company, alias) isn't the expected one, or is missing."""
    want = configured.sparkSession.createDataFrame(sorted(expected.items()), "company string, expected string")
    own = configured.select(F.trim("company").alias("company"), F.trim("alias").alias("configured"))
    return want.join(own, "company", "left").where(~F.col("configured").eqNullSafe(F.col("expected"))).select("company", "configured", "expected")


def sensor_points(sensors: DataFrame) -> DataFrame:
    """The eligible sensors as points; one of them outside the grid or without coordinates is an error."""
    ok = finite(F.col("x")) & finite(F.col("y")) & inside_grid(F.col("x"), F.col("y"), inclusive=False)
    own = sensors.where("eligible")
    if n := own.where(~F.coalesce(ok, F.lit(False))).count():
        raise ValueError(f"{n} eligible sensors without valid coordinates")
    _demand_unique(own, "points", "sensor")
    return own.select("sensor", "company", "x", "y")


def relation_codes(relations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Relations (sensor, kind, polygon) with their polygon's codes and names, many to one: lookup rows (polygon, code, name) gather first."""
    codes = F.array_sort(F.collect_set("code"))
    own = lookup.groupBy("polygon").agg(F.array_join(codes, "|").alias("codes"), F.size(codes).alias("n_codes"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))
    out = preserving_join(relations, own, ["polygon"])
    return out.withColumns({"codes": F.coalesce("codes", F.lit(BLANK)), "names": F.coalesce("names", F.lit(BLANK)), "n_codes": F.coalesce("n_codes", F.lit(0))})


def candidate_layer(relations: DataFrame, points: DataFrame) -> DataFrame:
    """One row a relation, with the sensor's point; a relation that stands twice is an error."""
    _demand_unique(relations, "relations", "sensor", "polygon", "kind")
    return preserving_join(relations, points.select("sensor", "x", "y"), ["sensor"])


ASSIGNMENT_STATUSES = ("not_eligible_for_catchment_matching", "unique_same_company_containment", "multiple_same_uwwcode", "multiple_different_uwwcodes", "boundary_match", "company_conflict", "no_catchment_match")


def assignment_gates(sensors: DataFrame, assigned: DataFrame, relations: DataFrame, polygons: DataFrame, codes: DataFrame) -> DataFrame:
    """The gates of the spatial assignment.

    sensors: (sensor, company, eligible); assigned: (sensor, status, polygons, code, n_codes, review, reason); relations:
    (sensor, kind, polygon); polygons: (polygon, company); codes: (code).
    """
    s = F.col("status")
    own = assigned.join(sensors, "sensor", "left")
    not_eligible = s == "not_eligible_for_catchment_matching"
    rows = gates.violations(own, {
        "status present": s.isNotNull(), "status known": s.isin(*ASSIGNMENT_STATUSES), "eligible sensors processed": F.coalesce(F.col("eligible"), F.lit(False)) != not_eligible,
        "several with one code": (s != "multiple_same_uwwcode") | (F.col("n_codes") == 1), "several with different codes": (s != "multiple_different_uwwcodes") | (F.col("n_codes") > 1),
        "boundary not accepted": (s != "boundary_match") | (F.col("code") == BLANK), "nearest not accepted": ~s.isin("no_catchment_match", "company_conflict") | (F.col("code") == BLANK),
        "review has a reason": ~(s.isin(*master.ACCEPTED) & F.col("review")) | (F.col("reason") != BLANK),
    })
    accepted = relations.where("kind = 'within'").join(assigned.where(s == "unique_same_company_containment").select("sensor"), "sensor", "left_semi")
    of = accepted.join(polygons.select("polygon", F.col("company").alias("polygon_company")), "polygon", "left").join(sensors.select("sensor", "company"), "sensor", "left")
    parts = [
        equal_counts("row count", assigned, sensors), _one("sensor unique", _duplicates(assigned, "sensor")), _one("same population", key_differences(sensors, assigned, ["sensor"])), rows,
        _one("polygons known", relations.join(polygons, "polygon", "left_anti")), _one("codes known", assigned.where("code <> ''").join(codes, "code", "left_anti")),
        _one("unique ones are of their company", of.where("not (polygon_company <=> company)")), _one("one row a relation", _duplicates(relations, "sensor", "polygon", "kind")),
    ]
    return reduce(DataFrame.unionByName, parts)


def works_keys(sewersheds: DataFrame, names: DataFrame) -> DataFrame:
    """(company, code, name) of sewersheds (label, code, name): labels go back to companies by names (company, label); none may be left over, keys are unique."""
    _demand_unique(names, "company names", "label")
    out = sewersheds.withColumn("code", F.trim("code")).join(names, "label", "left")
    if n := out.where("company is null or code is null").count():
        raise ValueError(f"{n} sewersheds without company or code")
    _demand_unique(out, "sewersheds", "company", "code")
    return out.select("company", "code", "name")


def capacity_of_keys(keys: DataFrame, capacity: DataFrame) -> DataFrame:
    """Each (company, code) with its code's capacity; missing_waterbase_match where there is none."""
    out = preserving_join(keys, capacity, ["code"])
    return out.withColumn("status", F.coalesce("status", F.lit("missing_waterbase_match"))).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("available", "over_design", "extreme", "zero_load")})


def capacity_issue(status: Column, available: Column, extreme: Column) -> Column:
    """The issue of a works' capacity by priority; null where there is none."""
    bad = ~available | (status != "valid") | extreme
    kind = F.when(extreme & available, "extreme_capacity_ratio").when(status == "conflicting_latest_records", "conflicting_latest_records").when(status == "missing_waterbase_match", "missing_waterbase_match").otherwise("missing_or_invalid_capacity")
    return F.when(bad, kind)


def beta_statistics(frame: DataFrame, *by: str) -> DataFrame:
    """The summary of the sensors of each group: counts, and statistics of eligible and of all finite betas."""
    ok, beta = F.col("eligible_for_beta"), F.col("beta")
    own, some = F.when(ok, beta), F.when(finite(beta) & (beta > 0), beta)
    out = frame.groupBy(*by).agg(
        F.count("*").alias("assigned_n"), F.count_if("located").alias("located_n"), F.count_if(ok).alias("primary_n"), F.median(own).alias("median"), F.avg(own).alias("mean"), F.stddev_samp(own).alias("sd"),
        F.percentile(own, F.lit(0.25)).alias("q25"), F.percentile(own, F.lit(0.75)).alias("q75"), F.median(F.when(ok, F.col("ci_width"))).alias("median_width"), F.median(F.when(ok, F.col("tail_count"))).alias("median_tail"),
        F.count(some).alias("finite_n"), F.median(some).alias("finite_median"), F.avg(some).alias("finite_mean"),
    )
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


COUNTS = ("assigned_n", "located_n", "primary_n", "finite_n")


def works_summary(keys: DataFrame, capacity: DataFrame, sensors: DataFrame) -> DataFrame:
    """Each works' capacity and the statistics of the sensors assigned to it, counts zero filled; few: under three eligible ones."""
    accepted = sensors.where(F.col("assignment").isin(*master.ACCEPTED) & ~_blank("code"))
    out = preserving_join(keys, capacity.select("company", "code", "status", "ratio", "n_records", "n_valid"), ["company", "code"])
    out = preserving_join(out, beta_statistics(accepted, "company", "code"), ["company", "code"])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS}).withColumn("few", F.col("primary_n") < 3)


def raw_summary(relations: DataFrame, sensors: DataFrame) -> DataFrame:
    """Each polygon that holds accepted sensors: its code where its relations name exactly one, and their statistics."""
    accepted = sensors.where(F.col("assignment").isin(*master.ACCEPTED))
    own = relations.where("kind = 'within'").join(accepted.drop("code"), "sensor")
    codes = own.groupBy("polygon").agg(F.array_sort(F.collect_set(F.when(F.col("codes") != BLANK, F.col("codes")))).alias("c"))
    status = F.when(F.size("c") == 1, "linked").when(F.size("c") > 1, "conflicting_treatment_work_identifiers").otherwise("no_treatment_work_identifier")
    codes = codes.select("polygon", F.when(F.size("c") == 1, F.col("c")[0]).otherwise(BLANK).alias("code"), status.alias("link"))
    return beta_statistics(own, "polygon").join(codes, "polygon")


def capacity_gates(records: DataFrame, capacity: DataFrame, sensors: DataFrame, summary: DataFrame) -> DataFrame:
    """The gates of the capacity join: the latest year, ratios that are load over capacity, nothing filled in where there is no value, counts that add up."""
    valid = finite(F.col("year")) & finite(F.col("load")) & finite(F.col("capacity")) & F.coalesce((F.col("load") >= 0) & (F.col("capacity") > 0), F.lit(False))
    latest = records.where(valid).groupBy("code").agg(F.max("year").alias("latest"))
    own = capacity.join(latest, "code", "left")
    ok = F.col("status") == "valid"
    none = F.col("load").isNull() & F.col("capacity").isNull() & F.col("ratio").isNull()
    accepted = sensors.where(F.col("assignment").isin(*master.ACCEPTED) & ~_blank("code")).join(summary.select("company", "code"), ["company", "code"], "left_semi")
    beta = F.col("beta")
    add = lambda name, column, rows: summary.select(F.col(column).cast("long").alias("n")).unionByName(rows.select(F.lit(-1).cast("long").alias("n"))).agg(F.abs(F.coalesce(F.sum("n"), F.lit(0))).alias("violations")).select(F.lit(name).alias("gate"), "violations", (F.col("violations") == 0).alias("passed"))
    stats = [F.col(c).isNull() for c in ("median", "mean", "sd", "q25", "q75", "median_width", "median_tail")]
    parts = [
        gates.violations(own, {"latest year": ~ok | (F.col("data_year") == F.col("latest")), "ratio is load over capacity": ~ok | (F.abs(F.col("ratio") - F.col("load") / F.col("capacity")) <= 1e-12 + 1e-12 * F.abs("ratio")), "unavailable stays empty": F.col("available") | none, "conflicts not resolved": (F.col("status") != "conflicting_latest_records") | (F.col("n_latest") > 1)}),
        _one("sensor unique", _duplicates(sensors, "sensor")), _one("works unique", _duplicates(summary, "company", "code")), add("assigned counts add up", "assigned_n", accepted), add("primary counts add up", "primary_n", accepted.where("eligible_for_beta")),
        add("finite counts add up", "finite_n", accepted.where(finite(beta) & (beta > 0))), gates.violations(summary, {"none without primary sensors": (F.col("primary_n") > 0) | reduce(lambda a, b: a & b, stats)}),
    ]
    return reduce(DataFrame.unionByName, parts)


def completion(records: DataFrame, capacity: DataFrame, sensors: DataFrame, summary: DataFrame) -> DataFrame:
    """One row of what the capacity join came to."""
    ok = F.col("status") == "valid"
    ratio = F.when(ok, F.col("ratio"))
    a = records.agg(F.count("*").alias("records"), F.countDistinct("code").alias("codes"))
    b = capacity.agg(F.count_if(ok).alias("valid"), F.count_if(F.col("status") == "no_valid_capacity_record").alias("without"), F.count_if(F.col("status") == "conflicting_latest_records").alias("conflicting"), F.count_if(ratio > 1).alias("above_1"), F.count_if(ratio > 2).alias("above_2"), F.median(ratio).alias("median_ratio"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"))
    accepted = F.col("assignment").isin(*master.ACCEPTED)
    c = sensors.agg(F.count_if(accepted).alias("accepted"), F.count_if(accepted & F.col("capacity_available")).alias("accepted_with_capacity"))
    d = summary.agg(F.count_if(F.col("primary_n") >= 1).alias("works_with_one"), F.count_if(F.col("primary_n") >= 3).alias("works_with_three"))
    # each is one row, so equal constants join them
    key = lambda frame: frame.withColumn("__one", F.lit(1))
    out = reduce(lambda x, y: x.join(F.broadcast(key(y)), "__one"), [b, c, d], key(a)).drop("__one")
    return out.withColumn("accepted_pct", F.try_divide(100.0 * F.col("accepted_with_capacity"), F.col("accepted")))


# --- events, categories, rainfall --------------------------------------------------------------------------------


def selected_events(events: DataFrame, selection: DataFrame, threshold: float = 240.0) -> DataFrame:
    """All events of the selected sensors, the selection's columns first, with `tail` and each sensor's own order: by start, those without one last.

    events: (company, permit_number, start_time, stop_time, duration_minutes); selection: (company, permit_number, ...).
    The order is a number within a sensor, so no task sorts the whole table.
    """
    _demand_unique(selection, "selection", "company", "permit_number")
    out = checked_join(events, selection, ["company", "permit_number"], "inner", "many_to_one")
    order = Window.partitionBy("company", "permit_number").orderBy(F.asc_nulls_last("start_time"), F.asc_nulls_last("stop_time"), "duration_minutes")
    first = ["company", "permit_number", *(c for c in selection.columns if c not in ("company", "permit_number"))]
    return out.withColumn("tail", F.col("duration_minutes") > threshold).withColumn("place", F.row_number().over(order)).select(*first, "start_time", "stop_time", "duration_minutes", "tail", "place")


def coordinate_pairs(rows: DataFrame, sensor: str = "sensor") -> DataFrame:
    """How many different coordinate pairs a sensor has, and whether that is a conflict; a pair with a part missing or not a number counts for none."""
    pair = F.when(finite(F.col("x")) & finite(F.col("y")), F.struct("x", "y"))
    n = F.countDistinct(pair)
    return rows.groupBy(sensor).agg(n.alias("pairs"), (n > 1).alias("conflict"))


def category_lookup(sources: DataFrame, lookup: DataFrame, keys: list[str], target: str, allowed: list[str]) -> DataFrame:
    """sources with the lookup's target, matched null-safely: the two must name the same combinations, all approved, targets allowed."""
    a, b = sources.select(*keys).distinct(), lookup.select(*keys)
    same = lambda x, y: reduce(lambda p, q: p & q, (x[k].eqNullSafe(y[k]) for k in keys))
    if n := b.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").count():
        raise ValueError(f"{n} combinations stand more than once in the lookup")
    missing, spare = a.join(b, same(a, b), "left_anti").count(), b.join(a, same(b, a), "left_anti").count()
    wrong = lookup.where(~F.coalesce(F.col("approved"), F.lit(False)) | ~F.coalesce(F.col(target).isin(*allowed), F.lit(False))).count()
    if missing or spare or wrong:
        raise ValueError(f"{missing} combinations without an entry, {spare} entries without rows, {wrong} not approved or not allowed")
    own = lookup.select(*(F.col(k).alias(f"__{k}") for k in keys), target)
    on = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return sources.join(own, on).drop(*(f"__{k}" for k in keys))


def source_version(frame: DataFrame, column: str) -> str:
    """The versions that a column names, in order, joined by '|'."""
    found = frame.select(F.trim(F.col(column).cast("string")).alias("v")).where("v <> ''").distinct().agg(F.array_join(F.array_sort(F.collect_list("v")), "|")).first()[0]
    return found or "unknown"


def source_scale(text: Column) -> Column:
    """The denominator of a map scale such as 1:625,000, or k after a number (625k); null without one."""
    ratio = F.regexp_extract(text, r"1\s*:\s*([0-9][0-9,]*)", 1)
    thousands = F.regexp_extract(F.lower(text), r"(?:^|[^0-9])([0-9]+)\s*k(?:[^a-z]|$)", 1)
    return F.when(ratio != "", F.regexp_replace(ratio, ",", "").cast("long")).when(thousands != "", thousands.cast("long") * 1000)


def with_defaults(units: DataFrame, results: DataFrame, key: str, shares: list[str]) -> DataFrame:
    """Every unit with its extraction, or the default row: zero shares, 'invalid_geometry' or 'no_data'. units: (key, valid)."""
    out = preserving_join(units, results.withColumn("__hit", F.lit(True)), [key])
    status = F.when(F.col("__hit"), F.col("status")).when(~F.col("valid"), "invalid_geometry").otherwise("no_data")
    return out.withColumn("status", status).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in shares}).drop("__hit")


def rainfall_layers(summary: DataFrame, works: DataFrame, sensors: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rainfall summary joined to works and to sensors by (company, code), rows kept, other columns proved unchanged."""
    own = summary.select("company", "code", *columns)
    out = []
    for frame in (works, sensors):
        joined = preserving_join(frame, own, ["company", "code"])
        gates.demand(gates.unchanged(frame, joined, frame.columns))
        out.append(joined)
    return out[0], out[1]


def variable_summary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, least, mean, median, most) of each column over its finite values: one aggregate."""
    value = {c: F.when(finite(F.col(c)), F.col(c)) for c in columns}
    row = frame.agg(*(F.struct(F.count(v).alias("n"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("most")).alias(c) for c, v in value.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("s")) for c in columns))).alias("r")).select("r.variable", "r.s.*")


def bootstrap_gates(fits: DataFrame, draws: int) -> DataFrame:
    """The gates of a bootstrap's table: counts that add up, rates within their bounds, ordered intervals, values only where the fit succeeded."""
    c = F.col
    null = lambda *names: reduce(lambda a, b: a & b, (c(n).isNull() for n in names))
    rules = {
        "attempted or not": c("bootstrapped").isNotNull(), "success in 0..1": c("success_rate").isNull() | c("success_rate").between(0, 1), "hits in 0..1": c("hit_rate").isNull() | c("hit_rate").between(0, 1),
        "interval ordered": c("ci_low").isNull() | c("ci_high").isNull() | (c("ci_low") <= c("ci_high")), "beta in its bounds": c("beta").isNull() | c("beta").between(0.01, 2.0),
        "no beta without a fit": c("fitted") | null("beta"), "tail within events": c("tail_count") <= c("total_count"), "whole number of draws": F.coalesce(F.abs(c("success_rate") * draws - F.round(c("success_rate") * draws)) < 1e-6, F.lit(True)),
    }
    return gates.violations(fits, rules)
