"""Event logs: two cleaning contracts, quality counters, per-source statistics, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, minutes_between, number, round_up_15

THRESHOLD = 240.0


def require(frame: DataFrame, *columns: str) -> DataFrame:
    """The frame itself; raises where columns are missing."""
    if missing := sorted(set(columns) - set(frame.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def as_time(frame: DataFrame, name: str) -> Column:
    return F.col(name).cast("timestamp") if frame.schema[name].dataType.typeName().startswith("timestamp") else F.try_to_timestamp(F.col(name))


def clean(events: DataFrame) -> DataFrame:
    """The core contract: company trimmed in small letters, permit trimmed, minutes counted from the times; rows without two ordered times drop, zero length stays, one row a (company, permit, start, stop)."""
    require(events, "company", "permit_number", "location_name", "start_time", "stop_time")
    out = events.withColumn("company", F.lower(F.trim(F.col("company").cast("string")))).withColumn("permit_number", F.trim(F.col("permit_number").cast("string")))
    out = out.withColumn("start_time", as_time(events, "start_time")).withColumn("stop_time", as_time(events, "stop_time"))
    out = out.withColumn("duration_minutes", minutes_between(F.col("start_time"), F.col("stop_time"))).where("stop_time >= start_time")
    # of copies the first by location stays: groups are pre-aggregated, so no key has to be sorted in one task
    out = out.groupBy("company", "permit_number", "start_time", "stop_time").agg(F.min("location_name").alias("location_name"), F.first("duration_minutes").alias("duration_minutes"))
    return out.withColumn("sensor_uid", F.concat_ws("::", "company", "permit_number"))


def flagged(events: DataFrame) -> DataFrame:
    """The historical contract's flags: the supplied duration is trusted; a missing permit, a duration that is no number, not finite or not positive rejects a row; bad times are only marked."""
    permit = F.nullif(F.trim(F.col("permit_number").cast("string")), F.lit(""))
    text = F.nullif(F.trim(F.col("duration_minutes").cast("string")), F.lit(""))
    raw = text.try_cast("double")
    has = permit.isNotNull()
    out = events.withColumn("permit_number", permit).withColumn("minutes", F.when(finite(raw), raw))
    out = out.withColumn("missing_permit", ~has).withColumn("non_numeric", has & raw.isNull()).withColumn("non_finite", F.coalesce(has & ~finite(raw) & raw.isNotNull(), F.lit(False)))
    out = out.withColumn("non_positive", F.coalesce(has & finite(raw) & (raw <= 0), F.lit(False)))
    for name in ("start_time", "stop_time"):
        out = out.withColumn(f"__{name}", as_time(events, name)).drop(name).withColumnRenamed(f"__{name}", name).withColumn(f"invalid_{name}", F.col(name).isNull())
    return out.withColumn("valid", ~(F.col("missing_permit") | F.col("non_numeric") | F.col("non_finite") | F.col("non_positive")))


def historical(events: DataFrame, round_15: bool = False) -> DataFrame:
    """The rows that the historical contract keeps, duplicates among them."""
    out = flagged(events).where("valid")
    return out.withColumn("duration_minutes", round_up_15(F.col("minutes")) if round_15 else F.col("minutes")).drop("minutes", "missing_permit", "non_numeric", "non_finite", "non_positive", "valid")


def quality(events: DataFrame, by: str = "source_file") -> DataFrame:
    """Counters of a source: rows read, valid, rejected, each reason, bad times of valid rows, rows that take part in a duplicate."""
    reasons, times = ("missing_permit", "non_numeric", "non_finite", "non_positive"), ("invalid_start_time", "invalid_stop_time")
    # equal rows are counted first, in one pass; a key's rows agree on their flags, so its counters are sums over those
    each = flagged(events).groupBy(by, "permit_number", "start_time", "stop_time", "minutes", "valid", *reasons, *times).agg(F.count("*").alias("n"))
    n, valid = F.col("n"), F.col("valid")
    of = lambda when, name: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).alias(name)
    return each.groupBy(by).agg(
        F.sum("n").alias("rows_read"), of(valid, "rows_valid"), of(~valid, "rows_rejected"), *(of(F.col(c), c) for c in reasons), *(of(valid & F.col(c), c) for c in times), of(valid & (n > 1), "duplicate_rows"),
    )


def hybrid(events: DataFrame) -> DataFrame:
    """The regional contract: the supplied duration is trusted, both times are needed, zero is allowed, one row a (permit, start, stop)."""
    out = events.withColumn("start_time", as_time(events, "start_time")).withColumn("stop_time", as_time(events, "stop_time")).withColumn("duration_minutes", number(F.col("duration_minutes")))
    return out.where("start_time is not null and stop_time is not null and duration_minutes >= 0").groupBy("permit_number", "start_time", "stop_time").agg(F.min("duration_minutes").alias("duration_minutes"))


def tail(minutes: Column, threshold: float = THRESHOLD) -> Column:
    return finite(minutes) & (minutes > threshold)


def counts_and_means(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("event_count"), F.avg("duration_minutes").alias("mean_duration_minutes"))


def statistics(events: DataFrame, *by: str, threshold: float = THRESHOLD) -> DataFrame:
    """One pass of conditional aggregates a source: all events and those of the tail."""
    d = F.col("duration_minutes")
    own = F.when(tail(d, threshold), d)
    return events.groupBy(*by).agg(
        F.count("*").alias("total_count"), F.sum(d).alias("total_minutes"), F.max(d).alias("max_minutes"),
        F.min("start_time").alias("first_time"), F.max("stop_time").alias("last_time"),
        F.array_join(F.array_sort(F.collect_set(F.year("start_time").cast("string"))), ",").alias("years"),
        F.count(own).alias("tail_count"), F.sum(own).alias("tail_minutes"), F.avg(own).alias("tail_mean"), F.median(own).alias("tail_median"), F.max(own).alias("tail_max"),
    )


def modal(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the first by alphabet, and how many values there are."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best["v"].alias(value), F.count("*").alias("n_values"), F.sum("__n").alias("n_rows"))


def first_of(frame: DataFrame, by: list[str], *order: str) -> DataFrame:
    """One row a key, the first by a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def participants(frame: DataFrame, *by: str) -> DataFrame:
    """Every row whose key another row has too; the counts are joined back, so a hot key can be split."""
    many = frame.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return frame.join(many, list(by), "left_semi")


def banded(frame: DataFrame, by: str) -> DataFrame:
    """Company roll-up over sources with a grand total whose medians pool all sources."""
    t = F.col("tail_count")
    out = frame.rollup(by).agg(
        F.grouping(by).alias("is_total"), F.count("*").alias("sources"),
        F.count_if(t == 0).alias("tail_0"), F.count_if(t.between(1, 9)).alias("tail_1_9"), F.count_if(t.between(10, 19)).alias("tail_10_19"), F.count_if(t >= 20).alias("tail_20_up"),
        F.sum("total_count").alias("events"), F.sum("tail_count").alias("tail_events"), F.median("total_count").alias("median_events"), F.median("tail_count").alias("median_tail"), F.max("tail_count").alias("max_tail"),
    )
    return out.withColumn(by, F.when(F.col("is_total") == 1, "ALL").otherwise(F.col(by))).drop("is_total")


def histogram(frame: DataFrame, value: str, threshold: float, bins: int) -> DataFrame:
    """Counts and density on geometric bins from the threshold to the maximum, the last bin closed."""
    top = frame.agg(F.max(value).alias("top"), F.count(value).alias("n"))
    k = F.least(F.floor(F.ln(F.col(value) / threshold) / F.ln(F.col("top") / threshold) * bins), F.lit(bins - 1)).cast("int")
    out = frame.join(F.broadcast(top)).withColumn("bin", k).groupBy("bin").agg(F.count("*").alias("count"), F.first("top").alias("top"), F.first("n").alias("n"))
    edge = lambda i: threshold * F.pow(F.col("top") / threshold, i / float(bins))
    lo, hi = edge(F.col("bin")), edge(F.col("bin") + 1)
    return out.select("bin", "count", F.sqrt(lo * hi).alias("centre"), (F.col("count") / (F.col("n") * (hi - lo))).alias("density"))


def survival(frame: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The empirical survival (n - rank + 1) / n of each value in its group."""
    w = Window.partitionBy(*by)
    return frame.withColumn("survival", (F.count("*").over(w) - F.row_number().over(w.orderBy(value, tie)) + 1) / F.count("*").over(w))


def top_sources(frame: DataFrame, by: str, n: int, *order) -> DataFrame:
    """The n foremost sources of each company; fewer is the caller's error to raise, with `short_groups`."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def short_groups(top: DataFrame, by: str, n: int) -> list[str]:
    return [r[0] for r in top.groupBy(by).count().where(F.col("count") < n).orderBy(by).select(by).collect()]
