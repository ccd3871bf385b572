"""Queries on event logs: cleaning, counters, statistics, tails, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import joins, series, tailfit
from .adapters import view
from .registry import query, rounded

_CLEAN = """
  SELECT lower(trim(company)) AS company, trim(permit_number) AS permit_number, start_time, stop_time, min(location_name) AS location_name,
    (epoch_us(stop_time) - epoch_us(start_time)) / 6e7 AS duration_minutes, lower(trim(company)) || '::' || trim(permit_number) AS sensor_uid
  FROM {events} WHERE stop_time >= start_time GROUP BY 1, 2, 3, 4, 6, 7"""
_GAPS, _SHIPS = _CLEAN.format(events="gap_events"), _CLEAN.format(events="ship_events")


def _gaps(spark, sf):
    return E.clean(view(spark, sf, "gap_events"))


def flagship(spark, sf):
    """Per-source statistics and the fitted tail of the gaps between a user's events, the heaviest tails first."""
    own = _gaps(spark, sf)
    fits = tailfit.fits(own).drop("at_bound")
    return E.statistics(own, "company", "permit_number").join(fits, ["company", "permit_number"], "left").orderBy(F.asc_nulls_last("beta"), "permit_number")


def _micros(frame, *columns):
    return frame.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in columns})


@query("C1_clean_events", f"SELECT company, permit_number, location_name, sensor_uid, epoch_us(start_time) AS start_time, epoch_us(stop_time) AS stop_time, round(duration_minutes, 6) AS duration_minutes FROM ({_SHIPS})")
def _(spark, sf):
    return rounded(_micros(E.clean(view(spark, sf, "ship_events")), "start_time", "stop_time"), "duration_minutes")


_FLAGS = """
WITH raw AS (SELECT *, nullif(trim(permit_number), '') AS permit, TRY_CAST(nullif(trim(duration_minutes), '') AS DOUBLE) AS d, TRY_CAST(stop_time AS TIMESTAMP) AS stop, TRY_CAST(start_time AS TIMESTAMP) AS start FROM provided),
f AS (SELECT *, permit IS NULL AS missing_permit, permit IS NOT NULL AND d IS NULL AS non_numeric, coalesce(permit IS NOT NULL AND NOT isfinite(d), false) AS non_finite, coalesce(permit IS NOT NULL AND isfinite(d) AND d <= 0, false) AS non_positive FROM raw),
v AS (SELECT *, NOT (missing_permit OR non_numeric OR non_finite OR non_positive) AS valid FROM f)
"""


@query("C3_historical_validity", _FLAGS + "SELECT source_file, missing_permit, non_numeric, non_finite, non_positive, valid, stop IS NULL AS invalid_stop_time, count(*) AS n FROM v GROUP BY ALL")
def _(spark, sf):
    by = ["source_file", "missing_permit", "non_numeric", "non_finite", "non_positive", "valid", "invalid_stop_time"]
    return E.flagged(view(spark, sf, "provided")).groupBy(*by).agg(F.count("*").alias("n"))


@query("C4_quality_counters", _FLAGS + """, c AS (SELECT source_file, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS duplicate_rows FROM (SELECT source_file, permit, start, stop, d, count(*) AS n FROM v WHERE valid GROUP BY ALL) GROUP BY 1)
SELECT source_file, count(*) AS rows_read, count(*) FILTER (valid) AS rows_valid, count(*) FILTER (NOT valid) AS rows_rejected, count(*) FILTER (missing_permit) AS missing_permit, count(*) FILTER (non_numeric) AS non_numeric, count(*) FILTER (non_finite) AS non_finite,
  count(*) FILTER (non_positive) AS non_positive, count(*) FILTER (valid AND start IS NULL) AS invalid_start_time, count(*) FILTER (valid AND stop IS NULL) AS invalid_stop_time, CAST(any_value(duplicate_rows) AS BIGINT) AS duplicate_rows FROM v LEFT JOIN c USING (source_file) GROUP BY 1""")
def _(spark, sf):
    return E.quality(view(spark, sf, "provided"))


@query("C5_round_up_15", "SELECT ceil(l_quantity / 15) * 15 AS minutes, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(S.round_up_15(F.col("l_quantity")).alias("minutes")).agg(F.count("*").alias("n"))


@query("C6_tail_events", f"SELECT company, count(*) AS n, round(min(duration_minutes), 6) AS least FROM ({_GAPS}) WHERE duration_minutes > 240 GROUP BY 1")
def _(spark, sf):
    return rounded(_gaps(spark, sf).where(E.tail(F.col("duration_minutes"))).groupBy("company").agg(F.count("*").alias("n"), F.min("duration_minutes").alias("least")), "least")


@query("C7_finite_and_numbers", "SELECT count(*) AS n, count(TRY_CAST(duration_minutes AS DOUBLE)) AS numbers, count(*) FILTER (coalesce(isfinite(TRY_CAST(duration_minutes AS DOUBLE)), false)) AS finite FROM provided")
def _(spark, sf):
    x = S.number(F.col("duration_minutes"))
    return view(spark, sf, "provided").agg(F.count("*").alias("n"), F.count(x).alias("numbers"), F.count_if(S.finite(x)).alias("finite"))


@query("A1_source_statistics", f"""SELECT company, permit_number, count(*) AS total_count, round(sum(duration_minutes), 4) AS total_minutes, round(max(duration_minutes), 6) AS max_minutes, epoch_us(min(start_time)) AS first_time, epoch_us(max(stop_time)) AS last_time,
  string_agg(DISTINCT CAST(year(start_time) AS VARCHAR), ',' ORDER BY CAST(year(start_time) AS VARCHAR)) AS years, count(*) FILTER (duration_minutes > 240) AS tail_count, round(sum(duration_minutes) FILTER (duration_minutes > 240), 4) AS tail_minutes,
  round(avg(duration_minutes) FILTER (duration_minutes > 240), 6) AS tail_mean, round(median(duration_minutes) FILTER (duration_minutes > 240), 6) AS tail_median, round(max(duration_minutes) FILTER (duration_minutes > 240), 6) AS tail_max FROM ({_GAPS}) GROUP BY 1, 2""")
def _(spark, sf):
    out = _micros(E.statistics(_gaps(spark, sf), "company", "permit_number"), "first_time", "last_time")
    return rounded(rounded(out, "max_minutes", "tail_mean", "tail_median", "tail_max"), "total_minutes", "tail_minutes", digits=4)


@query("A2_counts_and_means", f"SELECT sensor_uid, count(*) AS event_count, round(avg(duration_minutes), 4) AS mean_duration_minutes FROM ({_SHIPS}) GROUP BY 1")
def _(spark, sf):
    return rounded(E.counts_and_means(E.clean(view(spark, sf, "ship_events")), "sensor_uid"), "mean_duration_minutes", digits=4)


@query("A3_modal_location", "WITH c AS (SELECT permit_number, location_name, count(*) AS n FROM gap_events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY permit_number ORDER BY n DESC, location_name) AS k, count(*) OVER (PARTITION BY permit_number) AS n_values, sum(n) OVER (PARTITION BY permit_number) AS n_rows FROM c) SELECT permit_number, location_name, n_values, CAST(n_rows AS BIGINT) AS n_rows FROM r WHERE k = 1")
def _(spark, sf):
    return E.modal(view(spark, sf, "gap_events"), ["permit_number"], "location_name")


_STATS = f"SELECT company, permit_number, count(*) AS total_count, count(*) FILTER (duration_minutes > 240) AS tail_count FROM ({_GAPS}) GROUP BY 1, 2"


@query("A4_tail_fraction", f"SELECT permit_number, round(tail_count / total_count, 6) AS tail_fraction, round(total_count / sum(total_count) OVER (), 6) AS share FROM ({_STATS})")
def _(spark, sf):
    own = E.statistics(_gaps(spark, sf), "company", "permit_number")
    whole = own.agg(F.sum("total_count").alias("all"))
    return rounded(own.join(F.broadcast(whole)).select("permit_number", (F.col("tail_count") / F.col("total_count")).alias("tail_fraction"), (F.col("total_count") / F.col("all")).alias("share")), "tail_fraction", "share")


_BANDS = f"""SELECT {{company}} AS company, count(*) AS sources, count(*) FILTER (tail_count = 0) AS tail_0, count(*) FILTER (tail_count BETWEEN 1 AND 9) AS tail_1_9, count(*) FILTER (tail_count BETWEEN 10 AND 19) AS tail_10_19, count(*) FILTER (tail_count >= 20) AS tail_20_up,
 CAST(sum(total_count) AS BIGINT) AS events, CAST(sum(tail_count) AS BIGINT) AS tail_events, median(total_count) AS median_events, median(tail_count) AS median_tail, max(tail_count) AS max_tail FROM ({_STATS})"""


@query("A5_A6_banded_rollup", _BANDS.format(company="company") + " GROUP BY 1 UNION ALL " + _BANDS.format(company="'ALL'"))
def _(spark, sf):
    return E.banded(E.statistics(_gaps(spark, sf), "company", "permit_number"), "company")


@query("A7_national_equals_sum", f"SELECT sum(n) = (SELECT count(*) FROM ({_GAPS})) AS equal, CAST(sum(n) AS BIGINT) AS total FROM (SELECT company, count(*) AS n FROM ({_GAPS}) GROUP BY 1)")
def _(spark, sf):
    r = _gaps(spark, sf).rollup("company").agg(F.count("*").alias("n"), F.grouping("company").alias("g"))
    s, t = F.sum(F.when(F.col("g") == 0, F.col("n"))), F.sum(F.when(F.col("g") == 1, F.col("n")))
    return r.agg((s == t).alias("equal"), s.alias("total"))


@query("A8_A9_status_and_distinct", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("A10_A40_quantiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)) + ", min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def _(spark, sf):
    qs = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)
    own = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.percentile("value", F.array(*map(F.lit, qs))).alias("q"), F.min("value").alias("least"), F.max("value").alias("most"))
    return own.select("event_type", *(F.round(F.col("q")[k], 6).alias(f"q{int(q * 100):02d}") for k, q in enumerate(qs)), "least", "most")


@query("A20_sum_min_count", "SELECT c_custkey % 10 AS g, sum(CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_custkey END) AS s FROM customer GROUP BY 1")
def _(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").groupBy((k % 10).alias("g")).agg(F.sum(F.when(k % 10 != 3, k)).alias("s"))


@query("A22_pipes", "SELECT user_id, string_agg(DISTINCT trim(event_type), '|' ORDER BY trim(event_type)) AS kinds FROM events GROUP BY 1")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(S.sorted_pipe(F.col("event_type")).alias("kinds"))


@query("A23_split_pipes", "WITH p AS (SELECT user_id % 10 AS g, event_type || '|' || (user_id % 4) AS v FROM events), u AS (SELECT DISTINCT g, unnest(string_split(v, '|')) AS t FROM p) SELECT g, string_agg(t, '|' ORDER BY t) AS pipe FROM u GROUP BY 1")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 10).alias("g"), F.concat_ws("|", "event_type", (F.col("user_id") % 4).cast("string")).alias("v"))
    return own.groupBy("g").agg(S.sorted_pipe(F.col("v"), split=True).alias("pipe"))


@query("A36_tail_histogram", f"""WITH t AS (SELECT duration_minutes AS v FROM ({_GAPS}) WHERE duration_minutes > 240), m AS (SELECT max(v) AS top, count(*) AS n FROM t),
b AS (SELECT CAST(least(floor(ln(v / 240) / ln(top / 240) * 20), 19) AS INTEGER) AS bin, count(*) AS count, any_value(top) AS top, any_value(n) AS n FROM t, m GROUP BY 1)
SELECT bin, count, round(sqrt(240 * pow(top / 240, bin / 20.0) * 240 * pow(top / 240, (bin + 1) / 20.0)), 4) AS centre, round(count / (n * (240 * pow(top / 240, (bin + 1) / 20.0) - 240 * pow(top / 240, bin / 20.0))), 9) AS density FROM b""")
def _(spark, sf):
    out = E.histogram(_gaps(spark, sf).where(E.tail(F.col("duration_minutes"))), "duration_minutes", 240.0, 20)
    return rounded(rounded(out, "centre", digits=4), "density", digits=9)


@query("A37_survival", f"SELECT permit_number, round(duration_minutes * 60, 6) AS duration_seconds, round((count(*) OVER w - row_number() OVER (PARTITION BY permit_number ORDER BY duration_minutes, start_time) + 1) / count(*) OVER w, 9) AS survival FROM ({_GAPS}) WHERE duration_minutes > 240 WINDOW w AS (PARTITION BY permit_number)")
def _(spark, sf):
    out = E.survival(_gaps(spark, sf).where(E.tail(F.col("duration_minutes"))), ["permit_number"], "duration_minutes", "start_time")
    return rounded(rounded(out.select("permit_number", (F.col("duration_minutes") * 60).alias("duration_seconds"), "survival"), "duration_seconds"), "survival", digits=9)


@query("C30_tail_density", "SELECT l_quantity AS q, count(*) AS n, round(exp(least(greatest(ln(0.5) + ln(0.01) + (0.5 - 1) * (ln(0.01) + ln(240 + l_quantity * 10)) - exp(0.5 * (ln(0.01) + ln(240 + l_quantity * 10))) + exp(0.5 * (ln(0.01) + ln(240))), -745), 700)), 9) AS density FROM lineitem GROUP BY 1, 3")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))
    return own.withColumn("density", F.round(S.tail_density(240 + F.col("q") * 10, 240.0, F.lit(0.5), F.lit(0.01)), 9))


@query("C31_duration_labels", """WITH v AS (SELECT DISTINCT CAST(l_quantity * l_linenumber * 30 AS DOUBLE) AS m FROM lineitem) SELECT m, CASE m WHEN 60 THEN '1 h' WHEN 120 THEN '2 h' WHEN 240 THEN '4 h' WHEN 360 THEN '6 h' WHEN 720 THEN '12 h' WHEN 1440 THEN '24 h / 1 d' WHEN 2880 THEN '48 h / 2 d' WHEN 4320 THEN '72 h / 3 d' WHEN 10080 THEN '1 wk'
 ELSE CASE WHEN m / 60 < 24 THEN printf('%g h', m / 60) WHEN m / 1440 < 7 THEN printf('%g d', m / 1440) WHEN m / 1440 < 60 THEN printf('%g wk', m / 1440 / 7) WHEN m / 1440 < 365 THEN printf('%g mo', m / 1440 / 30) ELSE printf('%g yr', m / 1440 / 365) END END AS label FROM v""")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_quantity") * F.col("l_linenumber") * 30).cast("double").alias("m")).distinct()
    return own.select("m", S.duration_label(F.col("m")).alias("label"))


@query("W5_top_sources", f"SELECT * FROM (SELECT company, permit_number, tail_count, total_count, CAST(row_number() OVER (PARTITION BY company ORDER BY tail_count DESC, total_count DESC, permit_number) AS INTEGER) AS rank FROM ({_STATS})) WHERE rank <= 5")
def _(spark, sf):
    own = E.statistics(_gaps(spark, sf), "company", "permit_number").select("company", "permit_number", "tail_count", "total_count")
    return E.top_sources(own, "company", 5, F.desc("tail_count"), F.desc("total_count"), "permit_number")


@query("W6_rankings", f"SELECT permit_number, CAST(row_number() OVER (ORDER BY w ASC NULLS LAST, permit_number) AS INTEGER) AS by_width, CAST(row_number() OVER (ORDER BY tail_count DESC, permit_number) AS INTEGER) AS by_tail FROM (SELECT *, CASE WHEN tail_count % 4 <> 0 THEN tail_count % 7 END AS w FROM ({_STATS}))")
def _(spark, sf):
    t = F.col("tail_count")
    own = E.statistics(_gaps(spark, sf), "company", "permit_number").withColumn("w", F.when(t % 4 != 0, t % 7))
    out = joins.numbered(joins.numbered(own, F.col("w"), ["permit_number"], "by_width"), -t, ["permit_number"], "by_tail")
    return out.select("permit_number", *(F.col(c).cast("int").alias(c) for c in ("by_width", "by_tail")))


@query("W7_group_distinct", "SELECT event_id, (SELECT count(DISTINCT e2.event_type) FROM events e2 WHERE e2.user_id = e.user_id) AS kinds FROM events e")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/events.parquet")
    kinds = own.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))
    return own.join(kinds, "user_id").select("event_id", "kinds")


@query("W13_keep_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def _(spark, sf):
    return E.first_of(spark.read.parquet(f"{sf}/events.parquet"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("W14_participants", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k > 1 GROUP BY 1, 2")
def _(spark, sf):
    return E.participants(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("W21_pages", "SELECT CAST(ceil(k / 35.0) AS BIGINT) AS page, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part) GROUP BY 1")
def _(spark, sf):
    own = joins.numbered(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey"), F.col("p_partkey"), [], "k")
    return own.groupBy(F.ceil(F.col("k") / 35.0).alias("page")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


_BETAS = [0.05, 0.1, 0.2, 0.4, 0.8, 1.2, 1.6, 2.0]


def _grid_sql() -> str:
    grid = ", ".join(f"({b}::DOUBLE)" for b in _BETAS)
    return f"""WITH t AS (SELECT company, permit_number, ln(duration_minutes / 240) AS r, ln(duration_minutes) AS l FROM ({_GAPS}) WHERE duration_minutes > 240), g(b) AS (VALUES {grid}),
    s AS (SELECT company, permit_number, b, count(*) AS n, sum(l) AS sl, sum(exp(b * r) - 1) AS e FROM t, g GROUP BY 1, 2, 3),
    q AS (SELECT *, least(greatest((ln(n) - ln(e) - b * ln(240)) / b, -50), 20) AS log_rate FROM s WHERE n >= 10), v AS (SELECT *, n * (ln(b) + b * log_rate) + (b - 1) * sl - exp(b * (log_rate + ln(240))) * e AS value FROM q),
    k AS (SELECT *, row_number() OVER (PARTITION BY company, permit_number ORDER BY value DESC, b) AS place FROM v)
    SELECT company, permit_number, n, b AS beta, round(log_rate, 6) AS log_rate, round(value, 4) AS log_likelihood FROM k WHERE place = 1"""


@query("F14_tail_fit_grid", _grid_sql())
def _(spark, sf):
    return rounded(rounded(tailfit.grid_fits(_gaps(spark, sf), _BETAS), "log_rate"), "log_likelihood", digits=4)


@query("F14_tail_fit")
def _(spark, sf):
    return tailfit.fits(_gaps(spark, sf))


@query("F15_fit_status", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN tail_count = 0 THEN 'no_tail_events' WHEN tail_count < 10 THEN 'too_few_tail_events' ELSE 'fitted' END AS status FROM ({_STATS})) GROUP BY 1")
def _(spark, sf):
    return tailfit.fits(_gaps(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("F16_tail_bootstrap")
def _(spark, sf):
    return tailfit.fits(_gaps(spark, sf), replicates=1000)


_COMPLETE = "SELECT place, date, mm, year(date) AS year FROM days WHERE complete"
_RUNS = f"""SELECT place, year, coalesce(max(n) FILTER (wet), 0) AS cwd, coalesce(max(n) FILTER (NOT wet), 0) AS cdd FROM (SELECT place, year, wet, count(*) AS n FROM (SELECT place, year, mm >= 1 AS wet, date - CAST(row_number() OVER (PARTITION BY place, year, mm >= 1 ORDER BY date) AS INTEGER) AS island FROM ({_COMPLETE})) GROUP BY place, year, wet, island) GROUP BY 1, 2"""
_FIVE = f"""SELECT place, year, max(CASE WHEN n = 5 THEN s END) AS rx5 FROM (SELECT place, year, count(*) OVER w AS n, sum(mm) OVER w AS s FROM ({_COMPLETE}) WINDOW w AS (PARTITION BY place, year ORDER BY date RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW)) GROUP BY 1, 2"""


@query("W11_longest_runs", f"SELECT place, CAST(year AS INTEGER) AS year, cwd, cdd FROM ({_RUNS})")
def _(spark, sf):
    return series.runs(view(spark, sf, "days"))


@query("W12_five_day_windows", f"SELECT place, CAST(year AS INTEGER) AS year, round(rx5, 4) AS rx5 FROM ({_FIVE})")
def _(spark, sf):
    return rounded(series.five_day(view(spark, sf, "days")), "rx5", digits=4)


_ANNUAL = f"""SELECT place, CAST(year AS INTEGER) AS year, complete_days, round(prcptot, 4) AS prcptot, round(rx1, 4) AS rx1, round(sdii, 6) AS sdii, r10, r20, round(rx5, 4) AS rx5, cwd, cdd FROM (SELECT place, year(date) AS year, count(*) FILTER (complete) AS complete_days, coalesce(sum(mm) FILTER (complete AND mm >= 1), 0) AS prcptot, max(mm) FILTER (complete) AS rx1,
  avg(mm) FILTER (complete AND mm >= 1) AS sdii, count(*) FILTER (complete AND mm >= 10) AS r10, count(*) FILTER (complete AND mm >= 20) AS r20 FROM days GROUP BY 1, 2) LEFT JOIN ({_FIVE}) USING (place, year) LEFT JOIN ({_RUNS}) USING (place, year)"""


@query("A29_annual_indices", _ANNUAL)
def _(spark, sf):
    return rounded(series.annual(view(spark, sf, "days")), "prcptot", "rx1", "rx5", digits=4).withColumn("sdii", F.round("sdii", 6))


@query("A31_daily_completeness", "WITH o AS (SELECT *, samples = 12 AND source_samples = 12 AS ok FROM hours) SELECT place, CAST(date AS VARCHAR) AS date, CASE WHEN count(*) = 24 AND count(*) FILTER (ok) = 24 THEN round(sum(mm), 4) END AS mm, count(*) = 24 AND count(*) FILTER (ok) = 24 AS complete FROM o GROUP BY place, date")
def _(spark, sf):
    return rounded(series.daily_from_hours(view(spark, sf, "hours")).withColumn("date", F.col("date").cast("string")), "mm", digits=4)


@query("X25_daily_inventory", "SELECT CAST(year AS INTEGER) AS year, median(n) AS median_days, min(n) AS min_days, max(n) AS max_days FROM (SELECT place, year(date) AS year, count(*) FILTER (complete) AS n FROM days GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return series.inventory(view(spark, sf, "days"))


_YEARS = "SELECT 'u' || (l_suppkey % 10) AS place, year(l_shipdate) AS year, count(DISTINCT CAST(l_shipdate AS DATE)) AS complete_days, round(sum(l_quantity), 2) AS rain FROM lineitem GROUP BY 1, 2"
_QUALITY = f"""SELECT *, complete_days / (CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 366 ELSE 365 END) AS coverage, year >= 1996 AND year <= 2000 AS full_year FROM ({_YEARS})"""


def _years(spark, sf):
    d = spark.read.parquet(f"{sf}/lineitem.parquet")
    own = d.groupBy(F.concat(F.lit("u"), (F.col("l_suppkey") % 10).cast("string")).alias("place"), F.year("l_shipdate").alias("year")).agg(F.countDistinct(F.to_date("l_shipdate")).alias("complete_days"), F.round(F.sum("l_quantity"), 2).alias("rain"))
    return series.year_quality(own.withColumn("first", F.expr("timestamp_ntz'1996-01-01 00:00:00'")).withColumn("last", F.expr("timestamp_ntz'2000-12-31 23:55:00'")), least=0.6)


@query("X24_year_eligibility", f"SELECT place, CAST(year AS INTEGER) AS year, round(coverage, 6) AS coverage, full_year, full_year AND coverage >= 0.6 AS eligible, CASE WHEN full_year AND coverage >= 0.6 THEN 'valid_complete_year' WHEN NOT full_year THEN 'incomplete_monitoring_year' ELSE 'insufficient_radar_coverage' END AS flag FROM ({_QUALITY})")
def _(spark, sf):
    return rounded(_years(spark, sf).select("place", "year", "coverage", "full_year", "eligible", "flag"), "coverage")


@query("A30_multi_year", f"SELECT place, round(avg(rain), 4) AS rain, count(*) AS n_years, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, CASE WHEN count(*) >= 3 THEN 'strong_3plus_complete_years' WHEN count(*) >= 2 THEN 'usable_2_complete_years' ELSE 'limited_1_complete_year' END AS label FROM ({_QUALITY}) WHERE full_year AND coverage >= 0.6 GROUP BY 1")
def _(spark, sf):
    return rounded(series.multi_year(_years(spark, sf), ["rain"]), "rain", digits=4)
