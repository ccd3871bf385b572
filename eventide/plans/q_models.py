"""Queries on model evaluation: folds by place and company, importance, comparisons, scorecards, regions' measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import joins, models, regress, spatial
from . import q_statistics as T
from .adapters import view
from .registry import query, rounded

_TWO = ["x1", "x2"]
#: Sums of two predictors and an outcome over a frame of (x1, x2, y), and the least-squares coefficients from them.
_SUMS = "count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y"
_B1, _B2 = "((s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12))", "((s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12))"
_OLS = f"{_B1} AS b1, {_B2} AS b2, my - {_B1} * m1 - {_B2} * m2 AS b0"


def _y():
    return F.log("outcome")


def _ready(frame):
    return models.prepare(frame, _TWO)


# --- folds by place and company ---

_PLACED = "(SELECT m.company, m.sensor, x1, x2, ln(outcome) AS y, CAST(floor(s.x / 100000) AS BIGINT) || '_' || CAST(floor(s.y / 100000) AS BIGINT) AS block FROM measures m JOIN sensors s ON s.sensor = m.sensor)"
_FOLDS = f"(SELECT p.*, fold FROM {_PLACED} p JOIN (SELECT block, (row_number() OVER (ORDER BY count(*) DESC, block) - 1) % 5 AS fold FROM {_PLACED} GROUP BY 1) f ON f.block = p.block)"


def _placed(spark, sf):
    own = view(spark, sf, "measures").join(view(spark, sf, "sensors").select("sensor", "x", "y"), "sensor")
    return own.withColumn("block", models.block_id(F.col("x"), F.col("y")))


@query("F31_spatial_cross_validation", f"""WITH f AS MATERIALIZED {_FOLDS}, m AS (SELECT k.fold, {_SUMS} FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY 1), c AS (SELECT fold, {_OLS} FROM m)
SELECT '100km_spatial_GroupKFold' AS analysis, n, round(score, 8) AS rmse, round(base, 8) AS base_rmse, round(100 * (base - score) / base, 6) AS gain_pct FROM (SELECT count(*) AS n, sqrt(avg(pow(y - b0 - b1 * x1 - b2 * x2, 2))) AS score, stddev_pop(y) AS base FROM f JOIN c USING (fold))""")
def _(spark, sf):
    own = models.balanced_folds(_placed(spark, sf), F.col("block"), 5)
    n, score, base, gain = models.out_of_fold(models.grams(own, _ready(own), _y(), F.col("fold")), "ols")
    return spark.createDataFrame([("100km_spatial_GroupKFold", n, round(score, 8), round(base, 8), round(gain, 6))], "analysis string, n long, rmse double, base_rmse double, gain_pct double")


@query("F31_leave_one_company_out", f"""WITH f AS MATERIALIZED (SELECT company, x1, x2, ln(outcome) AS y FROM measures), m AS (SELECT k.company, {_SUMS} FROM (SELECT DISTINCT company FROM f) k JOIN f ON f.company <> k.company GROUP BY 1), c AS (SELECT company, n AS train, my, {_OLS} FROM m)
SELECT company, n, round(score, 8) AS rmse, round(base, 8) AS base_rmse, round(100 * (base - score) / base, 6) AS gain_pct FROM (SELECT f.company, count(*) AS n, any_value(train) AS train, sqrt(avg(pow(y - b0 - b1 * x1 - b2 * x2, 2))) AS score, sqrt(avg(pow(y - my, 2))) AS base FROM f JOIN c ON c.company = f.company GROUP BY 1) WHERE n >= 10 AND train >= 50""")
def _(spark, sf):
    own = view(spark, sf, "measures")
    rows = models.leave_one_out(models.grams(own, _ready(own), _y(), F.col("company")), "ols")
    return spark.createDataFrame([(k, n, round(s, 8), round(b, 8), round(g, 6)) for k, n, s, b, g in rows], "company string, n long, rmse double, base_rmse double, gain_pct double")


# --- importance ---

_TRAIN = f"t AS MATERIALIZED (SELECT company, sensor, x1, x2, ln(outcome) AS y, split FROM {T._SPLIT})"


def _where(split: str) -> str:
    """Coefficients of the rows of some splits: of both predictors (b0, b1, b2), of x1 alone (a0, a1), of x2 alone (c0, c1)."""
    return f"(SELECT {_OLS}, s1y / s11 AS a1, my - s1y / s11 * m1 AS a0, s2y / s22 AS c1, my - s2y / s22 * m2 AS c0, sqrt(s11) AS d1, sqrt(s22) AS d2 FROM (SELECT {_SUMS} FROM t WHERE split IN ({split})))"


_FULL, _ONE, _OTHER = "pow(y - b0 - b1 * x1 - b2 * x2, 2)", "pow(y - a0 - a1 * x1, 2)", "pow(y - c0 - c1 * x2, 2)"


def _split_grams(spark, sf, features=None):
    own = T._split(spark, sf)
    ready = models.prepare(own.where("split = 'TRAIN'"), features or _TWO)
    return own, ready, models.grams(own, ready, _y(), F.col("split"))


@query("F30_ablation", f"""WITH {_TRAIN}, m AS (SELECT sqrt(avg({_FULL})) AS f, sqrt(avg({_ONE})) AS a, sqrt(avg({_OTHER})) AS c FROM t, {_where("'TRAIN'")} WHERE split = 'VALIDATION')
SELECT 'none_full_model' AS block, 2 AS features, round(f, 8) AS rmse, 0e0 AS delta FROM m UNION ALL SELECT 'first', 1, round(c, 8), round(c - f, 8) FROM m UNION ALL SELECT 'second', 1, round(a, 8), round(a - f, 8) FROM m""")
def _(spark, sf):
    _, _, g = _split_grams(spark, sf)
    rows = models.ablation(g["TRAIN"], g["VALIDATION"], {"first": ["x1"], "second": ["x2"], "absent": ["x9"]})
    return spark.createDataFrame([(b, n, round(r, 8), round(d, 8)) for b, n, r, d in rows], "block string, features int, rmse double, delta double")


@query("F30_permutation_importance", f"""WITH {_TRAIN}, c AS {_where("'TRAIN'")}, r AS (SELECT b1, b2, x1, x2, y - b0 - b1 * x1 - b2 * x2 AS e FROM t, c WHERE split = 'TEST'),
s AS (SELECT sqrt(avg(e * e)) AS base, any_value(b1) AS b1, any_value(b2) AS b2, avg(pow(e + b1 * x1, 2)) AS q1, avg(e + b1 * x1) AS e1, avg(x1) AS m1, avg(x1 * x1) AS v1, avg(pow(e + b2 * x2, 2)) AS q2, avg(e + b2 * x2) AS e2, avg(x2) AS m2, avg(x2 * x2) AS v2 FROM r)
SELECT 'x1' AS feature, round(sqrt(q1 - 2 * b1 * e1 * m1 + b1 * b1 * v1) - base, 8) AS importance FROM s UNION ALL SELECT 'x2', round(sqrt(q2 - 2 * b2 * e2 * m2 + b2 * b2 * v2) - base, 8) FROM s""")
def _(spark, sf):
    _, _, g = _split_grams(spark, sf)
    found = models.permutation_importance(models.solve(g["TRAIN"], "ols"), g["TEST"])
    return spark.createDataFrame([(n, round(v, 8)) for n, v in found.items()], "feature string, importance double")


_U = "CAST(('0x' || substr(md5(sensor || '|' || draw), 1, 12)) AS BIGINT) / 281474976710656e0"
_TIMES = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in models._POISSON)
_WSUMS = "sum(w) AS n, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * y) / sum(w) AS my"


@query("F30_coefficient_stability", f"""WITH {_TRAIN}, d AS MATERIALIZED (SELECT x1, x2, y, draw, {_TIMES} AS w FROM (SELECT t.*, draw, {_U} AS u FROM t, (SELECT unnest(range(1, 51)) AS draw) WHERE split <> 'TEST')), m AS (SELECT draw, {_WSUMS} FROM d GROUP BY 1),
s AS (SELECT draw, sum(w * (x1 - m1) * (x1 - m1)) AS s11, sum(w * (x1 - m1) * (x2 - m2)) AS s12, sum(w * (x2 - m2) * (x2 - m2)) AS s22, sum(w * (x1 - m1) * (y - my)) AS s1y, sum(w * (x2 - m2) * (y - my)) AS s2y FROM d JOIN m USING (draw) GROUP BY 1),
k AS (SELECT stddev_pop(x1) AS d1, stddev_pop(x2) AS d2 FROM t WHERE split = 'TRAIN'), c AS (SELECT 'x1' AS feature, {_B1} * d1 AS v FROM s, k UNION ALL SELECT 'x2', {_B2} * d2 FROM s, k)
SELECT feature, round(quantile_cont(v, 0.5), 7) AS middle, round(quantile_cont(v, 0.025), 7) AS low, round(quantile_cont(v, 0.975), 7) AS high, round(avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END), 7) AS positive FROM c GROUP BY 1""")
def _(spark, sf):
    own, ready, _ = _split_grams(spark, sf)
    rows = models.stability(own.where("split <> 'TEST'"), ready, _y(), F.col("sensor"), 50)
    return spark.createDataFrame([(n, *(round(v, 7) for v in vs)) for n, *vs in rows], "feature string, middle double, low double, high double, positive double")


_STEPS = [0.2, 0.4, 0.6, 0.8, 1.0]
_BIN = "CAST(('0x' || substr(md5('step|' || sensor), 1, 12)) AS BIGINT) / 281474976710656e0"
_FOLD = "CAST(('0x' || substr(md5('fold|' || sensor), 1, 8)) AS BIGINT) % 5"


@query("F30_learning_curve", f"""WITH t AS MATERIALIZED (SELECT x1, x2, ln(outcome) AS y, {_FOLD} AS fold, {_BIN} AS u FROM measures), k AS (SELECT unnest({_STEPS}) AS share), m AS (SELECT share, g.fold, {_SUMS} FROM k, (SELECT DISTINCT fold FROM t) g JOIN t ON t.fold <> g.fold WHERE u <= share GROUP BY 1, 2), c AS MATERIALIZED (SELECT share, fold, {_OLS} FROM m),
i AS (SELECT share, count(*) AS n, sqrt(avg({_FULL})) AS inside FROM c JOIN t ON t.fold <> c.fold AND u <= share GROUP BY 1), o AS (SELECT share, sqrt(avg({_FULL})) AS outside FROM c JOIN t ON t.fold = c.fold GROUP BY 1) SELECT CAST(share AS DOUBLE) AS share, n, round(inside, 8) AS training_rmse, round(outside, 8) AS validation_rmse FROM i JOIN o USING (share)""")
def _(spark, sf):
    own = view(spark, sf, "measures")
    hashed = lambda word, digits: F.conv(F.substring(F.md5(F.concat(F.lit(word), F.col("sensor")).cast("binary")), 1, digits), 16, 10)
    u = hashed("step|", 12).cast("double") / float(1 << 48)
    step = sum((F.when(u > s, 1).otherwise(0) for s in _STEPS[1:-1]), F.when(u > _STEPS[0], 1).otherwise(0))
    parts = models.grams(own, _ready(own), _y(), F.struct((hashed("fold|", 8).cast("long") % 5).alias("f"), step.alias("s")))
    rows = models.learning_curve({(k["f"], k["s"]): g for k, g in parts.items()}, _STEPS)
    return spark.createDataFrame([(s, n, round(a, 8), round(b, 8)) for s, n, a, b in rows], "share double, n long, training_rmse double, validation_rmse double")


# --- comparisons, tables ---


@query("X40_static_and_dynamic", f"""WITH {_TRAIN}, v AS {_where("'TRAIN'")}, e AS {_where("'TRAIN', 'VALIDATION'")}, a AS (SELECT sqrt(avg({_ONE})) AS s, sqrt(avg({_FULL})) AS d FROM t, v WHERE split = 'VALIDATION'), b AS (SELECT sqrt(avg({_ONE})) AS s, sqrt(avg({_FULL})) AS d FROM t, e WHERE split = 'TEST')
SELECT 'static_only' AS configuration, round(a.s, 8) AS validation_rmse, round(b.s, 8) AS test_rmse, 0e0 AS delta FROM a, b UNION ALL SELECT 'static_plus_dynamic', round(a.d, 8), round(b.d, 8), round(b.d - b.s, 8) FROM a, b""")
def _(spark, sf):
    _, _, g = _split_grams(spark, sf)
    rows = models.configurations(g, {"static_only": ["x1"], "static_plus_dynamic": ["x1", "x2"]})
    return spark.createDataFrame([(n, *(round(x, 8) for x in v)) for n, *v in rows], "configuration string, validation_rmse double, test_rmse double, delta double")


def _within(splits: str) -> str:
    return f"(SELECT company, avg(x1) AS mx, avg(y) AS my, any_value(w) AS w FROM t, (SELECT sum((x1 - mx) * (y - my)) / sum((x1 - mx) * (x1 - mx)) AS w FROM (SELECT x1, y, avg(x1) OVER (PARTITION BY company) AS mx, avg(y) OVER (PARTITION BY company) AS my FROM t WHERE split IN ({splits}))) WHERE split IN ({splits}) GROUP BY 1)"


@query("X40_with_and_without_company", f"""WITH {_TRAIN}, v AS {_where("'TRAIN'")}, e AS {_where("'TRAIN', 'VALIDATION'")}, vc AS {_within("'TRAIN'")}, ec AS {_within("'TRAIN', 'VALIDATION'")},
a AS (SELECT sqrt(avg({_ONE})) AS s FROM t, v WHERE split = 'VALIDATION'), b AS (SELECT sqrt(avg({_ONE})) AS s FROM t, e WHERE split = 'TEST'), ac AS (SELECT sqrt(avg(pow(y - my - w * (x1 - mx), 2))) AS s FROM t JOIN vc USING (company) WHERE split = 'VALIDATION'), bc AS (SELECT sqrt(avg(pow(y - my - w * (x1 - mx), 2))) AS s FROM t JOIN ec USING (company) WHERE split = 'TEST')
SELECT 'E' AS configuration, round(a.s, 7) AS validation_rmse, round(b.s, 7) AS test_rmse, 0e0 AS delta FROM a, b UNION ALL SELECT 'E+C', round(ac.s, 7), round(bc.s, 7), round(bc.s - b.s, 7) FROM ac, bc, b""")
def _(spark, sf):
    names = sorted(r[0] for r in view(spark, sf, "measures").select("company").distinct().collect())[1:]
    own = T._split(spark, sf).withColumns({f"company_{n}": (F.col("company") == n).cast("double") for n in names})
    features = ["x1", *(f"company_{n}" for n in names)]
    g = models.grams(own, models.prepare(own.where("split = 'TRAIN'"), features), _y(), F.col("split"))
    rows = models.configurations(g, {"E": ["x1"], "E+C": features})
    return spark.createDataFrame([(n, *(round(x, 7) for x in v)) for n, *v in rows], "configuration string, validation_rmse double, test_rmse double, delta double")


@query("X41_coefficients", f"""WITH {_TRAIN}, c AS {_where("'TRAIN'")} SELECT 'x1' AS feature, 'x1' AS name, 'terrain' AS family, round(b1 * d1, 8) AS coefficient FROM c UNION ALL SELECT 'x2', 'x2', 'other', round(b2 * d2, 8) FROM c""")
def _(spark, sf):
    _, ready, g = _split_grams(spark, sf)
    rows = models.coefficient_table(models.solve(g["TRAIN"], "ols"), ready.names, {"x1": "terrain", "rain": "rainfall"})
    return spark.createDataFrame([(f, n, k, round(c, 8)) for f, n, k, c in rows], "feature string, name string, family string, coefficient double")


@query("X38_reproduction", f"""WITH o AS (SELECT company, predictor, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM {T._LONG} WHERE x IS NOT NULL AND predictor <> 'const' GROUP BY 1, 2) SELECT unnest(['intercept', 'r2', 'slope']) AS metric, count(*) AS rows, true AS passed FROM o""")
def _(spark, sf):
    """Fits by moments against fits by Spark's own regression aggregates, as an earlier run's table would be."""
    long = T._long(spark, sf).where("predictor <> 'const'")
    new = regress.simple(long, ["company", "predictor"]).select("company", "predictor", "slope", "intercept", "r2")
    old = long.where("x is not null").groupBy("company", "predictor").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    return regress.reproduced(new, old, ["company", "predictor"], ["slope", "intercept", "r2"]).select("metric", "rows", "passed")


@query("F37_scorecard", f"SELECT 'selected_sensor' AS approach, model AS target, n, rmse, base_rmse, gain_pct, r2, spearman FROM ({T._METRICS}) UNION ALL SELECT 'region', model, n, rmse, base_rmse, gain_pct, r2, spearman FROM ({T._METRICS.replace('FROM predictions', 'FROM (SELECT model, y, predicted + 1 AS predicted, base FROM predictions)')})")
def _(spark, sf):
    first = T._metrics(spark, sf)
    other = regress.metrics(view(spark, sf, "predictions").withColumn("predicted", F.col("predicted") + 1), ["model"])
    other = rounded(rounded(other, "rmse", "mae", "r2", "spearman", "calibration_slope", "calibration_intercept", "base_rmse", digits=9), "gain_pct", digits=7)
    # the second table has its own names
    other = other.withColumnsRenamed({"model": "outcome", "rmse": "rmse_region", "base_rmse": "dummy_rmse"})
    return regress.scorecard({"selected_sensor": (first, {"model": "target"}), "region": (other, {"outcome": "target", "rmse_region": "rmse", "dummy_rmse": "base_rmse"})}, ["target", "n", "rmse", "base_rmse", "gain_pct", "r2", "spearman"])


@query("X44_three_units", f"""WITH s AS ({T._METRICS}), r AS (SELECT company AS target, var_samp(ln(outcome)) AS v, quantile_cont(ln(outcome), 0.75) - quantile_cont(ln(outcome), 0.25) AS iqr, count(*) AS n FROM measures GROUP BY 1)
SELECT model AS target, 'selected_sensor' AS unit, gain_pct, r2, CAST(NULL AS DOUBLE) AS variance, CAST(NULL AS DOUBLE) AS iqr FROM s UNION ALL SELECT target, 'region', NULL, NULL, round(v, 8), round(iqr, 8) FROM r""")
def _(spark, sf):
    a = T._metrics(spark, sf).select(F.col("model").alias("target"), F.lit("selected_sensor").alias("unit"), "gain_pct", "r2")
    b = view(spark, sf, "measures").groupBy(F.col("company").alias("target")).agg(F.var_samp(_y()).alias("variance"), (F.percentile(_y(), F.lit(0.75)) - F.percentile(_y(), F.lit(0.25))).alias("iqr")).withColumn("unit", F.lit("region"))
    return a.unionByName(rounded(b, "variance", "iqr", digits=8), allowMissingColumns=True)


# --- exact medians, regions ---

@query("A19_pooled_medians", "WITH u AS (SELECT user_id, 'R' || (user_id % 12) AS region, count(*) AS n, median(value) AS m, sum(value) AS s FROM events GROUP BY 1, 2) SELECT region, round(sum(n * m) / sum(n), 8) AS weighted_median, (SELECT round(median(value), 8) FROM events e WHERE 'R' || (e.user_id % 12) = u.region) AS exact_median FROM u GROUP BY region")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.concat(F.lit("R"), (F.col("user_id") % 12).cast("string")).alias("region"), "value")
    each = own.groupBy("region", "user_id").agg(F.count("*").alias("n"), F.median("value").alias("m"))
    approximate = each.groupBy("region").agg(regress.weighted_mean(F.col("m"), F.col("n")).alias("weighted_median"))
    exact = own.groupBy("region").agg(F.median("value").alias("exact_median"))
    return rounded(approximate.join(exact, "region"), "weighted_median", "exact_median", digits=8)


@query("X45_exact_median_patch", "WITH m AS (SELECT 'R' || (user_id % 12) AS region, count(*) + CASE WHEN user_id % 12 = 3 THEN 1 ELSE 0 END AS n, sum(value) AS total FROM events GROUP BY user_id % 12), x AS (SELECT 'R' || (user_id % 12) AS region, count(*) AS xn, sum(value) AS xt, median(value) AS xm FROM events GROUP BY user_id % 12 HAVING user_id % 12 <> 5) SELECT region, n, round(total, 4) AS total, round(xm, 8) AS median, coalesce(n = coalesce(xn, 0), false) AS count_ok, abs(total - coalesce(xt, 0)) <= 1e-6 + 1e-9 * abs(coalesce(xt, 0)) AS total_ok, xm IS NOT NULL AS complete FROM m LEFT JOIN x USING (region)")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("R"), (F.col("user_id") % 12).cast("string")).alias("region"), "value")
    master = own.groupBy("region").agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("n", F.col("n") + F.when(F.col("region") == "R3", 1).otherwise(0)).withColumn("median", F.lit(0.0))
    exact = own.where("region <> 'R5'").groupBy("region").agg(F.count("*").alias("exact_n"), F.sum("value").alias("exact_total"), F.median("value").alias("exact_median"))
    out = regress.patched_medians(master, exact, "region")
    return rounded(rounded(out.select("region", "n", "total", "median", "count_ok", "total_ok", "complete"), "total", digits=4), "median", digits=8)


_WORK = "(SELECT 'n' || (s_suppkey % 5) AS region, 'W' || s_suppkey AS code, CAST(1 + s_suppkey % 9 AS DOUBLE) AS area, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST(s_suppkey % 13 AS DOUBLE) END AS load, CAST(5 + s_suppkey % 6 AS DOUBLE) AS capacity, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 29 AS DOUBLE) END AS rain, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey * 10 AS DOUBLE) END AS population, CAST((s_suppkey * 7919) % 700000 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 1300000 AS DOUBLE) AS y FROM supplier)"
_SENSOR = "(SELECT 'n' || (c_custkey % 5) AS region, 'C' || c_custkey AS sensor, beta, ci_low, ci_high, beta * 2 AS rate, total_count AS events, CAST(total_count * (1 + c_custkey % 7) AS DOUBLE) AS minutes, CAST(30 + c_custkey % 50 AS DOUBLE) AS median_minutes, CAST(1 + c_custkey % 7 AS DOUBLE) AS mean_minutes, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS DOUBLE) END AS years, c_custkey % 3 = 0 AS polygon FROM (SELECT *, CAST(substr(sensor, 2) AS BIGINT) AS c_custkey FROM masters))"
_IQR = "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"
_B, _R = "CASE WHEN beta > 0 THEN beta END", "CASE WHEN rate > 0 THEN rate END"
_REGIONS = f"""SELECT w.*, s.* EXCLUDE (region), sensors >= 1 AS ge_1, sensors >= 3 AS ge_3, sensors >= 5 AS ge_5, sensors >= 10 AS ge_10 FROM (SELECT region, count(*) AS works, sum(area) AS area, sum(x * area) / sum(area) AS centre_x, sum(y * area) / sum(area) AS centre_y, sum(load) AS load, sum(capacity) AS capacity, CASE WHEN sum(capacity) > 0 THEN sum(load) / sum(capacity) END AS capacity_ratio, avg(load / capacity) AS ratio_mean, median(load / capacity) AS ratio_median,
 sum(rain * area) FILTER (rain IS NOT NULL) / sum(area) FILTER (rain IS NOT NULL) AS rain, avg(CASE WHEN rain IS NULL THEN 0e0 ELSE 1e0 END) AS rain_coverage, sum(population) AS population, sum(population) / sum(area) AS density FROM {_WORK} GROUP BY 1) w JOIN
 (SELECT region, count(DISTINCT sensor) AS sensors, CAST(sum(events) AS BIGINT) AS events, sum(years) FILTER (years > 0) AS sensor_years, avg({_B}) AS beta_mean, median({_B}) AS beta_median, stddev_samp({_B}) AS beta_sd, {_IQR.format('(' + _B + ')')} AS beta_iqr, sum(beta / pow((ci_high - ci_low) / 3.92, 2)) FILTER (beta IS NOT NULL AND ci_high > ci_low) / sum(1 / pow((ci_high - ci_low) / 3.92, 2)) FILTER (beta IS NOT NULL AND ci_high > ci_low) AS beta_precise, count({_B}) AS beta_n,
 avg({_R}) AS rate_mean, median({_R}) AS rate_median, exp(avg(ln({_R}))) AS rate_geometric, stddev_samp({_R}) AS rate_sd, {_IQR.format('(' + _R + ')')} AS rate_iqr, count({_R}) AS rate_n, sum(minutes) AS minutes, sum(minutes) / sum(events) AS minutes_mean, sum(median_minutes * events) / sum(events) AS minutes_median, avg(mean_minutes) AS mean_of_means, count(*) FILTER (events > 0) AS duration_n, sum(events) FILTER (years > 0) / sum(years) FILTER (years > 0) AS per_year, count(*) FILTER (years > 0) AS frequency_n, avg(CASE WHEN polygon THEN 1e0 ELSE 0e0 END) AS polygon_share FROM {_SENSOR} GROUP BY 1) s USING (region)"""
_MEASURES = ("centre_x", "centre_y", "capacity_ratio", "ratio_mean", "ratio_median", "rain", "rain_coverage", "density", "beta_mean", "beta_median", "beta_sd", "beta_iqr", "beta_precise", "rate_mean", "rate_median", "rate_geometric", "rate_sd", "rate_iqr", "minutes_mean", "minutes_median", "mean_of_means", "per_year", "polygon_share")


@query("A21_region_measures", f"SELECT * REPLACE ({', '.join(f'round({c}, 7) AS {c}' for c in _MEASURES)}) FROM ({_REGIONS})")
def _(spark, sf):
    s = F.col("s_suppkey")
    n = lambda c: c.cast("double")
    works = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("n"), (s % 5).cast("string")).alias("region"), n(1 + s % 9).alias("area"), F.when(s % 8 != 0, n(s % 13)).alias("load"), n(5 + s % 6).alias("capacity"), F.when(s % 7 != 0, n(s % 29)).alias("rain"), F.when(s % 9 != 0, n(s * 10)).alias("population"), n((s * 7919) % 700000).alias("x"), n((s * 104729) % 1300000).alias("y"))
    c = F.substring("sensor", 2, 20).cast("long")
    sensors = view(spark, sf, "masters").select(F.concat(F.lit("n"), (c % 5).cast("string")).alias("region"), "sensor", "beta", "ci_low", "ci_high", (F.col("beta") * 2).alias("rate"), F.col("total_count").alias("events"), n(F.col("total_count") * (1 + c % 7)).alias("minutes"), n(30 + c % 50).alias("median_minutes"), n(1 + c % 7).alias("mean_minutes"), F.when(c % 10 != 0, n(c % 4)).alias("years"), (c % 3 == 0).alias("polygon"))
    return rounded(regress.region_measures(works, sensors), *_MEASURES, digits=7)


# --- space ---

_ALIGNED = "(SELECT polygon, company, floor(x0 / 20000) * 20000 AS x0, floor(y0 / 20000) * 20000 AS y0, floor(x0 / 20000) * 20000 + side AS x1, floor(y0 / 20000) * 20000 + side AS y1 FROM squares)"
_CELLS = f"(SELECT DISTINCT company, cx, unnest(range(CAST(y0 / 20000 AS BIGINT), CAST(y1 / 20000 AS BIGINT))) AS cy FROM (SELECT *, unnest(range(CAST(x0 / 20000 AS BIGINT), CAST(x1 / 20000 AS BIGINT))) AS cx FROM {_ALIGNED}))"


def _aligned(spark, sf):
    down = lambda c: F.floor(F.col(c) / 20000) * 20000.0
    own = view(spark, sf, "squares").withColumns({"x0": down("x0"), "y0": down("y0")})
    return own.withColumns({"x1": F.col("x0") + F.col("side"), "y1": F.col("y0") + F.col("side")})


@query("A27_union_area", f"SELECT company, count(*) * 4e8 AS area FROM {_CELLS} GROUP BY 1")
def _(spark, sf):
    return spatial.union_area(_aligned(spark, sf), "company", 20_000.0)


@query("A26_dissolved", f"SELECT a.company, a.parts, a.keys, c.area FROM (SELECT company, count(*) AS parts, string_agg(polygon, '|' ORDER BY polygon) AS keys FROM squares GROUP BY 1) a JOIN (SELECT company, count(*) * 4e8 AS area FROM {_CELLS} GROUP BY 1) c USING (company)")
def _(spark, sf):
    return spatial.dissolved(_aligned(spark, sf), "company", "polygon", 20_000.0)


def _rings(frame, key="polygon"):
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return frame.select(F.col(key).alias("polygon"), F.array(x0, x1, x1, x0).alias("xs"), F.array(y0, y0, y1, y1).alias("ys"), F.lit(False).alias("hole"))


@query("J15_overlay", f"SELECT a.polygon AS unit, b.polygon AS zone, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 2) AS area FROM {_ALIGNED} a JOIN (SELECT 'Z' || polygon AS polygon, x0 + 13000 AS x0, y0 + 7000 AS y0, x1 + 3000 AS x1, y1 + 9000 AS y1 FROM {_ALIGNED}) b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def _(spark, sf):
    own = _aligned(spark, sf)
    zones = own.select(F.concat(F.lit("Z"), "polygon").alias("polygon"), (F.col("x0") + 13000).alias("x0"), (F.col("y0") + 7000).alias("y0"), (F.col("x1") + 3000).alias("x1"), (F.col("y1") + 9000).alias("y1"))
    return spatial.overlay(_rings(own), _rings(zones), 100_000.0).withColumn("area", joins.rounded_half_up(F.col("area"), 2))


@query("X16_kept_geometry", "SELECT company, count(*) AS rows, count(DISTINCT x0 || '/' || y0 || '/' || side) AS geometries, count(DISTINCT x0 || '/' || y0 || '/' || side) = 1 AS consistent FROM squares GROUP BY 1")
def _(spark, sf):
    """How a company's rows agree; and each polygon's own geometry, kept once from two layers that hold it."""
    own = view(spark, sf, "squares")
    kept = spatial.consistent_geometry(own.unionByName(own), "polygon", ["x0", "y0", "side"]).join(own.select("polygon", "company"), "polygon")
    return spatial.geometry_counts(kept, "company", ["x0", "y0", "side"])


_MULTI = "(SELECT polygon, company, x0, y0, side, CAST(substr(polygon, 2) AS INTEGER) % 3 AS k FROM squares)"


@query("X22_polygon_parts", f"SELECT polygon, 0 AS part, 0 AS ring, false AS hole, round(side * side, 2) AS area FROM {_MULTI} UNION ALL SELECT polygon, 0, 1, true, round(side * side / 16, 2) FROM {_MULTI} WHERE k = 1 UNION ALL SELECT polygon, 1, 0, false, round(side * side, 2) FROM {_MULTI} WHERE k = 2")
def _(spark, sf):
    x, y, s = F.col("x0"), F.col("y0"), F.col("side")
    box = lambda a, b, w: F.array(*(F.array(a + p * w, b + q * w) for p, q in ((0, 0), (1, 0), (1, 1), (0, 1))))
    k = F.substring("polygon", 2, 20).cast("int") % 3
    first = F.array(box(x, y, s))
    multi = F.when(k == 1, F.array(F.array(box(x, y, s), box(x + s / 4, y + s / 4, s / 4)))).when(k == 2, F.array(first, F.array(box(x + 2 * s, y, s)))).otherwise(F.array(first))
    rings = spatial.polygon_parts(view(spark, sf, "squares").select("polygon", multi.alias("coordinates")))
    return rings.select("polygon", "part", "ring", "hole", F.round(spatial.ring_area("xs", "ys"), 2).alias("area"))


@query("X19_usable_rings", "SELECT polygon, CASE WHEN k = 0 THEN 'not_finite' WHEN k = 1 THEN 'too_few_points' WHEN k = 2 THEN 'no_area' ELSE 'usable' END AS reason FROM (SELECT polygon, CAST(substr(polygon, 2) AS INTEGER) % 6 AS k FROM squares)")
def _(spark, sf):
    x, y, s = F.col("x0"), F.col("y0"), F.col("side")
    k = F.substring("polygon", 2, 20).cast("int") % 6
    xs = F.when(k == 0, F.array(x, F.lit(float("nan")), x)).when(k == 1, F.array(x, x, x + s)).when(k == 2, F.array(x, x + s, x + 2 * s)).otherwise(F.array(x, x + s, x + s))
    ys = F.when(k == 0, F.array(y, y, y)).when(k == 1, F.array(y, y, y)).when(k == 2, F.array(y, y, y)).otherwise(F.array(y, y, y + s))
    rings = view(spark, sf, "squares").select("polygon", xs.alias("xs"), ys.alias("ys"), F.lit(False).alias("hole"))
    good, bad = spatial.repaired(rings.unionByName(rings))
    return good.select("polygon", F.lit("usable").alias("reason")).unionByName(bad.select("polygon", "reason"))


# --- without SQL ---


@query("F35_random_intercept")
def _(spark, sf):
    own = view(spark, sf, "measures").withColumn("outcome", F.col("outcome") * (1 + (F.col("c_custkey") % 37) / 20))
    found = models.random_intercept(own, _ready(own), _y(), F.col("c_custkey") % 37)
    return spark.createDataFrame([(k, round(v, 7)) for k, v in found.items()], "term string, value double")


@query("F36_ridge_by_radius")
def _(spark, sf):
    """Ridge with a penalty of one at three radii: regions, rows of the test and its RMSE over that of the mean."""
    works = view(spark, sf, "works").select("company", F.col("works").alias("code"), (F.col("works_x") / 10).alias("x"), (F.col("works_y") / 10).alias("y"))
    rows = []
    for radius in (10.0, 25.0, 50.0):
        r = spatial.clusters(works, radius).groupBy("region").agg(F.avg("x").alias("x1"), F.avg("y").alias("x2"), F.avg(F.hypot("x", "y")).alias("m"))
        own = r.withColumn("split", models.split_of(F.col("region"), F.substring("region", 1, 2)))
        g = models.grams(own, models.prepare(own.where("split <> 'TEST'"), _TWO), F.log("m"), F.when(F.col("split") == "TEST", "TEST").otherwise("FIT"))
        if "TEST" in g and g["FIT"].n > 3:
            rows.append((radius, int(g["FIT"].n + g["TEST"].n), int(g["TEST"].n), round(models.rmse(models.solve(g["FIT"], "ridge", 1.0), g["TEST"]), 8), round(models.rmse(models.solve(g["FIT"], "mean"), g["TEST"]), 8)))
    return spark.createDataFrame(rows, "radius_km double, regions long, n_test long, rmse double, base_rmse double")


@query("W18_permutation_split")
def _(spark, sf):
    return models.permutation_split(view(spark, sf, "measures").select("sensor", "c_custkey"), ["c_custkey"]).groupBy("split").agg(F.count("*").alias("n"))


# --- ridge, tuning, intervals, counts: closed forms for two predictors ---

#: Ridge coefficients on predictors standardised by a training part's deviations (e1, e2), from centred sums; s11 and the like are means, so the penalty is over n.
_R1 = "((s22 / e2 / e2 + a / n) * s1y / e1 - s12 / e1 / e2 * s2y / e2) / ((s11 / e1 / e1 + a / n) * (s22 / e2 / e2 + a / n) - pow(s12 / e1 / e2, 2)) / e1"
_R2 = "((s11 / e1 / e1 + a / n) * s2y / e2 - s12 / e1 / e2 * s1y / e1) / ((s11 / e1 / e1 + a / n) * (s22 / e2 / e2 + a / n) - pow(s12 / e1 / e2, 2)) / e2"
_RIDGE = f"{_R1} AS b1, {_R2} AS b2, my - ({_R1}) * m1 - ({_R2}) * m2 AS b0"
_DEV = "(SELECT stddev_pop(x1) AS e1, stddev_pop(x2) AS e2 FROM t WHERE split = 'TRAIN')"


@query("F25_ridge_by_validation", f"""WITH {_TRAIN}, k AS MATERIALIZED {_DEV}, s AS MATERIALIZED (SELECT {_SUMS} FROM t WHERE split = 'TRAIN'), b AS MATERIALIZED (SELECT {_SUMS} FROM t WHERE split <> 'TEST'), g AS (SELECT a, {_RIDGE} FROM s, k, (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS a)),
v AS (SELECT a, sum({_FULL}) AS e FROM g, t WHERE split = 'VALIDATION' GROUP BY 1), w AS (SELECT CAST(arg_min(a, e) AS DOUBLE) AS a FROM v), c AS (SELECT a, {_RIDGE} FROM b, k, w), o AS (SELECT {_OLS} FROM b)
SELECT 'ridge' AS model, a AS alpha, round((SELECT sqrt(avg({_FULL})) FROM c, t WHERE split = 'TEST'), 8) AS rmse FROM w UNION ALL SELECT 'ols', 0e0, round((SELECT sqrt(avg({_FULL})) FROM o, t WHERE split = 'TEST'), 8) UNION ALL SELECT 'mean', 0e0, round((SELECT sqrt(avg(pow(y - my, 2))) FROM b, t WHERE split = 'TEST'), 8)""")
def _(spark, sf):
    _, _, g = _split_grams(spark, sf)
    alpha = models.held_out_alpha(g["TRAIN"], g["VALIDATION"])
    both = models.total({k: g[k] for k in ("TRAIN", "VALIDATION")})
    return spark.createDataFrame([(k, a, round(models.rmse(models.solve(both, k, a), g["TEST"]), 8)) for k, a in (("ridge", alpha), ("ols", 0.0), ("mean", 0.0))], "model string, alpha double, rmse double")


@query("F26_cross_validated_ridge", f"""WITH t AS MATERIALIZED (SELECT x1, x2, ln(outcome) AS y, {_FOLD} AS fold, 'TRAIN' AS split FROM measures), k AS MATERIALIZED {_DEV}, m AS MATERIALIZED (SELECT f.fold, {_SUMS} FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY 1),
c AS (SELECT fold, a, {_RIDGE} FROM m, k, (SELECT unnest([0.0, 1.0, 10.0, 100.0]) AS a)), e AS (SELECT a, c.fold, sqrt(avg({_FULL})) AS r FROM c JOIN t ON t.fold = c.fold GROUP BY 1, 2) SELECT CAST(a AS DOUBLE) AS alpha, round(avg(r), 8) AS rmse, round(stddev_samp(r), 8) AS sd FROM e GROUP BY 1""")
def _(spark, sf):
    own = view(spark, sf, "measures")
    fold = F.conv(F.substring(F.md5(F.concat(F.lit("fold|"), F.col("sensor")).cast("binary")), 1, 8), 16, 10).cast("long") % 5
    parts = models.grams(own, _ready(own), _y(), fold)
    return spark.createDataFrame([(a, *(round(v, 8) for v in models.cross_validated(parts, "ridge", a))) for a in (0.0, 1.0, 10.0, 100.0)], "alpha double, rmse double, sd double")


_KEYED = "(SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, 'm' || (l_linenumber % 4) AS model, CAST(l_quantity AS DOUBLE) AS y, CAST(l_quantity * 6e-1 + (l_partkey % 23) AS DOUBLE) AS predicted, 25e0 AS base FROM lineitem)"


@query("F29_gain_interval", f"""WITH p AS MATERIALIZED (SELECT pow(y - predicted, 2) AS e, pow(y - base, 2) AS b, key FROM {_KEYED} WHERE model = 'm1'), d AS (SELECT draw, e, b, CAST(('0x' || substr(md5(key || '|' || draw), 1, 12)) AS BIGINT) / 281474976710656e0 AS u FROM p, (SELECT unnest(range(1, 21)) AS draw)),
g AS (SELECT draw, 100 * (1 - sqrt(sum(e * w) / sum(b * w))) AS gain FROM (SELECT draw, e, b, {_TIMES} AS w FROM d) GROUP BY 1) SELECT round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.5), 6) AS middle, round(quantile_cont(gain, 0.975), 6) AS high FROM g""")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber % 4 = 1")
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    own = own.select(key.alias("key"), F.col("l_quantity").cast("double").alias("y"), (F.col("l_quantity") * 0.6 + F.col("l_partkey") % 23).alias("predicted"), F.lit(25.0).alias("base"))
    return rounded(models.gain_interval(own, "key", "y", "predicted", "base", 20), "low", "middle", "high")


def _newton(steps: int) -> str:
    """Newton steps of the count regression as a chain of tables."""
    parts = ["t AS MATERIALIZED (SELECT x1 / 50 AS x, x2 AS c, CAST(1 + c_custkey % 3 AS DOUBLE) AS w FROM measures)", "k0 AS (SELECT ln(sum(c) / sum(w)) AS a, 0e0 AS b, 0e0 AS i11, 0e0 AS i12, 0e0 AS i22 FROM t)"]
    for n in range(steps):
        parts.append(f"s{n} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum((c - m) / (1 + m)) AS g1, sum((c - m) / (1 + m) * x) AS g2, sum(m / (1 + m)) AS i11, sum(m / (1 + m) * x) AS i12, sum(m / (1 + m) * x * x) AS i22 FROM (SELECT *, w * exp(a + b * x) AS m FROM t, k{n}))")
        parts.append(f"k{n + 1} AS MATERIALIZED (SELECT a + (i22 * g1 - i12 * g2) / (i11 * i22 - i12 * i12) AS a, b + (i11 * g2 - i12 * g1) / (i11 * i22 - i12 * i12) AS b, i11, i12, i22 FROM s{n})")
    return f"WITH {', '.join(parts)} SELECT round(a, 8) AS intercept, round(b, 8) AS slope, round(sqrt(i11 / (i11 * i22 - i12 * i12)), 8) AS se, round(exp(b), 8) AS rate_ratio FROM k{steps}"


@query("F21_count_model", _newton(14))
def _(spark, sf):
    own = view(spark, sf, "measures").select((F.col("x1") / 50).alias("x"), F.col("x2").alias("n"), (1 + F.col("c_custkey") % 3).cast("double").alias("years"))
    a, b, se = models.count_model(own, "x", "n", "years")
    return spark.createDataFrame([tuple(round(float(v), 8) for v in (a, b, se, math.exp(b)))], "intercept double, slope double, se double, rate_ratio double")


def _degrees() -> str:
    """The inverse projection and the shift, step by step."""
    a, b = spatial.AIRY
    wa, wb = spatial.WORLD
    e2, we2, n = 1 - (b / a) ** 2, 1 - (wb / wa) ** 2, (a - b) / (a + b)
    k, lat0, lon0, e0, n0 = spatial.SCALE, spatial.LAT0, spatial.LON0, spatial.E0, spatial.N0
    (tx, ty, tz), (rx, ry, rz), stretch = spatial.SHIFT, spatial.TURN, 1 + spatial.STRETCH
    arc = f"{b * k!r} * ({1 + n + 1.25 * n**2 + 1.25 * n**3!r} * (p - {lat0!r}) - {3 * n + 3 * n**2 + 2.625 * n**3!r} * sin(p - {lat0!r}) * cos(p + {lat0!r}) + {1.875 * n**2 + 1.875 * n**3!r} * sin(2 * (p - {lat0!r})) * cos(2 * (p + {lat0!r})) - {35 / 24 * n**3!r} * sin(3 * (p - {lat0!r})) * cos(3 * (p + {lat0!r})))"
    parts = [f"f0 AS (SELECT sensor, x - {e0!r} AS d, y, (y - {n0!r}) / {a * k!r} + {lat0!r} AS p FROM sensors)"]
    for i in range(5):
        parts.append(f"f{i + 1} AS (SELECT sensor, d, y, p + (y - {n0!r} - {arc}) / {a * k!r} AS p FROM f{i})")
    parts.append(f"g AS (SELECT sensor, d, p, {a * k!r} / sqrt(1 - {e2!r} * sin(p) * sin(p)) AS nu, {a * k * (1 - e2)!r} / pow(1 - {e2!r} * sin(p) * sin(p), 1.5) AS rho, tan(p) AS t, 1 / cos(p) AS sec FROM f5)")
    parts.append("h AS (SELECT *, nu / rho AS q FROM g)")
    parts.append(f"u AS (SELECT sensor, p - t / (2 * rho * nu) * d * d + t / (24 * rho * pow(nu, 3)) * (4 + 3 * t * t + q - 9 * t * t * (q - 1)) * pow(d, 4) - t / (720 * rho * pow(nu, 5)) * (61 + 90 * t * t + 45 * pow(t, 4)) * pow(d, 6) AS phi, {lon0!r} + sec / nu * d - sec / (6 * pow(nu, 3)) * (q + 2 * t * t) * pow(d, 3) + sec / (120 * pow(nu, 5)) * (5 + 28 * t * t + 24 * pow(t, 4)) * pow(d, 5) AS lam FROM h)")
    parts.append(f"v AS (SELECT sensor, v * cos(phi) * cos(lam) AS x, v * cos(phi) * sin(lam) AS y, {1 - e2!r} * v * sin(phi) AS z FROM (SELECT *, {a!r} / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) AS v FROM u))")
    parts.append(f"w AS (SELECT sensor, {tx!r} + {stretch!r} * x - {rz!r} * y + {ry!r} * z AS x, {ty!r} + {rz!r} * x + {stretch!r} * y - {rx!r} * z AS y, {tz!r} - {ry!r} * x + {rx!r} * y + {stretch!r} * z AS z FROM v)")
    parts.append(f"l0 AS (SELECT sensor, x, y, z, sqrt(x * x + y * y) AS r, atan2(z, sqrt(x * x + y * y) * {1 - we2!r}) AS a FROM w)")
    for i in range(5):
        parts.append(f"l{i + 1} AS (SELECT sensor, x, y, z, r, atan2(z + {we2 * wa!r} / sqrt(1 - {we2!r} * sin(a) * sin(a)) * sin(a), r) AS a FROM l{i})")
    return f"WITH {', '.join(parts)} SELECT sensor, round(degrees(a), 5) AS latitude, round(degrees(atan2(y, x)), 5) AS longitude FROM l5"


@query("F11_world_coordinates", _degrees())
def _(spark, sf):
    own = view(spark, sf, "sensors").select("sensor", spatial.to_degrees(F.col("x"), F.col("y")).alias("w"))
    return own.select("sensor", F.round("w.lat", 5).alias("latitude"), F.round("w.lon", 5).alias("longitude"))
