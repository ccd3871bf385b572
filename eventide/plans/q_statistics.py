"""Queries on statistics and models: regressions, discovery control, metrics, splits, linear models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import models, regress
from .adapters import view
from .registry import query, rounded

_LONG = "(SELECT company, 'x1' AS predictor, x1 AS x, ln(outcome) AS y FROM measures UNION ALL SELECT company, 'x2', x2, ln(outcome) FROM measures UNION ALL SELECT company, 'x3', x3, ln(outcome) FROM measures UNION ALL SELECT company, 'const', 1e0, ln(outcome) FROM measures)"
_FIT = f"""(SELECT m.*, sqrt(meat) / sxx AS se, sse FROM (SELECT *, CASE WHEN usable THEN sxy / sxx END AS slope FROM (SELECT *, n >= 3 AND sxx > 0 AS usable FROM (SELECT company, predictor, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM {_LONG} WHERE x IS NOT NULL GROUP BY 1, 2))) m
 LEFT JOIN (SELECT company, predictor, sum(d * d * e * e / ((1 - h) * (1 - h))) AS meat, sum(e * e) AS sse FROM (SELECT l.company, l.predictor, l.x - mx AS d, l.y - my - slope * (l.x - mx) AS e, 1.0 / n + (l.x - mx) * (l.x - mx) / sxx AS h
  FROM {_LONG} l JOIN (SELECT *, sxy / sxx AS slope FROM (SELECT company, predictor, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM {_LONG} WHERE x IS NOT NULL GROUP BY 1, 2) WHERE sxx > 0) g ON l.company = g.company AND l.predictor = g.predictor WHERE l.x IS NOT NULL) GROUP BY 1, 2) s ON m.company = s.company AND m.predictor = s.predictor)"""


def _long(spark, sf):
    own = view(spark, sf, "measures")
    cases = [F.struct(F.lit(p).alias("predictor"), (F.lit(1.0) if p == "const" else F.col(p)).alias("x")) for p in ("x1", "x2", "x3", "const")]
    return own.select("company", F.log("outcome").alias("y"), F.explode(F.array(*cases)).alias("c")).select("company", "y", "c.*")


@query("F17_F18_univariate", f"""SELECT company, predictor, n, round(slope, 9) AS slope, round(my - slope * mx, 9) AS intercept, round(se, 9) AS se, round(slope - 1.959963984540054 * se, 9) AS ci_low, round(slope + 1.959963984540054 * se, 9) AS ci_high, round(1 - sse / syy, 9) AS r2, round(1 - (sse / syy) * (n - 1) / (n - 2), 9) AS adjusted_r2,
 round(CASE WHEN sxx > 0 THEN sxy / sqrt(sxx * syy) END, 9) AS pearson, round(100 * (exp(slope) - 1), 7) AS effect_pct, CASE WHEN usable THEN 'ok' ELSE 'constant_predictor' END AS status FROM {_FIT}""")
def _(spark, sf):
    out = regress.simple(_long(spark, sf), ["company", "predictor"]).drop("p")
    return rounded(rounded(out, "slope", "intercept", "se", "ci_low", "ci_high", "r2", "adjusted_r2", "pearson", digits=9), "effect_pct", digits=7)


#: The two-sided normal p-value of slope / se: erf by its series of positive terms, each from log-gammas.
_NORMAL = "CASE WHEN slope IS NULL OR se IS NULL OR se = 0 THEN NULL WHEN slope = 0 THEN 1e0 WHEN abs(slope / se) > 9 THEN 0e0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 250), lambda k: exp(k * ln(4) + lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(abs(slope / se) / sqrt(2)) - pow(slope / se, 2) / 2))) END"
_GRID = f"""WITH f AS MATERIALIZED (SELECT company, predictor, n, CASE WHEN usable THEN slope END AS slope, {_NORMAL} AS p, CASE WHEN usable THEN 'ok' ELSE 'constant_predictor' END AS status FROM {_FIT}),
r AS (SELECT *, p * count(p) OVER (PARTITION BY predictor) / count(p) OVER (PARTITION BY predictor ORDER BY p NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM f),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY predictor ORDER BY p DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM r)
SELECT company, predictor, n, round(slope, 9) AS slope, round(p, 9) AS p, round(q, 9) AS q, CASE WHEN q < 0.05 THEN 'FDR-supported' WHEN p < 0.05 THEN 'nominal' ELSE 'no clear evidence' END || ', ' || CASE WHEN slope > 0 THEN 'positive' WHEN slope < 0 THEN 'negative' ELSE 'flat' END AS evidence, status FROM q"""


@query("X37_X42_fit_grid_with_fdr", _GRID)
def _(spark, sf):
    out = regress.false_discovery(regress.simple(_long(spark, sf), ["company", "predictor"]), ["predictor"])
    return out.withColumn("evidence", regress.evidence(F.col("p"), F.col("q"), F.col("slope"))).select("company", "predictor", "n", F.round("slope", 9).alias("slope"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"), "evidence", "status")


_P = "(SELECT company, sensor, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE ((c_custkey * 7919) % 1000) / 1e3 END AS p FROM measures)"


@query("W17_false_discovery", f"""SELECT company, sensor, round(q, 9) AS q FROM (SELECT company, sensor, p, CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY company ORDER BY p DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM (SELECT *, p * count(p) OVER (PARTITION BY company) / count(p) OVER (PARTITION BY company ORDER BY p NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM {_P}))""")
def _(spark, sf):
    own = view(spark, sf, "measures").select("company", "sensor", F.when(F.col("c_custkey") % 50 != 0, ((F.col("c_custkey") * 7919) % 1000) / 1e3).alias("p"))
    return rounded(regress.false_discovery(own, ["company"]).select("company", "sensor", "q"), "q", digits=9)


@query("F19_evidence_labels", f"SELECT CASE WHEN p < 0.02 THEN 'FDR-supported' WHEN p < 0.05 THEN 'nominal' ELSE 'no clear evidence' END || ', ' || CASE WHEN company = 'n0' THEN 'flat' WHEN company = 'n1' THEN 'negative' ELSE 'positive' END AS label, count(*) AS n FROM {_P} GROUP BY 1")
def _(spark, sf):
    p = F.when(F.col("c_custkey") % 50 != 0, ((F.col("c_custkey") * 7919) % 1000) / 1e3)
    slope = F.when(F.col("company") == "n0", 0.0).when(F.col("company") == "n1", -1.0).otherwise(1.0)
    own = view(spark, sf, "measures").select(p.alias("p"), F.when(p < 0.02, 0.01).otherwise(0.5).alias("q"), slope.alias("s"))
    return own.groupBy(regress.evidence(F.col("p"), F.col("q"), F.col("s")).alias("label")).agg(F.count("*").alias("n"))


def _ranked(c: str, where: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def _correlation(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(u, v), 9) AS pearson, round(corr(ru, rv), 9) AS spearman FROM (SELECT {a} AS u, {b} AS v, {_ranked(a, '')} AS ru, {_ranked(b, '')} AS rv FROM measures WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


_NAMES = ["x1", "x2", "x3", "outcome"]
_CORRELATIONS = " UNION ALL ".join(_correlation(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :])


@query("A33_correlations", _CORRELATIONS)
def _(spark, sf):
    return rounded(regress.correlations(view(spark, sf, "measures"), _NAMES), "pearson", "spearman", digits=9)


@query("A34_strong_pairs", f"SELECT a, b, pearson FROM ({_CORRELATIONS}) WHERE abs(pearson) >= 0.5")
def _(spark, sf):
    return rounded(regress.strong_pairs(regress.correlations(view(spark, sf, "measures"), _NAMES), 0.5).select("a", "b", "pearson"), "pearson", digits=9)


@query("A35_overdispersion", "SELECT company, round(var_samp(x1) / avg(x1), 9) AS ratio FROM measures GROUP BY 1")
def _(spark, sf):
    return view(spark, sf, "measures").groupBy("company").agg(F.round(F.var_samp("x1") / F.avg("x1"), 9).alias("ratio"))


_METRICS = f"""SELECT model, count(*) AS n, round(sqrt(avg((y - predicted) * (y - predicted))), 9) AS rmse, round(avg(abs(y - predicted)), 9) AS mae, round(1 - sum((y - predicted) * (y - predicted)) / (var_pop(y) * count(*)), 9) AS r2, round(corr(ry, rp), 9) AS spearman, round(regr_slope(y, predicted), 9) AS calibration_slope, round(regr_intercept(y, predicted), 9) AS calibration_intercept,
 round(sqrt(avg((y - base) * (y - base))), 9) AS base_rmse, round(100 * (sqrt(avg((y - base) * (y - base))) - sqrt(avg((y - predicted) * (y - predicted)))) / sqrt(avg((y - base) * (y - base))), 7) AS gain_pct
 FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY model ORDER BY predicted) + (count(*) OVER (PARTITION BY model, predicted) - 1) / 2.0 AS rp FROM predictions) GROUP BY 1"""


def _metrics(spark, sf):
    out = regress.metrics(view(spark, sf, "predictions"), ["model"])
    return rounded(rounded(out, "rmse", "mae", "r2", "spearman", "calibration_slope", "calibration_intercept", "base_rmse", digits=9), "gain_pct", digits=7)


@query("F28_F38_metrics", _METRICS)
def _(spark, sf):
    return _metrics(spark, sf)


@query("F34_verdicts", f"SELECT model, CASE WHEN gain_pct > 10 AND gain_pct - 5 > 0 AND r2 > 0 THEN 'STRONG / USEFUL PREDICTIVE SIGNAL' WHEN gain_pct > 0 AND r2 > 0 AND gain_pct - 5 > -2 THEN 'MODEST / QUALIFIED SIGNAL' WHEN gain_pct > 0 AND r2 > -0.05 THEN 'WEAK / INCONCLUSIVE' ELSE 'NO DEMONSTRATED PREDICTIVE SKILL' END AS verdict FROM ({_METRICS})")
def _(spark, sf):
    return _metrics(spark, sf).select("model", models.verdict(F.col("gain_pct"), F.col("gain_pct") - 5, F.col("r2")).alias("verdict"))


@query("X39_wide_summary", "SELECT company, round(avg(x1), 6) AS x1, round(avg(x2), 6) AS x2, round(avg(x3), 6) AS x3 FROM measures GROUP BY 1")
def _(spark, sf):
    long = _long(spark, sf).where("predictor <> 'const'")
    return rounded(long.groupBy("company").pivot("predictor", ["x1", "x2", "x3"]).avg("x"), "x1", "x2", "x3")


_SPLIT = "(SELECT *, CASE WHEN place <= 0.15 THEN 'TEST' WHEN place <= 0.3 THEN 'VALIDATION' ELSE 'TRAIN' END AS split FROM (SELECT *, (row_number() OVER (PARTITION BY company ORDER BY sha256('42|' || sensor), sensor) - 0.5) / count(*) OVER (PARTITION BY company) AS place FROM measures))"


def _split(spark, sf):
    return view(spark, sf, "measures").withColumn("split", models.split_of(F.col("sensor"), F.col("company")))


@query("W19_stratified_split", f"SELECT company, split, count(*) AS n FROM {_SPLIT} GROUP BY 1, 2")
def _(spark, sf):
    return _split(spark, sf).groupBy("company", "split").agg(F.count("*").alias("n"))


@query("A32_split_balance", f"SELECT split, count(x1) AS n, round(avg(x1), 6) AS mean, round(stddev_samp(x1), 6) AS sd, " + ", ".join(f"round(quantile_cont(x1, {q}), 6) AS q{int(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + f" FROM {_SPLIT} GROUP BY 1")
def _(spark, sf):
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    own = _split(spark, sf).groupBy("split").agg(F.count("x1").alias("n"), F.round(F.avg("x1"), 6).alias("mean"), F.round(F.stddev_samp("x1"), 6).alias("sd"), F.percentile("x1", F.array(*map(F.lit, qs))).alias("q"))
    return own.select("split", "n", "mean", "sd", *(F.round(F.col("q")[k], 6).alias(f"q{int(100 * q):02d}") for k, q in enumerate(qs)))


@query("W16_quantile_bins", "SELECT sensor, CAST((outcome > q1)::INT + (q2 > q1 AND outcome > q2)::INT + (q3 > q2 AND outcome > q3)::INT + (q4 > q3 AND outcome > q4)::INT AS INTEGER) AS bin FROM measures, (SELECT quantile_cont(outcome, 0.2) AS q1, quantile_cont(outcome, 0.4) AS q2, quantile_cont(outcome, 0.6) AS q3, quantile_cont(outcome, 0.8) AS q4 FROM measures)")
def _(spark, sf):
    return models.quantile_bins(view(spark, sf, "measures"), "outcome", 5).select("sensor", "bin")


@query("F22_F23_preprocessing", f"""SELECT sensor, round((log1p(x1) - m1) / s1, 6) AS x1, round((coalesce(x3, med) - m3) / s3, 6) AS x3, round((CASE WHEN x3 IS NULL THEN 1 ELSE 0 END - mi) / si, 6) AS x3__missing FROM {_SPLIT}, (SELECT avg(log1p(x1)) AS m1, stddev_pop(log1p(x1)) AS s1, avg(coalesce(x3, med)) AS m3, stddev_pop(coalesce(x3, med)) AS s3, avg(CASE WHEN x3 IS NULL THEN 1e0 ELSE 0e0 END) AS mi, stddev_pop(CASE WHEN x3 IS NULL THEN 1e0 ELSE 0e0 END) AS si, any_value(med) AS med
 FROM {_SPLIT}, (SELECT median(x3) AS med FROM {_SPLIT} WHERE split = 'TRAIN') WHERE split = 'TRAIN')""".replace("log1p(x1)", "ln(1 + x1)"))
def _(spark, sf):
    own = _split(spark, sf).withColumn("x1", F.log1p("x1"))
    ready = models.prepare(own.where("split = 'TRAIN'"), ["x1", "x3"])
    return own.select("sensor", *(F.round(c, 6).alias(n) for c, n in zip(ready.columns(), ready.names, strict=True)))


@query("F24_F25_models")
def _(spark, sf):
    """Mean, least squares, ridge and elastic net on the locked test, the ridge penalty from the validation rows."""
    own, y = _split(spark, sf), F.log("outcome")
    ready = models.prepare(own.where("split = 'TRAIN'"), ["x1", "x2", "x3"])
    g = models.grams(own, ready, y, F.col("split"))
    alpha = models.held_out_alpha(g["TRAIN"], g["VALIDATION"])
    both = models.total({k: g[k] for k in ("TRAIN", "VALIDATION")})
    rows = [(k, float(a), float(np.sqrt(models.solve(both, k, a).sse(g["TEST"]) / g["TEST"].n))) for k, a in (("mean", 0.0), ("ols", 0.0), ("ridge", alpha), ("elastic", 0.01))]
    return spark.createDataFrame([(k, a, round(r, 9)) for k, a, r in rows], "model string, alpha double, rmse double")


_OLS = f"""WITH t AS (SELECT * FROM {_SPLIT} WHERE split <> 'TEST'), c AS (SELECT regr_slope(ln(outcome), x1) AS b, regr_intercept(ln(outcome), x1) AS a FROM t)
SELECT round(sqrt(avg(pow(ln(outcome) - a - b * x1, 2))), 9) AS rmse, count(*) AS n FROM {_SPLIT}, c WHERE split = 'TEST'"""


@query("F24_ols_one_predictor", _OLS)
def _(spark, sf):
    own, y = _split(spark, sf), F.log("outcome")
    ready = models.prepare(own.where("split <> 'TEST'"), ["x1"])
    g = models.grams(own, ready, y, F.when(F.col("split") == "TEST", "TEST").otherwise("FIT"))
    return spark.createDataFrame([(round(float(np.sqrt(models.solve(g["FIT"], "ols").sse(g["TEST"]) / g["TEST"].n)), 9), int(g["TEST"].n))], "rmse double, n long")


@query("F26_F27_tuning")
def _(spark, sf):
    """Grouped five-fold cross-validation of a grid and the simplest choice near the best."""
    own = view(spark, sf, "measures")
    fold = F.pmod(F.crc32(F.concat_ws("|", "company", (F.col("c_custkey") % 37).cast("string"))), F.lit(5))
    g = models.grams(own, models.prepare(own, ["x1", "x2", "x3"]), F.log("outcome"), fold)
    grid = [("mean", 0.0), ("ridge", 100.0), ("ridge", 10.0), ("ridge", 1.0), ("ols", 0.0)]
    best = models.tuned(g, grid)
    return spark.createDataFrame([(k, a, *(round(v, 9) for v in models.cross_validated(g, k, a)), (k, a) == best) for k, a in grid], "model string, alpha double, rmse double, sd double, selected boolean")


@query("F29_bootstrap_gain")
def _(spark, sf):
    """Intervals of the gain on the locked test of one model: all its rows, of the whole table."""
    quantity = F.col("l_quantity").cast("double")
    own = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber % 4 = 1")
    own = own.select(quantity.alias("y"), (quantity * 0.6 + F.col("l_partkey") % 23).alias("predicted"), F.lit(25.0).alias("base"))
    return spark.createDataFrame([tuple(round(float(v), 9) for v in models.resampled_gain(own, "y", "predicted", "base", 500))], "low double, middle double, high double")


@query("F32_drop_column_and_inflation")
def _(spark, sf):
    """What each predictor adds, and its uncentred inflation."""
    own, y = _split(spark, sf), F.log("outcome")
    g = models.grams(own, models.prepare(own.where("split = 'TRAIN'"), ["x1", "x2", "x3"]), y, F.col("split"))
    drop, vif = models.drop_column(g["TRAIN"], g["TEST"]), models.inflation(g["TRAIN"])
    return spark.createDataFrame([(n, round(drop[n], 9), round(vif[n], 9)) for n in g["TRAIN"].names], "feature string, loss double, inflation double")


@query("F20_parameter_relationship", f"SELECT company, count(*) AS n, round(regr_slope(ln(1 + x2), ln(outcome)), 9) AS slope FROM measures GROUP BY 1")
def _(spark, sf):
    own = view(spark, sf, "measures").select("company", F.log("outcome").alias("x"), F.log(1 + F.col("x2")).alias("y"))
    return rounded(regress.simple(own, ["company"]).select("company", "n", "slope"), "slope", digits=9)
