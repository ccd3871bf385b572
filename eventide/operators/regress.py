"""One-variable regressions with HC3 errors, false-discovery control, correlations and prediction metrics, from moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import erfc_p, finite
from .joins import PARTS

Z95 = 1.959963984540054


def simple(frame: DataFrame, by: list[str], x: str = "x", y: str = "y", least: int = 3) -> DataFrame:
    """y on x for each group: slope, HC3 standard error, normal p-value and interval, R2, Pearson's r; too few rows or a constant x give a status.

    Two passes: moments, then residuals against them, joined back as a small table; every group is pre-aggregated.
    """
    ok = frame.where(finite(F.col(x)) & finite(F.col(y))).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count("*")).alias("sxx"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"), (F.var_pop("y") * F.count("*")).alias("syy"))
    m = m.withColumn("usable", (F.col("n") >= least) & (F.col("sxx") > 0))
    m = m.withColumn("slope", F.when(F.col("usable"), F.col("sxy") / F.col("sxx"))).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    each = ok.join(m.where("usable").select(*by, "n", "mx", "sxx", "slope", "intercept"), by)
    d, e = F.col("x") - F.col("mx"), F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    h = 1.0 / F.col("n") + d * d / F.col("sxx")
    s = each.groupBy(*by).agg(F.sum(F.when(h < 1 - 1e-12, d * d * e * e / ((1 - h) * (1 - h)))).alias("meat"), F.sum(e * e).alias("sse"))
    out = m.join(s, by, "left")
    se = F.sqrt("meat") / F.col("sxx")
    r2 = F.when(F.col("syy") > 0, 1 - F.col("sse") / F.col("syy"))
    out = out.withColumn("se", se).withColumn("p", erfc_p(F.try_divide("slope", "se")))
    return out.select(
        *by, "n", "slope", "intercept", "se", (F.col("slope") - Z95 * F.col("se")).alias("ci_low"), (F.col("slope") + Z95 * F.col("se")).alias("ci_high"), "p", r2.alias("r2"),
        F.when(F.col("n") > 2, 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adjusted_r2"), F.when((F.col("syy") > 0) & (F.col("sxx") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("pearson"),
        (100.0 * F.expm1("slope")).alias("effect_pct"), F.when(F.col("usable"), "ok").when(F.col("n") < least, "too_few_rows").otherwise("constant_predictor").alias("status"),
    )


def false_discovery(frame: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q-values in each family: the running minimum of p * m / rank from the largest p on."""
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    # equal p-values share the rank of the last of them
    rank = F.count(p).over(own.orderBy(F.asc_nulls_last(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = frame.withColumn("__raw", F.col(p) * F.count(p).over(own) / rank)
    q = F.least(F.lit(1.0), F.min("__raw").over(own.orderBy(F.desc_nulls_last(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("q", F.when(F.col(p).isNotNull(), q)).drop("__raw")


def evidence(p: Column, q: Column, slope: Column) -> Column:
    strength = F.when(q < 0.05, "FDR-supported").when(p < 0.05, "nominal").otherwise("no clear evidence")
    return F.concat(strength, F.lit(", "), F.when(slope > 0, "positive").when(slope < 0, "negative").otherwise("flat"))


def average_rank(frame: DataFrame, by: list[str], c: str, name: str) -> DataFrame:
    """Ranks from 1, ties at their average; nulls have none.

    Rows are counted for each value first. The values are cut at approximate quantiles, and each part is moved on by the
    rows of those before it, so neither a group nor the whole has to be sorted by one task.
    """
    counts = frame.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("__n"))
    cuts = counts.agg(F.percentile_approx(c, [k / PARTS for k in range(1, PARTS)], 1000)).first()[0] or []
    part = F.lit(0)
    for x in sorted(set(cuts)):
        part = part + F.when(F.col(c) > x, 1).otherwise(0)
    counts = counts.withColumn("__part", part)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("__n").over(up_to(Window.partitionBy(*by, "__part").orderBy(c))), F.lit(0))
    sizes = counts.groupBy(*by, "__part").agg(F.sum("__n").alias("__size"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(up_to(whole.orderBy("__part"))), F.lit(0))).drop("__size")
    ranks = counts.withColumn("__inside", inside).join(before, [*by, "__part"])
    ranks = ranks.select(*by, c, (F.col("__before") + F.col("__inside") + (F.col("__n") + 1) / 2.0).alias(name))
    return frame.join(ranks, [*by, c], "left")


def correlations(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's and Spearman's coefficients and the complete rows of every pair of columns. Only rows where both are present count."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            own = frame.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v"))
            own = average_rank(average_rank(own, [], "u", "ru"), [], "v", "rv")
            one = own.agg(F.count("*").alias("n"), F.corr("u", "v").alias("pearson"), F.corr("ru", "rv").alias("spearman")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "pearson", "spearman")
            out = one if out is None else out.unionByName(one)
    return out


def strong_pairs(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("pearson") >= least)


def metrics(frame: DataFrame, by: list[str], y: str = "y", predicted: str = "predicted", base: str | None = "base") -> DataFrame:
    """RMSE, MAE, R2, Spearman, calibration and the gain over a baseline, for each group."""
    ranked = average_rank(average_rank(frame, by, y, "__ry"), by, predicted, "__rp")
    e = F.col(y) - F.col(predicted)
    aggs = [
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"), F.corr("__ry", "__rp").alias("spearman"),
        F.regr_slope(y, predicted).alias("calibration_slope"), F.regr_intercept(y, predicted).alias("calibration_intercept"),
    ]
    if base:
        aggs.append(F.sqrt(F.avg((F.col(y) - F.col(base)) ** 2)).alias("base_rmse"))
    out = ranked.groupBy(*by).agg(*aggs)
    return out.withColumn("gain_pct", F.when(F.col("base_rmse") > 0, 100.0 * (F.col("base_rmse") - F.col("rmse")) / F.col("base_rmse"))) if base else out


def weighted_mean(x: Column, w: Column) -> Column:
    """An aggregate: sum(x w) / sum(w) over rows where both are finite and w > 0."""
    ok = finite(x) & finite(w) & (w > 0)
    return F.try_divide(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))


def precision_mean(x: Column, lo: Column, hi: Column) -> Column:
    """An aggregate: the mean weighted by 1 / se**2, se a 95 % interval's width over 3.92."""
    se = (hi - lo) / 3.92
    ok = finite(x) & finite(se) & (se > 0)
    return F.try_divide(F.sum(F.when(ok, x / (se * se))), F.sum(F.when(ok, 1.0 / (se * se))))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.when(x > 0, F.ln(x))))


def reproduced(new: DataFrame, old: DataFrame, keys: list[str], metrics: list[str], slack: float = 1e-10) -> DataFrame:
    """(metric, rows, difference, passed): the largest absolute difference of two runs' tables, a row of one alone or a value that one lacks counting as infinite."""
    both = new.select(*keys, *(F.col(m).alias(f"__a_{m}") for m in metrics), F.lit(1).alias("__a")).join(old.select(*keys, *(F.col(m).alias(f"__b_{m}") for m in metrics), F.lit(1).alias("__b")), keys, "full")

    def distance(m: str) -> Column:
        a, b = F.col(f"__a_{m}"), F.col(f"__b_{m}")
        same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (a.isNull() == b.isNull())
        return F.when(~same, float("inf")).when(a.isNull(), 0.0).otherwise(F.abs(a - b))

    one = both.agg(F.count("*").alias("rows"), *(F.max(distance(m)).alias(f"__d_{m}") for m in metrics))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"__d_{m}").alias("difference")) for m in metrics)))
    return one.select("rows", each.alias("r")).select("r.metric", "rows", "r.difference", (F.col("r.difference") < slack).alias("passed"))


def scorecard(tables: dict[str, tuple[DataFrame, dict[str, str]]], columns: list[str]) -> DataFrame:
    """Several approaches' tables as one: each brings its own names, which go over into the common ones."""
    out = None
    for approach, (frame, names) in tables.items():
        own = frame.withColumnsRenamed(names).select(F.lit(approach).alias("approach"), *columns)
        out = own if out is None else out.unionByName(own)
    return out


def patched_medians(master: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """master (key, n, total, median) with the exact median in place of its own, and whether counts and totals agree with the events' own (exact_n, exact_total, exact_median)."""
    out = master.drop("median").join(exact, key, "left")
    n, t = F.coalesce("exact_n", F.lit(0)), F.coalesce("exact_total", F.lit(0.0))
    return out.withColumn("median", F.col("exact_median")).withColumns({"count_ok": F.col("n") == n, "total_ok": F.abs(F.col("total") - t) <= 1e-6 + 1e-9 * F.abs(t), "complete": F.col("exact_median").isNotNull()})


def region_measures(works: DataFrame, sensors: DataFrame) -> DataFrame:
    """Everything that is known of a region: its works by area, its sensors' fits, durations and frequencies, and whether it has 1, 3, 5 or 10 sensors.

    works: (region, area, load, capacity, rain, population, x, y); sensors: (region, sensor, beta, ci_low, ci_high, rate,
    events, minutes, median_minutes, mean_minutes, years, polygon). Sums ignore what is missing; a ratio is one of sums.
    """
    c = F.col
    ratio = F.try_divide("load", "capacity")
    own = works.groupBy("region").agg(
        F.count("*").alias("works"), F.sum("area").alias("area"), weighted_mean(c("x"), c("area")).alias("centre_x"), weighted_mean(c("y"), c("area")).alias("centre_y"), F.sum("load").alias("load"), F.sum("capacity").alias("capacity"),
        F.try_divide(F.sum("load"), F.sum("capacity")).alias("capacity_ratio"), F.avg(ratio).alias("ratio_mean"), F.median(ratio).alias("ratio_median"), weighted_mean(c("rain"), c("area")).alias("rain"), F.avg(c("rain").isNotNull().cast("double")).alias("rain_coverage"),
        F.sum("population").alias("population"), F.try_divide(F.sum("population"), F.sum("area")).alias("density"),
    )
    spread = lambda x: F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))
    beta, rate = (F.when(finite(c(n)) & (c(n) > 0), c(n)) for n in ("beta", "rate"))
    exposed = finite(c("years")) & F.coalesce(c("years") > 0, F.lit(False))
    events = F.coalesce("events", F.lit(0))
    of = sensors.groupBy("region").agg(
        F.countDistinct("sensor").alias("sensors"), F.sum(events).alias("events"), F.sum(F.when(exposed, c("years"))).alias("sensor_years"),
        F.avg(beta).alias("beta_mean"), F.median(beta).alias("beta_median"), F.stddev_samp(beta).alias("beta_sd"), spread(beta).alias("beta_iqr"), precision_mean(c("beta"), c("ci_low"), c("ci_high")).alias("beta_precise"), F.count(beta).alias("beta_n"),
        F.avg(rate).alias("rate_mean"), F.median(rate).alias("rate_median"), geometric_mean(rate).alias("rate_geometric"), F.stddev_samp(rate).alias("rate_sd"), spread(rate).alias("rate_iqr"), F.count(rate).alias("rate_n"),
        F.sum("minutes").alias("minutes"), F.try_divide(F.sum("minutes"), F.sum(events)).alias("minutes_mean"), F.try_divide(F.sum(F.coalesce("median_minutes", F.lit(0.0)) * events), F.sum(events)).alias("minutes_median"), F.avg("mean_minutes").alias("mean_of_means"), F.count_if(events > 0).alias("duration_n"),
        F.try_divide(F.sum(F.when(exposed, events)), F.sum(F.when(exposed, c("years")))).alias("per_year"), F.count_if(exposed).alias("frequency_n"), F.avg(c("polygon").cast("double")).alias("polygon_share"),
    )
    return own.join(of, "region").withColumns({f"ge_{n}": c("sensors") >= n for n in (1, 3, 5, 10)})
