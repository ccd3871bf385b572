"""Linear models from Gram matrices: rows are reduced by Spark to one sum of products, solved in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that must not be among predictors (fixed values): what is derived from outcomes.
FORBIDDEN = ("beta", "lambda", "duration", "frequency", "spill", "tail", "event_count", "log_likelihood")


def leakage(predictors: list[str]) -> list[str]:
    """Predictors whose name speaks of an outcome."""
    return [p for p in predictors if any(w in p.lower() for w in FORBIDDEN)]


def split_of(key: Column, stratum: Column, seed: int = 42, test: float = 0.15, validation: float = 0.15):
    """TRAIN, VALIDATION or TEST by a seeded order within each stratum, so shares hold in every stratum and sets are disjoint."""
    w = Window.partitionBy(stratum)
    place = (F.row_number().over(w.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256), key)) - F.lit(0.5)) / F.count("*").over(w)
    return F.when(place <= test, "TEST").when(place <= test + validation, "VALIDATION").otherwise("TRAIN")


def hashed_split(frame: DataFrame, key: str, seed: int = 42, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """frame with `split`: rows in the seeded order of their key's hash, the first shares TEST and VALIDATION, exactly; the order is cut in parts, so no task sorts all rows."""
    from .joins import numbered

    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    lead = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    n = frame.count()
    place = (F.col("__number") - 0.5) / F.lit(float(max(n, 1)))
    split = F.when(place <= test, "TEST").when(place <= test + validation, "VALIDATION").otherwise("TRAIN")
    return numbered(frame, lead, [key], "__number").withColumn("split", split).drop("__number")


def quantile_bins(frame: DataFrame, value: str, bins: int) -> DataFrame:
    """`bin` by quantile edges, equal edges dropped, intervals closed on the right."""
    cuts = frame.agg(F.array_distinct(F.percentile(value, F.array(*(F.lit(k / bins) for k in range(1, bins))))).alias("__cuts"))
    return frame.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


@dataclass
class Prepared:
    """Medians, missing indicators, means and population deviations of the training rows."""

    features: list[str]
    medians: dict[str, float]
    flagged: list[str]
    means: dict[str, float]
    sds: dict[str, float]

    def columns(self) -> list[Column]:
        raw = [F.coalesce(F.col(f).cast("double"), F.lit(self.medians[f])) for f in self.features] + [F.col(f).isNull().cast("double") for f in self.flagged]
        return [((c - self.means[n]) / (self.sds[n] or 1.0)).alias(n) for c, n in zip(raw, self.names, strict=True)]

    @property
    def names(self) -> list[str]:
        return [*self.features, *(f"{f}__missing" for f in self.flagged)]


def prepare(train: DataFrame, features: list[str]) -> Prepared:
    """Exact medians for missing values, an indicator where a training row misses one, standardised by the population deviation; one pass for medians, one for moments."""
    row = train.agg(*(F.median(f).alias(f"m_{f}") for f in features), *(F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in features)).first()
    medians = {f: float(row[f"m_{f}"] or 0.0) for f in features}
    flagged = [f for f in features if row[f"n_{f}"]]
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(medians[f])).alias(f) for f in features] + [F.col(f).isNull().cast("double").alias(f"{f}__missing") for f in flagged]
    names = [*features, *(f"{f}__missing" for f in flagged)]
    stats = train.select(*filled).agg(*(F.avg(n).alias(f"a_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    return Prepared(features, medians, flagged, {n: stats[f"a_{n}"] for n in names}, {n: stats[f"s_{n}"] for n in names})


@dataclass
class Gram:
    """Sums over rows of products of (1, features, y), by fold where asked; additive, so folds subtract."""

    names: list[str]
    sums: np.ndarray

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.sums - other.sums)

    @property
    def n(self) -> float:
        return self.sums[0, 0]

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        p = len(self.names)
        mean = self.sums[0, 1 : p + 1] / self.n
        my = self.sums[0, p + 1] / self.n
        return self.sums[1 : p + 1, 1 : p + 1] - self.n * np.outer(mean, mean), self.sums[1 : p + 1, p + 1] - self.n * mean * my, mean, my


def grams(frame: DataFrame, prepared: Prepared, y: Column, fold: Column | None = None, weight: Column | None = None) -> dict:
    """The Gram of each fold (one, None, without folds): one aggregate, p**2 / 2 sums a fold reach the driver. weight: how often a row counts."""
    names = prepared.names
    weighed = weight if weight is not None else F.lit(1.0)
    rows = frame.select(F.lit(1.0).alias("__1"), *prepared.columns(), y.cast("double").alias("__y"), (fold if fold is not None else F.lit(0)).alias("__fold"), weighed.cast("double").alias("__w"))
    all_ = ["__1", *names, "__y"]
    pairs = [(i, j) for i in range(len(all_)) for j in range(i, len(all_))]
    got = rows.groupBy("__fold").agg(*(F.sum(F.col("__w") * F.col(f"`{all_[i]}`") * F.col(f"`{all_[j]}`")).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in got:
        m = np.zeros((len(all_),) * 2)
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        out[r["__fold"] if fold is not None else None] = Gram(names, m)
    return out


def total(parts: dict) -> Gram:
    return Gram(next(iter(parts.values())).names, sum(g.sums for g in parts.values()))


@dataclass
class Linear:
    intercept: float
    weights: np.ndarray

    def predict(self, prepared: Prepared) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(prepared.columns(), self.weights, strict=True):
            out = out + c * float(w)
        return out

    def sse(self, g: Gram) -> float:
        """The squared error on a Gram's rows, without seeing them."""
        v = np.concatenate([[self.intercept], self.weights, [-1.0]])
        return float(max(0.0, v @ g.sums @ v))


def solve(g: Gram, kind: str, alpha: float = 0.0, l1_ratio: float = 0.5) -> Linear:
    """mean, ols, ridge (||y - Xw||^2 + alpha ||w||^2) or elastic net (half mean squared error plus alpha times the mixed penalty)."""
    xx, xy, mean, my = g.centred()
    p = len(mean)
    if kind == "mean":
        w = np.zeros(p)
    elif kind == "ols":
        w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    elif kind == "ridge":
        w = np.linalg.solve(xx + alpha * np.eye(p), xy)
    else:
        w, n = np.zeros(p), g.n
        one, two = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
        for _ in range(10_000):
            old = w.copy()
            for j in range(p):
                if xx[j, j] + two > 0:
                    r = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                    w[j] = np.sign(r) * max(abs(r) - one, 0.0) / (xx[j, j] + two)
            if np.abs(w - old).max() < 1e-10:
                break
    return Linear(float(my - mean @ w), w)


def cross_validated(parts: dict, kind: str, alpha: float, l1_ratio: float = 0.5) -> tuple[float, float]:
    """Mean and sample deviation of the folds' RMSE."""
    whole, scores = total(parts), []
    for g in parts.values():
        if 0 < g.n < whole.n:
            scores.append(np.sqrt(solve(whole - g, kind, alpha, l1_ratio).sse(g) / g.n))
    return float(np.mean(scores)), float(np.std(scores, ddof=1)) if len(scores) > 1 else float("nan")


def tuned(parts: dict, grid: list[tuple[str, float]]) -> tuple[str, float]:
    """The simplest choice (in the grid's order) within max(0.5 %, 0.002) of the best cross-validated RMSE."""
    scored = [(cross_validated(parts, k, a)[0], n, (k, a)) for n, (k, a) in enumerate(grid)]
    best = min(s for s, *_ in scored)
    return next(choice for s, _, choice in sorted(scored, key=lambda t: t[1]) if s <= best + max(0.005 * best, 0.002))


def held_out_alpha(train: Gram, validation: Gram, alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> float:
    """The ridge penalty of the least validation error, the smaller on ties."""
    return min(alphas, key=lambda a: (solve(train, "ridge", a).sse(validation), a))


def drop_column(g_fit: Gram, g_test: Gram, kind: str = "ridge", alpha: float = 1.0) -> dict[str, float]:
    """By how much the RMSE grows without each feature."""
    def rmse(keep: list[int]) -> float:
        at = [0, *(k + 1 for k in keep), len(g_fit.names) + 1]
        a, b = (Gram([g_fit.names[k] for k in keep], g.sums[np.ix_(at, at)]) for g in (g_fit, g_test))
        return float(np.sqrt(solve(a, kind, alpha).sse(b) / b.n))

    all_ = list(range(len(g_fit.names)))
    whole = rmse(all_)
    return {g_fit.names[k]: rmse([j for j in all_ if j != k]) - whole for k in all_}


def inflation(g: Gram) -> dict[str, float]:
    """Uncentred variance inflation: the diagonal of the inverse Gram times the Gram's own."""
    xx = g.sums[1 : len(g.names) + 1, 1 : len(g.names) + 1]
    inverse = np.linalg.pinv(xx)
    return {n: float(inverse[k, k] * xx[k, k]) for k, n in enumerate(g.names)}


def bootstrap_gain(y: np.ndarray, predicted: np.ndarray, base: np.ndarray, draws: int = 2000, seed: int = 42) -> tuple[float, float, float]:
    """2.5, 50 and 97.5 % of the gain over a baseline under resampling of the locked test's rows, a bounded set."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(draws):
        at = rng.integers(0, len(y), len(y))
        b = np.sqrt(np.mean((y[at] - base[at]) ** 2))
        if b > 0:
            out.append(100 * (b - np.sqrt(np.mean((y[at] - predicted[at]) ** 2))) / b)
    return tuple(np.quantile(out, [0.025, 0.5, 0.975])) if out else (float("nan"),) * 3


def resampled_gain(frame: DataFrame, y: str, predicted: str, base: str, draws: int = 2000, seed: int = 42) -> tuple[float, float, float]:
    """As bootstrap_gain, over all rows of frame in Spark: each row stands Poisson(1) times in a draw.

    Equal rows are counted first, as n of them stand Poisson(n) times together. A group's seed is its own values, so the
    result doesn't depend on how rows are split. Tasks return their sums of each draw. Rows with a null are left out.
    """
    groups = frame.select(*(F.col(c).cast("double").alias(c) for c in (y, predicted, base))).dropna().groupBy(y, predicted, base).agg(F.count("*").alias("n"))
    groups = groups.select(F.pow(F.col(y) - F.col(predicted), 2).alias("p"), F.pow(F.col(y) - F.col(base), 2).alias("b"), "n", F.xxhash64(y, predicted, base).alias("h"))

    def run(batches):
        import pyarrow as pa

        p, b = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for row in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True):
                times = np.random.default_rng([seed, int(row[3]) & (1 << 64) - 1]).poisson(row[2], draws)
                p += times * row[0]
                b += times * row[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(p), pa.array(b)], names=["draw", "p", "b"])

    sums = groups.mapInArrow(run, "draw long, p double, b double").groupBy("draw").agg(F.sum("p").alias("p"), F.sum("b").alias("b")).collect()
    out = [100 * (1 - np.sqrt(r["p"] / r["b"])) for r in sums if r["b"] > 0]
    return tuple(np.quantile(out, [0.025, 0.5, 0.975])) if out else (float("nan"),) * 3


def verdict(gain: Column, low: Column, r2: Column) -> Column:
    """What a gain over the baseline amounts to; the texts and limits are fixed values."""
    return F.when((gain > 10) & (low > 0) & (r2 > 0), "STRONG / USEFUL PREDICTIVE SIGNAL").when((gain > 0) & (r2 > 0) & (low > -2), "MODEST / QUALIFIED SIGNAL").when((gain > 0) & (r2 > -0.05), "WEAK / INCONCLUSIVE").otherwise("NO DEMONSTRATED PREDICTIVE SKILL")


def block_id(x: Column, y: Column, size: float = 100_000.0) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def count_model(frame: DataFrame, x: str, count: str, exposure: str, dispersion: float = 1.0, rounds: int = 50) -> tuple[float, float, float]:
    """(intercept, slope, standard error) of a negative-binomial regression with a log-exposure offset, by Newton steps over Spark sums; exp(slope) is the rate ratio."""
    a, b = float(np.log(max(1e-9, frame.agg(F.sum(count) / F.sum(exposure)).first()[0]))), 0.0
    for _ in range(rounds):
        mu = F.col(exposure) * F.exp(F.lit(a) + F.lit(b) * F.col(x))
        w, r = mu / (1 + dispersion * mu), (F.col(count) - mu) / (1 + dispersion * mu)
        s = frame.agg(F.sum(r), F.sum(r * F.col(x)), F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(x) ** 2)).first()
        info = np.array([[s[2], s[3]], [s[3], s[4]]])
        step = np.linalg.solve(info, [s[0], s[1]])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return a, b, float(np.sqrt(np.linalg.inv(info)[1, 1]))


def rmse(m: Linear, g: Gram) -> float:
    return float(np.sqrt(m.sse(g) / g.n))


def among(g: Gram, keep: list[str]) -> Gram:
    """The Gram of some of the features."""
    at = [0, *(1 + g.names.index(k) for k in keep), len(g.names) + 1]
    return Gram(list(keep), g.sums[np.ix_(at, at)])


def balanced_folds(frame: DataFrame, group: Column, folds: int) -> DataFrame:
    """frame with `fold`: whole groups are dealt to folds from the largest on, in turn, so that no group is split. One row a group is ordered."""
    own = frame.withColumn("__group", group)
    sizes = own.groupBy("__group").agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.orderBy(F.desc("__n"), "__group"))
    return own.join(sizes.withColumn("fold", ((place - 1) % folds).cast("int")).drop("__n"), "__group").drop("__group")


def out_of_fold(parts: dict, kind: str, alpha: float = 0.0) -> tuple[int, float, float, float]:
    """(rows, RMSE, baseline RMSE, gain in per cent) of predictions for each fold by a model of the others; the baseline is the mean of all."""
    whole = total(parts)
    score = np.sqrt(sum(solve(whole - g, kind, alpha).sse(g) for g in parts.values()) / whole.n)
    base = rmse(solve(whole, "mean"), whole)
    return int(whole.n), float(score), base, float(100 * (base - score) / base)


def leave_one_out(parts: dict, kind: str, alpha: float = 0.0, least: int = 10, train_least: int = 50) -> list[tuple]:
    """(group, rows, RMSE, baseline RMSE, gain) for each group predicted by a model, and the mean, of the others; groups and trains that are too small are left out."""
    whole, out = total(parts), []
    for key in sorted(parts):
        g, rest = parts[key], whole - parts[key]
        if g.n >= least and rest.n >= train_least:
            score, base = rmse(solve(rest, kind, alpha), g), rmse(solve(rest, "mean"), g)
            out.append((key, int(g.n), score, base, float(100 * (base - score) / base)))
    return out


def ablation(fit: Gram, test: Gram, blocks: dict[str, list[str]], kind: str = "ols", alpha: float = 0.0) -> list[tuple]:
    """(block removed, features left, RMSE, its difference from the whole model's)."""
    whole = rmse(solve(fit, kind, alpha), test)
    out = [("none_full_model", len(fit.names), whole, 0.0)]
    for block, gone in blocks.items():
        keep = [n for n in fit.names if n not in gone]
        if len(keep) < len(fit.names):
            score = rmse(solve(among(fit, keep), kind, alpha), among(test, keep))
            out.append((block, len(keep), score, score - whole))
    return out


def permutation_importance(m: Linear, test: Gram) -> dict[str, float]:
    """By how much the RMSE grows with a feature's values dealt anew among the rows: the expectation over all permutations, from the Gram alone.

    With r the residual without feature j, the mean square over permutations is E r^2 - 2 w E r E x + w^2 E x^2.
    """
    base, out = rmse(m, test), {}
    v = np.concatenate([[-m.intercept], -m.weights, [1.0]])
    for j, name in enumerate(test.names):
        r = v.copy()
        r[j + 1] = 0.0
        w = m.weights[j]
        square = (r @ test.sums @ r) / test.n
        mean_r, mean_x = (r @ test.sums[:, 0]) / test.n, test.sums[0, j + 1] / test.n
        out[name] = float(np.sqrt(square - 2 * w * mean_r * mean_x + w * w * test.sums[j + 1, j + 1] / test.n)) - base
    return out


#: P(X <= k) of a Poisson variable of mean 1, k from 0 on.
_POISSON = [float(sum(np.exp(-1) / np.prod(range(1, j + 1), dtype=float) for j in range(k + 1))) for k in range(9)]


def multiplicity(key: Column, draw: Column) -> Column:
    """How often a row stands in a bootstrap draw, Poisson of mean 1 by the md5 of its key and the draw's number."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), draw.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON[1:]), F.when(u >= _POISSON[0], 1).otherwise(0))


def gain_interval(frame: DataFrame, key: str, y: str, predicted: str, base: str, draws: int = 2000) -> DataFrame:
    """One row (low, middle, high): 2.5, 50 and 97.5 % of the gain over a baseline, rows standing in each draw as often as their key's hash says; sums are made before the shuffle."""
    own = frame.select(key, F.pow(F.col(y) - F.col(predicted), 2).alias("__e"), F.pow(F.col(y) - F.col(base), 2).alias("__b")).dropna()
    own = own.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__w", multiplicity(F.col(key), F.col("__draw")))
    sums = own.groupBy("__draw").agg(F.sum(F.col("__w") * F.col("__e")).alias("e"), F.sum(F.col("__w") * F.col("__b")).alias("b")).where("b > 0")
    gains = sums.select((100 * (1 - F.sqrt(F.col("e") / F.col("b")))).alias("g"))
    return gains.agg(*(F.percentile("g", F.lit(q)).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))))


def stability(frame: DataFrame, prepared: Prepared, y: Column, key: Column, draws: int = 200, kind: str = "ols", alpha: float = 0.0) -> list[tuple]:
    """(feature, median, 2.5 %, 97.5 %, share positive) of the coefficients over bootstrap draws; rows are reduced to one Gram a draw before the shuffle."""
    own = frame.withColumn("__key", key).withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    parts = grams(own, prepared, y, F.col("__draw"), multiplicity(F.col("__key"), F.col("__draw")))
    w = np.array([solve(parts[d], kind, alpha).weights for d in sorted(parts)])
    low, mid, high = np.quantile(w, [0.025, 0.5, 0.975], axis=0)
    return [(n, float(mid[k]), float(low[k]), float(high[k]), float((w[:, k] > 0).mean())) for k, n in enumerate(prepared.names)]


def learning_curve(parts: dict, steps: list[float], kind: str = "ols", alpha: float = 0.0) -> list[tuple]:
    """(share, training rows, training RMSE, cross-validated RMSE) of models that see the first share of each training fold.

    parts: Grams by (fold, step), a row's step being the first of `steps` that reaches its seeded number.
    """
    folds, out = sorted({f for f, _ in parts}), []
    names = next(iter(parts.values())).names
    zero = Gram(names, np.zeros((len(names) + 2,) * 2))
    add = lambda gs: Gram(names, sum((g.sums for g in gs), zero.sums))
    for k, share in enumerate(steps):
        n, inside, outside, tested = 0.0, 0.0, 0.0, 0.0
        for f in folds:
            train = add(g for (other, s), g in parts.items() if other != f and s <= k)
            test = add(g for (other, _), g in parts.items() if other == f)
            m = solve(train, kind, alpha)
            n, inside, outside, tested = n + train.n, inside + m.sse(train), outside + m.sse(test), tested + test.n
        out.append((share, int(n), float(np.sqrt(inside / n)), float(np.sqrt(outside / tested))))
    return out


def coefficient_table(m: Linear, names: list[str], families: dict[str, str]) -> list[tuple]:
    """(feature, its clean name, family, standardised coefficient), missing-value flags under their feature's family; the first matching word names the family."""
    def family(name: str) -> str:
        return next((f for word, f in families.items() if word in name), "other")

    return [(n, n.replace("__missing", " (missing)").replace("_", " ").strip(), family(n.removesuffix("__missing")), float(w)) for n, w in zip(names, m.weights, strict=True)]


def configurations(parts: dict, sets: dict[str, list[str]], kind: str = "ols", alpha: float = 0.0) -> list[tuple]:
    """(configuration, validation RMSE of a model of TRAIN, test RMSE of a model of both, its difference from the first configuration's)."""
    out = []
    for name, keep in sets.items():
        g = {k: among(v, keep) for k, v in parts.items()}
        validation = rmse(solve(g["TRAIN"], kind, alpha), g["VALIDATION"])
        test = rmse(solve(total({k: g[k] for k in ("TRAIN", "VALIDATION")}), kind, alpha), g["TEST"])
        out.append((name, validation, test, test - (out[0][2] if out else test)))
    return out


def random_intercept(frame: DataFrame, prepared: Prepared, y: Column, group: Column) -> dict[str, float]:
    """A linear model with a random intercept for each group by maximum likelihood: coefficients, residual and group variance, their share (icc), log-likelihood, AIC.

    For a ratio t of the variances a group of n rows takes t / (1 + n t) of its squared sums off the Gram. Groups are
    summed by their size first, so the driver gets one small matrix a size, and the ratio is found by a search in one
    dimension. A ratio at zero is a singular fit: ordinary least squares.
    """
    names = prepared.names
    whole = grams(frame, prepared, y)[None]
    sums = ["__1", *names, "__y"]
    rows = frame.select(group.alias("__g"), F.lit(1.0).alias("__1"), *prepared.columns(), y.cast("double").alias("__y"))
    each = rows.groupBy("__g").agg(*(F.sum(F.col(f"`{c}`")).alias(c) for c in sums))
    pairs = [(i, j) for i in range(len(sums)) for j in range(i, len(sums))]
    by_size = {}
    for r in each.groupBy(F.col("__1").alias("__size")).agg(F.count("*").alias("__n"), *(F.sum(F.col(f"`{sums[i]}`") * F.col(f"`{sums[j]}`")).alias(f"p{i}_{j}") for i, j in pairs)).collect():
        m = np.zeros((len(sums),) * 2)
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        by_size[r["__size"]] = (r["__n"], m)
    n = whole.n

    def fit(t: float) -> tuple[float, np.ndarray, float]:
        g = whole.sums - sum(m * (t / (1 + size * t)) for size, (_, m) in by_size.items())
        w = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
        v = np.append(-w, 1.0)
        sigma = max(float(v @ g @ v) / n, 1e-300)
        return -0.5 * (n * np.log(2 * np.pi * sigma) + sum(k * np.log1p(size * t) for size, (k, _) in by_size.items()) + n), w, sigma

    low, high = -12.0, 8.0  # of log10 t, narrowed by a golden section around the best of a coarse grid
    grid = np.linspace(low, high, 81)
    at = int(np.argmax([fit(10.0**x)[0] for x in grid]))
    a, b = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if fit(10.0**c)[0] > fit(10.0**d)[0] else (c, b)
    t = 10.0 ** ((a + b) / 2)
    if fit(0.0)[0] >= fit(t)[0] - 1e-9:
        t = 0.0
    value, w, sigma = fit(float(t))
    out = {"intercept": float(w[0])} | {k: float(x) for k, x in zip(names, w[1:], strict=True)}
    return out | {"residual_variance": float(sigma), "group_variance": float(t * sigma), "icc": float(t / (1 + t)), "log_likelihood": float(value), "aic": float(2 * (len(w) + 2) - 2 * value), "singular": float(t == 0.0)}


def permuted(size: int, seed: int) -> np.ndarray:
    """The seeded order of row numbers by which the teaching run splits: a permutation of 0..size-1."""
    return np.random.default_rng(seed).permutation(size)


def permutation_split(frame: DataFrame, order: list[str], seed: int = 42) -> DataFrame:
    """`split` by a seeded permutation of the rows, numbered by `order`, which must name them uniquely: 70 % TRAIN, 15 % VALIDATION, the rest TEST, each with its least number.

    Only numbers are permuted on the driver, eight bytes a row, up to 10,000,000 rows; beyond, use split_of.
    """
    from .joins import small

    n = frame.count()
    if n < 12:
        raise ValueError("at least 12 rows are needed")
    if n > 10_000_000:
        raise ValueError(f"{n} rows are too many for a permutation on the driver")
    train = max(8, int(np.floor(n * 0.70)))
    validation = min(max(train + 2, int(np.floor(n * 0.85))), n - 2)
    named = np.full(n, "TEST", dtype=object)
    at = permuted(n, seed)
    named[at[:train]], named[at[train:validation]] = "TRAIN", "VALIDATION"
    import pandas as pd

    spark = frame.sparkSession
    splits = spark.createDataFrame(pd.DataFrame({"__k": np.arange(1, n + 1), "split": named}))
    numbers = frame.withColumn("__k", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbers.join(small(splits), "__k").drop("__k")
