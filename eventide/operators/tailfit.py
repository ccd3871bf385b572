"""Conditional stretched-exponential tails: maximum likelihood by a one-dimensional profile, and its bootstrap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import tail

#: The fit's bounds and the least tail sizes (fixed values).
BETA, LOG_RATE = (0.01, 2.0), (-50.0, 20.0)
LEAST_FIT, LEAST_BOOTSTRAP = 10, 20
#: Multiplicities that are drawn and fitted together (8 bytes each, and as many again on the way), and tasks for each core, as sources cost more than their bytes say.
DRAWN, TASKS_A_CORE = 1 << 15, 4


def _profile(beta: np.ndarray, logs: np.ndarray, weights: np.ndarray, log_u: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and log rate for each row of weights at its own beta.

    For a fixed beta the best theta = rate ** beta is n / (sum x**beta - n u**beta); it is clipped to the rate's bounds.
    Powers are taken relative to the threshold, so nothing overflows.
    """
    n = weights.sum(axis=1)
    rel = logs - log_u
    excess = (weights * np.expm1(np.clip(beta[:, None] * rel[None, :], None, 700.0))).sum(axis=1)
    with np.errstate(divide="ignore"):
        log_theta = np.log(n) - np.log(excess) - beta * log_u
    log_rate = np.clip(log_theta / beta, *LOG_RATE)
    scaled = np.exp(np.clip(beta * (log_rate + log_u), -745.0, 700.0))
    value = n * (np.log(beta) + beta * log_rate) + (beta - 1) * (weights * logs[None, :]).sum(axis=1) - scaled * excess
    return value, log_rate


def _slope(beta: np.ndarray, rel: np.ndarray, powers: np.ndarray, weights: np.ndarray, sums: np.ndarray, log_u: float) -> tuple[np.ndarray, np.ndarray]:
    """The profile's derivative for each row at its own beta, and the derivative of that. powers, sums: the powers 0 to 2 of rel, and their weighted sums."""
    n = sums[:, 0]
    part = np.multiply.outer(beta, rel)
    np.expm1(np.minimum(part, 700.0, out=part), out=part)
    part *= weights
    zero, one, two = (part @ powers).T
    one, two = one + sums[:, 1], two + sums[:, 2]
    log_rate = np.clip((np.log(n) - np.log(zero)) / beta - log_u, *LOG_RATE)
    scaled = np.exp(np.clip(beta * (log_rate + log_u), -745.0, 700.0))
    # the best rate's own derivative is nothing, and a clipped rate doesn't move
    high = log_rate + log_u
    slope = n * (1 / beta + high) + sums[:, 1] - scaled * (high * zero + one)
    clipped = (log_rate == LOG_RATE[0]) | (log_rate == LOG_RATE[1])
    bend = -n / beta**2 - np.where(clipped, scaled * (high * high * zero + 2 * high * one + two), n * (two / zero - (one / zero) ** 2))
    return slope, bend


def fit_many(x: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta, log rate, log-likelihood) for each row of multiplicities: a coarse grid guards the one maximum, Newton's steps, halved where they leave its neighbours, find it.

    The grid's powers are the same for all rows, so that its values are one matrix product.
    """
    logs, log_u, rows = np.log(x), np.log(threshold), len(weights)
    rel, grid = logs - log_u, np.geomspace(*BETA, 41)
    powers = np.stack([np.ones_like(rel), rel, rel * rel], axis=1)
    sums, on_grid = weights @ powers, np.expm1(np.minimum(np.multiply.outer(rel, grid), 700.0))
    n = sums[:, :1]
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        excess = weights @ on_grid
        log_rate = np.clip((np.log(n) - np.log(excess)) / grid - log_u, *LOG_RATE)
        values = n * (np.log(grid) + grid * log_rate) + (grid - 1) * (sums[:, 1:2] + n * log_u) - np.exp(np.clip(grid * (log_rate + log_u), -745.0, 700.0)) * excess
        at = values.argmax(axis=1)
        lo, hi = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, len(grid) - 1)]
        # the start: the top of the parabola through the three values, in the grid's own steps
        left, top, right = (np.take_along_axis(values, np.clip(at + d, 0, len(grid) - 1)[:, None], axis=1)[:, 0] for d in (-1, 0, 1))
        aside = np.nan_to_num((left - right) / (2 * (left - 2 * top + right)), nan=0.0, posinf=0.0, neginf=0.0)
        beta = np.where((at > 0) & (at < len(grid) - 1), grid[at] * (grid[1] / grid[0]) ** np.clip(aside, -0.5, 0.5), grid[at])
        todo = np.arange(rows)
        for _ in range(60):
            own = beta[todo]
            slope, bend = _slope(own, rel, powers, weights if len(todo) == rows else weights[todo], sums[todo], log_u)
            lo[todo], hi[todo] = np.where(slope >= 0, own, lo[todo]), np.where(slope >= 0, hi[todo], own)
            step = own - slope / bend
            inside = (step > lo[todo]) & (step < hi[todo]) & (bend < 0)
            beta[todo] = np.where(inside, step, (lo[todo] + hi[todo]) / 2)
            # a step of Newton's leaves the square of its own length
            todo = todo[np.where(inside, np.abs(step - own) > 1e-5 * own, hi[todo] - lo[todo] > 1e-12)]
            if not len(todo):
                break
        value, log_rate = _profile(beta, logs, weights, log_u)
        edges = []
        for k, edge in ((0, BETA[0]), (-1, BETA[1])):  # a maximum at a bound is the bound itself
            edges.append((values[:, k] >= value) & (np.abs(beta - edge) < np.abs(grid[k] - grid[1 if k == 0 else -2])))
            beta = np.where(edges[-1], edge, beta)
        moved = edges[0] | edges[1]
        if moved.any():
            value[moved], log_rate[moved] = _profile(beta[moved], logs, weights[moved], log_u)
    return beta, log_rate, value


def seed_of(seed: int, company: str, permit: str) -> int:
    """A stable seed: the first 8 bytes of the SHA-256 of the parts joined by NUL, big-endian, mod 2**63 - 1."""
    return int.from_bytes(hashlib.sha256(f"{seed}\0{company}\0{permit}".encode()).digest()[:8], "big") % (2**63 - 1)


FIT = "company string, permit_number string, n_tail long, beta double, log_rate double, log_likelihood double, at_bound boolean, status string"
BOOTSTRAP = ", replicates long, ci_low double, ci_high double, ci_width double, beta_sd double, success_rate double, hit_rate double, stability string"


def _one(company, permit, x: np.ndarray, times: np.ndarray, threshold: float, replicates: int, seed: int) -> dict:
    """x: a source's different durations; times: how often each stands."""
    order = np.argsort(x, kind="stable")
    x, times = x[order], times[order].astype(np.int64)
    n = int(times.sum())
    out = {"company": company, "permit_number": permit, "n_tail": n, "at_bound": False}
    if not n:
        return out | {"status": "no_tail_events"}
    if n < LEAST_FIT:
        return out | {"status": "too_few_tail_events"}
    (beta,), (log_rate,), (value,) = fit_many(x, times[None].astype(float), threshold)
    if not np.isfinite(value):
        return out | {"status": "fit_failed"}
    bound = min(abs(beta - BETA[0]), abs(beta - BETA[1])) <= 1e-4
    out |= {"beta": beta, "log_rate": log_rate, "log_likelihood": value, "at_bound": bool(bound), "status": "fitted"}
    if not replicates:
        return out
    if n < LEAST_BOOTSTRAP:
        return out | {"status": "fitted_too_few_for_bootstrap"}
    rng = np.random.default_rng(seed_of(seed, company or "", permit or ""))
    betas: list[np.ndarray] = []
    some = min(max(DRAWN // len(x), 1), 500)
    for k in range(0, replicates, some):
        draws = rng.multinomial(n, times / n, size=min(some, replicates - k)).astype(float)
        b, _, v = fit_many(x, draws, threshold)
        betas.append(np.where(np.isfinite(v), b, np.nan))
    b = np.concatenate(betas)
    good = b[np.isfinite(b)]
    if len(good) < 2:
        return out | {"status": "bootstrap_failed", "replicates": replicates, "success_rate": len(good) / replicates}
    lo, hi = np.quantile(good, [0.025, 0.975])
    width = hi - lo
    hits = np.mean((np.abs(good - BETA[0]) <= 1e-4) | (np.abs(good - BETA[1]) <= 1e-4))
    label = "stable" if width <= 0.25 else "moderate" if width <= 0.5 else "unstable"
    return out | {"status": "completed", "replicates": replicates, "ci_low": lo, "ci_high": hi, "ci_width": width, "beta_sd": good.std(ddof=1), "success_rate": len(good) / replicates, "hit_rate": hits, "stability": label}


def fits(events: DataFrame, threshold: float = 240.0, replicates: int = 0, seed: int = 42) -> DataFrame:
    """One row a source (company, permit_number) with its fit and, if replicates are asked for, its bootstrap.

    Events reach Python once, reduced to their tail; a source with none of it is answered without Python. A failure is a
    status, never an exception. Draws depend on the source's own seed and sorted tail, not on partitions. Equal durations
    are counted before they are dealt, so a source's different durations (16 bytes each), not its events, have to fit a
    task; durations in whole minutes are some hundred thousand at most.
    """
    keyed = events.select("company", "permit_number", "duration_minutes")
    schema = FIT + (BOOTSTRAP if replicates else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {n: getattr(pa, {"long": "int64", "double": "float64", "boolean": "bool_"}.get(t, t))() for n, t in (c.split() for c in schema.split(", "))}

    def kernel(key: tuple, part: pa.Table) -> pa.Table:
        x, times = (part.column(c).to_numpy() for c in ("duration_minutes", "times"))
        row = _one(*(k.as_py() for k in key), x.astype(float), times, threshold, replicates, seed)
        return pa.table({n: pa.array([row.get(n)], kinds[n]) for n in names})

    counted = keyed.where(tail(F.col("duration_minutes"), threshold)).groupBy("company", "permit_number", "duration_minutes").agg(F.count("*").alias("times"))
    context = events.sparkSession.sparkContext
    dealt = counted.repartition(max(TASKS_A_CORE * context.defaultParallelism, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "company", "permit_number")
    some = dealt.groupBy("company", "permit_number").applyInArrow(kernel, schema)
    none = keyed.groupBy("company", "permit_number").agg(F.count_if(tail(F.col("duration_minutes"), threshold)).alias("n")).where("n = 0")
    empty = none.select("company", "permit_number", F.lit(0).cast("long").alias("n_tail"), F.lit(False).alias("at_bound"), F.lit("no_tail_events").alias("status"))
    return some.unionByName(empty, allowMissingColumns=True)


def grid_fits(events: DataFrame, betas: list[float], threshold: float = 240.0) -> DataFrame:
    """The profile maximum over a fixed grid of betas, in SQL functions alone: power sums by (source, beta), then the best."""
    own = events.where(tail(F.col("duration_minutes"), threshold)).select("company", "permit_number", F.ln(F.col("duration_minutes") / threshold).alias("r"), F.ln("duration_minutes").alias("l"))
    by = own.groupBy("company", "permit_number").agg(F.count("*").alias("n"), F.sum("l").alias("sl"), *(F.sum(F.expm1(b * F.col("r"))).alias(f"e{k}") for k, b in enumerate(betas)))
    log_u = float(np.log(threshold))
    cases = []
    for k, b in enumerate(betas):
        rate = F.least(F.greatest((F.ln("n") - F.ln(f"e{k}") - b * log_u) / b, F.lit(LOG_RATE[0])), F.lit(LOG_RATE[1]))
        value = F.col("n") * (float(np.log(b)) + b * rate) + (b - 1) * F.col("sl") - F.exp(b * (rate + log_u)) * F.col(f"e{k}")
        cases.append(F.struct(value.alias("value"), F.lit(-b).alias("minus_beta"), rate.alias("log_rate")))
    best = F.array_max(F.array(*cases))
    return by.where(F.col("n") >= LEAST_FIT).select("company", "permit_number", "n", best.alias("b")).select("company", "permit_number", "n", (-F.col("b.minus_beta")).alias("beta"), "b.log_rate", F.col("b.value").alias("log_likelihood"))
