"""The configured run: clean, fit, master, univariate, model, report, manifest, each stage written before the next reads it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, gates, joins, models, regress, tailfit
from ..sources import files

STAGES = ("clean", "fit", "master", "univariate", "model", "report")
OUTCOMES = ("beta", "lambda_per_minute", "mean_duration_minutes", "events_per_year")


@dataclass
class Config:
    """Paths, the locked threshold and the declared predictors."""

    events: str
    assignments: str
    exposure: str
    predictors: str
    output: str
    declared: list[str] = field(default_factory=list)
    threshold: float = 240.0
    seed: int = 42
    force: bool = False

    def __post_init__(self):
        if self.threshold != events.THRESHOLD:
            raise ValueError("the threshold is locked at 240 minutes, exclusive")
        if found := models.leakage(self.declared):
            raise ValueError(f"predictors derived from outcomes: {', '.join(found)}")


PATHS = ("events", "assignments", "exposure", "predictors", "output")


def load_config(spark: SparkSession, path: str, root: str | None = None) -> Config:
    """A Config from a YAML or JSON file: `paths` (relative ones below root, the file's folder without one), `predictors`, `seed`, and `analysis`, whose threshold and rule are locked."""
    text = files.read_text(spark, path)
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml  # only for files in this format

        found = yaml.safe_load(text)
    found = found or {}
    names, base = found.get("paths") or {}, (root or path.rsplit("/", 1)[0]).rstrip("/")
    if missing := [n for n in PATHS if not names.get(n)]:
        raise ValueError(f"configuration without paths: {', '.join(missing)}")
    if not found.get("predictors"):
        raise ValueError("configuration without predictors")
    rule = found.get("analysis") or {}
    if rule.get("tail_rule", "strictly_greater_than") != "strictly_greater_than":
        raise ValueError("the tail's rule is locked: strictly greater than the threshold")
    at = [p if "://" in p or p.startswith("/") else f"{base}/{p}" for p in (str(names[n]) for n in PATHS)]
    if gone := [f"{n}: {p}" for n, p in zip(PATHS[:-1], at, strict=False) if not files.exists(spark, p)]:
        raise FileNotFoundError("; ".join(gone))
    return Config(*at, declared=list(found["predictors"]), threshold=float(rule.get("tail_threshold_minutes", events.THRESHOLD)), seed=int(found.get("seed", 42)))


def scan_provided(spark: SparkSession, path: str, round_15: bool = False) -> tuple[DataFrame, DataFrame]:
    """Provider files in one contract: the rows that are kept, and each file's counters of what was read, kept and rejected for which reason."""
    raw = files.read_csv(spark, path, files.PROVIDED)
    return events.historical(raw, round_15), events.quality(raw, "source_file")


def problems(spark: SparkSession, config: Config) -> list[str]:
    """Everything wrong with the inputs, before anything is written."""
    out = gates.event_contract(files.read_csv(spark, config.events))
    read = lambda p: spark.read.option("header", True).csv(p)
    return out + gates.input_contracts(read(config.assignments), read(config.exposure).withColumn("monitoring_years", F.col("monitoring_years").try_cast("double")), read(config.predictors), config.declared)


def run(spark: SparkSession, config: Config, through: str = "report") -> dict[str, DataFrame]:
    """The stages up to `through`; refuses to replace an earlier run unless forced. Inputs that change meanwhile stop it before the manifest is written."""
    if found := problems(spark, config):
        raise ValueError("; ".join(found))
    wanted = STAGES[: STAGES.index(through) + 1]
    done: dict[str, DataFrame] = {}
    sources = [*files.csv_files(spark, config.events), config.assignments, config.exposure, config.predictors]
    inputs = files.digests(spark, *sources)
    for k, name in enumerate(wanted, 1):
        made = globals()[f"_{name}"](spark, config, done)
        done[name] = files.write_once(made, f"{config.output}/{k:02d}_{name}", config.force)
    if files.digests(spark, *sources) != inputs:
        raise ValueError("inputs changed during the run")
    files.write_manifest(spark, f"{config.output}/manifest.json", inputs, {n: f.count() for n, f in done.items()}, through=through, threshold=config.threshold)
    return done


def _clean(spark, config, done):
    return events.clean(files.read_csv(spark, config.events))


def _fit(spark, config, done):
    own = done["clean"]
    counts = events.counts_and_means(own, "company", "permit_number", "sensor_uid")
    fits = tailfit.fits(own, config.threshold).withColumn("lambda_per_minute", F.exp("log_rate"))
    return counts.join(fits, ["company", "permit_number"], "left")


def _master(spark, config, done):
    read = lambda p: spark.read.option("header", True).csv(p)
    exposure = read(config.exposure).select("sensor_uid", F.col("monitoring_years").try_cast("double").alias("monitoring_years"))
    out = joins.checked_join(done["fit"].drop("company"), read(config.assignments), ["sensor_uid"], "inner", "one_to_one")
    out = joins.checked_join(out, exposure, ["sensor_uid"], "inner", "one_to_one").withColumn("events_per_year", F.col("event_count") / F.col("monitoring_years"))
    predictors = read(config.predictors).select("company", "uwwCode", *(F.col(c).try_cast("double").alias(c) for c in config.declared))
    return joins.preserving_join(out, predictors, ["company", "uwwCode"])


def _long(master: DataFrame, declared: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(o).alias("outcome"), F.lit(p).alias("predictor"), F.ln(F.when(F.col(o) > 0, F.col(o))).alias("y"), F.col(p).cast("double").alias("x")) for o in OUTCOMES for p in declared]
    return master.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def _univariate(spark, config, done):
    return regress.false_discovery(regress.simple(_long(done["master"], config.declared), ["outcome", "predictor"]), ["outcome"])


def _model(spark, config, done):
    master, rows = done["master"], []
    for outcome in OUTCOMES:
        own = models.hashed_split(master.where(F.col(outcome) > 0), "sensor_uid", config.seed)
        parts = {s: own.where(F.col("split") == s) for s in ("TRAIN", "VALIDATION", "TEST")}
        sizes = {s: f.count() for s, f in parts.items()}
        if min(sizes.values()) < 2:
            rows.append((outcome, sizes["TEST"], None, None, None, "too_few_rows"))
            continue
        y = F.ln(outcome)
        ready = models.prepare(parts["TRAIN"], config.declared)
        g = {s: models.grams(f, ready, y)[None] for s, f in parts.items()}
        alpha = models.held_out_alpha(g["TRAIN"], g["VALIDATION"])
        both = models.total({0: g["TRAIN"], 1: g["VALIDATION"]})
        rmse = lambda m: float(np.sqrt(m.sse(g["TEST"]) / g["TEST"].n))  # noqa: E731, B023
        rows.append((outcome, sizes["TEST"], alpha, rmse(models.solve(both, "ridge", alpha)), rmse(models.solve(both, "mean")), "evaluated"))
    return spark.createDataFrame(rows, "outcome string, n_test long, alpha double, rmse double, base_rmse double, status string")


def _report(spark, config, done):
    best = done["univariate"].where("q is not null").groupBy("outcome").agg(F.min_by("predictor", F.struct("q", "predictor")).alias("predictor"), F.min("q").alias("q"))
    return done["model"].join(best, "outcome", "left").withColumn("gain_pct", F.when(F.col("base_rmse") > 0, 100 * (F.col("base_rmse") - F.col("rmse")) / F.col("base_rmse")))
