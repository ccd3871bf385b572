"""Quality gates: named violations counted in one aggregate, reported as rows or as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite


def violations(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(gate, violations, passed) for each rule, a predicate that must hold; null counts as a violation. One pass over the frame."""
    one = frame.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(f"`{n}`").alias("violations")) for n in rules)))
    return one.select(rows.alias("r")).select("r.gate", "r.violations", (F.col("r.violations") == 0).alias("passed"))


def uniqueness(frame: DataFrame, name: str, *keys: str) -> DataFrame:
    """The gate that keys are unique and not null."""
    bad = frame.groupBy(*keys).agg(F.count("*").alias("n")).where(" or ".join(["n > 1", *(f"`{k}` is null" for k in keys)]))
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations", (F.col("violations") == 0).alias("passed"))


def messages(*gates: DataFrame) -> list[str]:
    """The failed gates as text, all of them, so that nothing is written on a partial look."""
    return [f"{r['gate']}: {r['violations']} violations" for g in gates for r in g.where("not passed").orderBy("gate").collect()]


def demand(*gates: DataFrame) -> None:
    if found := messages(*gates):
        raise ValueError("; ".join(found))


def percent(*columns: str, slack: float = 1e-6) -> dict[str, Column]:
    return {f"{c} in 0..100": F.col(c).isNull() | F.col(c).between(-slack, 100 + slack) for c in columns}


def composition(parts: list[str], total: str, slack: float = 1e-6) -> dict[str, Column]:
    """Parts sum to the total."""
    return {f"parts sum to {total}": F.abs(sum((F.col(p) for p in parts[1:]), F.col(parts[0])) - F.col(total)) <= slack}


def event_contract(events: DataFrame) -> list[str]:
    need = ("company", "permit_number", "location_name", "start_time", "stop_time")
    return [f"events: missing column {c}" for c in need if c not in events.columns]


def input_contracts(assignments: DataFrame, exposure: DataFrame, predictors: DataFrame, declared: list[str]) -> list[str]:
    """Problems of the three side inputs, as a list."""
    out = [f"predictors: missing column {c}" for c in ("company", "uwwCode", *declared) if c not in predictors.columns]
    evidence = {"assignments: evidence not blank": F.trim(F.coalesce("assignment_evidence", F.lit(""))) != ""}
    years = {"exposure: monitoring_years finite and positive": finite(F.col("monitoring_years")) & (F.col("monitoring_years") > 0)}
    gates = [uniqueness(assignments, "assignments: sensor_uid unique", "sensor_uid"), violations(assignments, evidence), uniqueness(exposure, "exposure: sensor_uid unique", "sensor_uid"), violations(exposure, years)]
    if not out:
        gates.append(uniqueness(predictors, "predictors: (company, uwwCode) unique", "company", "uwwCode"))
    return out + messages(*gates)


def master_rules(threshold: float = 240.0) -> dict[str, Column]:
    """What a sensor master must hold."""
    c = F.col
    return {
        "uid names company and permit": c("sensor_uid") == F.concat_ws("::", "company", "permit_number"),
        "one threshold": c("threshold") == threshold,
        "fitted beta in bounds": c("beta").isNull() | c("beta").between(0.01, 2.0),
        "interval ordered": c("ci_low").isNull() | (c("ci_low") <= c("ci_high")),
        "tail within events": c("tail_count") <= c("total_count"),
        "strict betas are eligible": (c("beta_quality") == "strict_quality_beta") == c("eligible_for_beta"),
        "problems have issues": (c("issue_type") != "") | ((c("coordinate_status") == "valid") & (c("beta_quality") == "strict_quality_beta")),
    }


def unchanged(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """The gate that protected columns hold the same rows, copies counted."""
    a, b = before.select(*columns), after.select(*columns)
    lost = a.exceptAll(b).unionByName(b.exceptAll(a))
    return lost.agg(F.count("*").alias("violations")).select(F.lit("protected columns unchanged").alias("gate"), "violations", (F.col("violations") == 0).alias("passed"))


def invariant(select, frame: DataFrame, hidden: list[str]) -> bool:
    """Whether a selection gives the same rows with outcome columns dropped."""
    a, b = select(frame), select(frame.drop(*hidden))
    return a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()
