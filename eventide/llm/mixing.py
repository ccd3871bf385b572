"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, named, table

MARGINS = ("source", "lang", "topic")
#: Up to so many cells are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class Targets:
    """Target shares. A margin's values not named share `rest` in proportion to tokens ** temper; tempered margins name none."""

    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.9, "legal": 0.1})
    source: dict[str, float] = field(default_factory=dict)
    rest: float = 0.05
    temper: float = 0.7
    #: The expected share of all tokens that the sample keeps.
    budget: float = 0.8
    sweeps: int = 12


PRODUCTION = Targets()


def tokens_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the whole text; an empty one counts as one token, so that every document has a weight."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("long")


def topic_of(text: Column) -> Column:
    """legal: a license line stands in the text; prose: any other."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("license") | t.contains("all rights reserved"), "legal").otherwise("prose")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the document's id: the first 48 bits of its md5."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48), F.lit(0.0))


def weighted_cells(cells: DataFrame, targets: Targets) -> DataFrame:
    """cells (source, lang, topic, t) with w, the raked token weight, and rate, the sampling probability of the cell's documents.

    The cell table has one row for each combination of the margins' values that occurs, a few hundred; it lies in one
    partition, so the sweeps run as windows of a single task without a shuffle. Each sweep scales the weights to the
    source, then language, then topic marginals. Rates are proportional to w / t, scaled so that the expected sample
    holds `budget` of all tokens, cells that reach probability 1 giving their excess to the others.
    """
    everything = Window.partitionBy(F.lit(1))
    out = cells.repartition(1).withColumn("w", F.col("t").cast("double"))
    for margin in MARGINS:
        own = Window.partitionBy(margin)
        out = out.withColumn("p", F.pow(F.sum("t").over(own), F.lit(targets.temper))).withColumn("n", F.count("*").over(own))
        wanted = F.col("p")
        if named := getattr(targets, margin):
            share = F.lit(None).cast("double")
            for value, part in named.items():
                share = F.when(F.col(margin) == value, F.lit(float(part))).otherwise(share)
            out = out.withColumn("named", share).withColumn("other", F.when(F.col("named").isNull(), F.col("p") / F.col("n")))
            wanted = F.coalesce("named", F.lit(targets.rest) * F.col("p") / F.sum("other").over(everything))
        out = out.withColumn("x", wanted).withColumn("part", F.col("x") / F.col("n"))
        out = out.withColumn(f"{margin}_share", F.col("x") / F.sum("part").over(everything)).select(*MARGINS, "t", "w", *(c for c in out.columns if c.endswith("_share")), f"{margin}_share")
    out = out.withColumn("total", F.sum("t").over(everything).cast("double"))
    for _ in range(targets.sweeps):
        for margin in MARGINS:
            out = out.withColumn("w", F.col("w") * F.col(f"{margin}_share") * F.col("total") / F.sum("w").over(Window.partitionBy(margin)))
    ranked = Window.orderBy(F.desc("f"), *MARGINS)
    out = out.withColumn("f", F.col("w") / F.col("t"))
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("full", F.coalesce(F.sum("t").over(before), F.lit(0)).cast("double")).withColumn("open", F.sum("w").over(after))
    out = out.withColumn("scale", (F.lit(targets.budget) * F.col("total") - F.col("full")) / F.col("open"))
    # the first cells by f are certain; from the first whose scaled rate is at most 1, one scale holds for all
    fits = F.when(F.col("scale") * F.col("f") <= 1, F.col("scale"))
    out = out.withColumn("scale", F.first(fits, ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rate = F.least(F.lit(1.0), F.coalesce(F.col("scale") * F.col("f"), F.lit(1.0)))
    return out.select(*MARGINS, "t", "w", F.round(rate, 9).alias("rate"))


def _key(margin: str) -> Column:
    return F.coalesce(F.col(margin).cast("string"), F.lit(""))


def _sized(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells, written once, and marked for a broadcast where their count allows it."""
    cells = Scratch(docs.sparkSession, "mixing").write(cells)
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def cells_of(docs: DataFrame, targets: Targets = PRODUCTION, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    """The cells (source, lang, topic) of docs with their tokens t, raked weights w and rates."""
    rows = docs.select(_key("source").alias("source"), _key("lang").alias("lang"), topic(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"))
    return weighted_cells(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("t")), targets)


def residuals(cells: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """margin, value, wanted, reached and residual, their distance, of each named target that occurs, and of each source: how far the sweeps came.

    A residual that stays large says that the targets can't be met together with these cells.
    """
    parts = []
    for margin in MARGINS:
        sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
        power = F.pow(F.col("t"), F.lit(targets.temper))
        if named := getattr(targets, margin):
            share = F.lit(None).cast("double")
            for value, part in named.items():
                share = F.when(F.col("value") == value, F.lit(float(part))).otherwise(share)
            # values without a target share the rest; those named that don't occur leave theirs to all
            other = F.sum(F.when(share.isNull(), power)).over(Window.partitionBy(F.lit(1)))
            sums = sums.withColumn("x", F.coalesce(share, F.lit(targets.rest) * power / other))
        else:
            sums = sums.withColumn("x", power)
        sums = sums.withColumn("wanted", F.col("x") / F.sum("x").over(Window.partitionBy(F.lit(1))))
        reached = F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))
        parts.append(sums.select(F.lit(margin).alias("margin"), "value", "wanted", reached.alias("reached"), F.abs(reached - F.col("wanted")).alias("residual")))
    return parts[0].union(parts[1]).union(parts[2])


def mixed(docs: DataFrame, targets: Targets = PRODUCTION, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, rate and kept for every row of docs (doc_id, text, source, lang).

    n_tokens counts the words of the whole text. weight is the document's calibrated token weight, n_tokens times the
    raked weight of its cell over the cell's tokens; topic makes a document's topic from its text, a function of columns;
    kept says whether the id's uniform number lies below the cell's
    rate. Documents of a repeated id stay or go together. A null source or lang is the value ''; a null or empty text is
    one token of prose; a null id has the number 0 and stays. An empty table gives no rows. The corpus is read twice,
    once for the cells' sums, which are pre-aggregated in each task, so a source with a third of all rows costs no
    skew; up to 100,000 cells come back by a broadcast, more by a shuffle join.
    """
    rows = docs.select(F.col("doc_id"), _key("source").alias("source"), _key("lang").alias("lang"), topic(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"))
    cells = _sized(docs, weighted_cells(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("t")), targets))
    out = rows.join(cells, list(MARGINS))
    return out.select("doc_id", *MARGINS, "n_tokens", (F.col("n_tokens") * F.col("w") / F.col("t")).alias("weight"), "rate", (uniform(F.col("doc_id")) < F.col("rate")).alias("kept"))


def sampled(docs: DataFrame, targets: Targets = PRODUCTION, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    """The kept rows of docs with all their columns, whatever their names; nulls, ties and repeats as in `mixed`."""
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.struct(_key("source").alias("source"), _key("lang").alias("lang"), topic(F.col("text")).alias("topic")).alias("cell"))
    sums = rows.groupBy("cell").agg(F.sum(tokens_of(F.col("row.text"))).alias("t")).select("cell.*", "t")
    cells = _sized(docs, weighted_cells(sums, targets)).select(F.struct(*MARGINS).alias("cell"), "rate")
    return rows.join(cells, "cell").where(uniform(F.col("row.doc_id")) < F.col("rate")).select(*(named(c, "row.") for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.withColumn("weight", F.round("weight", 4)).withColumn("rate", F.round("rate", 6))


def oracle(targets: Targets = PRODUCTION) -> str:
    """The same in DuckDB: a chain of common tables, one for each scaling."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE WHEN contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'all rights reserved') THEN 'legal' ELSE 'prose' END AS topic, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS n_tokens FROM documents)",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        named = getattr(targets, m)
        parts.append(f"{m}_t AS (SELECT {m}, pow(sum(t), {targets.temper}) AS p FROM c GROUP BY {m})")
        if named:
            inside = ", ".join(map(quoted, named))
            case = " ".join(f"WHEN {m} = {quoted(k)} THEN {float(v)}" for k, v in named.items())
            parts.append(f"{m}_x AS (SELECT {m}, CASE {case} ELSE {targets.rest} * p / sum(CASE WHEN {m} NOT IN ({inside}) THEN p END) OVER () END AS x FROM {m}_t)")
        else:
            parts.append(f"{m}_x AS (SELECT {m}, p AS x FROM {m}_t)")
        parts.append(f"{m}_s AS (SELECT {m}, x / sum(x) OVER () AS {m}_share FROM {m}_x)")
    parts.append("w0 AS MATERIALIZED (SELECT c.*, t AS w, source_share, lang_share, topic_share, sum(t) OVER () AS total FROM c JOIN source_s USING (source) JOIN lang_s USING (lang) JOIN topic_s USING (topic))")
    n = 0
    for _ in range(targets.sweeps):
        for m in MARGINS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (w * {m}_share * total / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{n})")
            n += 1
    parts += [
        f"f AS (SELECT *, w / t AS f FROM w{n})",
        f"g AS (SELECT *, ({targets.budget} * total - coalesce(sum(t) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM f)",
        "h AS (SELECT arg_max(scale, f) AS scale FROM g WHERE scale * f <= 1)",
        "r AS (SELECT source, lang, topic, t, w, round(least(1.0, coalesce((SELECT scale FROM h) * f, 1.0)), 9) AS rate FROM g)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(n_tokens * w / t, 4) AS weight, round(rate, 6) AS rate, coalesce(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) / {float(1 << 48)}, 0.0) < rate AS kept FROM d JOIN r USING (source, lang, topic)"
