"""Corpus pipeline over the documents table; each stage calls one operator of eventide.llm.

Each stage takes what its predecessor kept. A stage that reads its input more than once reads the table written by the
stage before it. What holds for all: an empty table gives an empty one; all columns come through, whatever their names,
but for text and n_chars, which line_dedup makes anew, and the last stage's; rows that repeat are judged each, unless
the stage says otherwise; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import lines, minhash, mixing, packing, quality
from eventide.llm.common import Scratch, named, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose voted quality score reaches the threshold.

    A null, empty or blank text gets the share of good labels, as does every text where no label is known (0.5); at the
    threshold a document stays. A null doc_id is scored like any other.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their lines that repeat an earlier one, n_chars, if there is one, counted anew; a document of which no word is left goes.

    Earlier is by (doc_id, line). Rows without doc_id and null or empty texts lose nothing and stay; of rows of one doc_id
    lines at the same number are at one place, so rows that repeat stay alike.
    """
    lines_of, n = unused(docs, "lines"), docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    out = lines.cleaned(docs, lines_of)
    out = out.where(F.col(lines_of).isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if n is not None:
        out = out.withColumn("n_chars", F.when(F.col(lines_of).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(n)))
    return out.select(*map(named, docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates.

    A row without doc_id counts as a document of its own, later than all that have one: it goes if its set equals or
    links with another's that stays, and one of a group in which none has an id is kept, as is one that is nobody's copy.
    Rows of one doc_id go or stay together, and null, empty and blank texts are nobody's copies.
    """
    own, number = F.col("doc_id").cast("long"), unused(docs, "number")
    found = docs.agg(F.max(own).alias("last"), F.count_if(own.isNull()).alias("without")).first()
    if found["without"]:
        # written, so that the rows keep the numbers given here
        later = F.lit((found["last"] or 0) + 1) + F.monotonically_increasing_id()
        own_ids = Scratch(spark, "near").write(docs.withColumn(number, F.coalesce(own, later)))
    else:
        own_ids = docs.withColumn(number, own)
    kept = minhash.near_duplicates(own_ids.select(F.col(number).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(number)).distinct()
    return own_ids.join(kept, number, "left_semi").select(*map(named, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their calibrated probabilities.

    A null source or lang is the value ''; a null or empty text counts as one token; rows of one doc_id stay or go
    together, and those without one stay.
    """
    return mixing.sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they are packed into; a null or empty text is its end token alone, and a null doc_id stays null."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The first stage's model and the last stage's tokenizer can't be said in SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        made = len(Scratch.made)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
            # what the stage wrote on its way, and what it read, isn't needed any more
            Scratch.sweep(made)
            if k:
                scratch.drop(before)
            before = docs
    return docs
