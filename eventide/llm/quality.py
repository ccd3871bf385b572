"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, SEPARATOR, hash_words, mix, table, text_slices, trimmed

#: The bound on the labelled rows that are fitted: so many of either label, taken by the hash of their ids.
SAMPLE_A_LABEL = 2048
TERMS, LATENT, NEIGHBOURS, THRESHOLD = 1024, 48, 25, 0.7

#: Byte classes of a word's shape: small, capital, digit, beyond ASCII; any other byte is its own class.
_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed counts for each text, a row each: word shapes (runs of a byte class count once), pairs of neighbouring shapes and whether a word repeats the one before."""
    docs, n = len(offsets) - 1, len(data)
    out = np.zeros((docs, TERMS), np.float32)
    if not n:
        return out
    word = ~SEPARATOR[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[offsets < n]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return out
    kind = _CLASS[data]
    run = word.copy()
    run[1:] &= (kind[1:] != kind[:-1]) | first[1:]
    run[starts] = True
    where = np.flatnonzero(run)
    begin = np.searchsorted(where, starts)
    place = np.minimum(np.arange(len(where)) - np.repeat(begin, np.diff(np.append(begin, len(where)))), 15)
    power = np.multiply.accumulate(np.full(17, BASE, np.uint64))
    shape = mix(np.add.reduceat(kind[where] * power[place], begin))
    content, _ = hash_words(data, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    same_doc = doc[1:] == doc[:-1]
    same = (content[1:] == content[:-1]) & same_doc
    pair = mix(shape[:-1] * np.uint64(3) + shape[1:] * np.uint64(5))[same_doc]
    repeats = np.where(same, np.uint64(11), np.uint64(13))[same_doc]
    for terms, rows in ((shape, doc), (pair, doc[1:][same_doc]), (mix(repeats), doc[1:][same_doc])):
        out += np.bincount(rows * TERMS + (terms % np.uint64(TERMS)).astype(np.int64), minlength=docs * TERMS).reshape(docs, TERMS)
    return out


@dataclass
class Model:
    """What is broadcast; its size has the bound 2 * SAMPLE_A_LABEL * LATENT floats and TERMS * LATENT floats."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    votes: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * self.weight
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Each row's neighbours by exact cosine, their labels weighted by similarity and by how the sample thins each label."""
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for a in range(0, len(some), 512):
            rows = some[a : a + 512]
            cosine = self.latent(counts[rows]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            of = np.take_along_axis(cosine, near, axis=1)
            weight = np.maximum(of, 1e-6).astype(np.float64) ** 8 * self.votes[near]
            out[rows] = (weight * self.good[near]).sum(axis=1) / weight.sum(axis=1)
            tied = np.flatnonzero((cosine >= of.min(axis=1, keepdims=True)).sum(axis=1) > k)
            for r in tied.tolist():  # neighbours that tie at the last place all vote
                at = np.flatnonzero(cosine[r] >= of[r].min())
                weight = np.maximum(cosine[r, at], 1e-6).astype(np.float64) ** 8 * self.votes[at]
                out[rows[r]] = (weight * self.good[at]).sum() / weight.sum()
        return out


def fit(counts: np.ndarray, good: np.ndarray, share_good: float) -> Model:
    """Latent axes by the singular vectors of square-rooted, rarity-weighted term shares; share_good: the share of label 1 before the sample evened the labels."""
    if not len(counts):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), good, good, 0.5)
    weight = np.log(1 + (1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    x = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * weight
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    model = Model(weight, np.ascontiguousarray(axes[:, ::-1][:, :LATENT]).astype(np.float32), None, good.astype(np.float64), None, share_good)
    model.vectors = model.latent(counts).astype(np.float32)
    sampled = good.mean()
    model.votes = np.where(good == 1, share_good / max(sampled, 1e-9), (1 - share_good) / max(1 - sampled, 1e-9))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for row, data, offsets in text_slices(batch, "text"):
            counts = term_counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), pa.array([c.tobytes() for c in counts], pa.binary())], names=["doc_id", "counts"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from at most SAMPLE_A_LABEL ids of each label that aren't held out; the shares of the labels are counted over all of those.

    An id whose labels disagree counts for none; of an id's texts, if several, one is taken whatever their order.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    count = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = [r for q in count for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_A_LABEL).collect()]
    if not picked:
        return fit(np.zeros((0, TERMS), np.float32), np.zeros(0), 0.5)
    quality = {r["doc_id"]: r["quality"] for r in picked}
    ids = docs.sparkSession.createDataFrame([(i,) for i in quality], "doc_id long")
    rows = _slim(docs).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(trimmed(_counted), "doc_id long, counts binary").groupBy("doc_id").agg(F.min("counts").alias("counts")).collect()
    rows = sorted((r["doc_id"], bytes(r["counts"])) for r in rows)
    counts = np.stack([np.frombuffer(c, np.float32) for _, c in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return fit(counts, np.array([quality[i] for i, _ in rows], dtype=np.float64), count.get(1, 0) / sum(count.values()))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    score is the share of similarity-weighted votes for label 1 among the exactly nearest labelled vectors, over the
    whole text. A null, empty or blank text has no vector and gets the share of label 1; so does every text where no
    label is known (0.5). Labels of held-out rows aren't read; lang, source and doc_id are no inputs. Repeated rows are
    scored each and alike; neighbours that tie at the last place all vote. A text of any length is taken whole and must
    fit a task; an empty table gives no rows; other columns aren't read. The labelled vectors are broadcast: their number
    is bounded by 2 * SAMPLE_A_LABEL.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, data, offsets in text_slices(batch, "text"):
                got = np.clip(model.value.score(term_counts(data, offsets)), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(got)), pa.array(got)], names=["doc_id", "score"])

    out = _slim(docs).mapInArrow(trimmed(score), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, with all their columns; scoring happens where the row lies, without a join."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, data, offsets in text_slices(batch, batch.schema.names[at]):
                good = model.value.score(term_counts(data, offsets)) >= threshold
                yield batch.slice(row, len(good)).filter(pa.array(good))

    # columns travel by plain names, as theirs may hold dots
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(trimmed(keep), plain.schema).toDF(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
