"""Near-duplicate documents by min-max hashing: each permutation gives its minimum and its maximum to the signature."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix, shingle_sets, table, text_slices, trimmed
from .graph import link_rounds

#: 64 permutations give 128 signature values, banded by 4: at a similarity of 0.75 a pair misses all 32 bands with probability 5e-6.
PERMUTATIONS, ROWS, WIDTH = 64, 4, 5
#: So many candidate ids (8 bytes each) may be broadcast; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(75))
_A = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_BAND = np.random.Generator(np.random.PCG64(76)).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def minmax_signature(shingles: np.ndarray) -> np.ndarray:
    """128 values: the minima under the 64 permutations x -> A*x + B mod 2**32, then the maxima. One multiplication a shingle and permutation serves both."""
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        h = x[k : k + 2048, None] * _A[None, :] + _B[None, :]
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band. Bands take either minima or maxima, so no band holds both ends of a permutation."""
    rows = signature.reshape(-1, ROWS).astype(np.uint64)
    return mix((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


#: Longs of the bitmap that bounds an overlap before sets are fetched.
BITMAP = 16


def about(shingles: np.ndarray) -> np.ndarray:
    """The size of a set, and 1,024 bits, each the parity of the shingles that hash to it."""
    out = np.zeros(1 + BITMAP, np.uint64)
    out[0] = len(shingles)
    spread = mix(shingles + np.uint64(0x9E3779B97F4A7C15))
    np.bitwise_xor.at(out, 1 + (spread % np.uint64(BITMAP)).astype(np.int64), np.uint64(1) << (spread >> np.uint64(58)))
    return out.view(np.int64)


def may_link(a: Column, b: Column) -> Column:
    """Whether two sets can reach 100 * intersection >= 75 * union: every differing parity stands for a shingle of one of them alone, so no pair that does is lost. An id of several sets has no bitmap, and may link with any."""
    differ = F.lit(0)
    for k in range(1, 1 + BITMAP):
        differ = differ + F.bit_count(a[k].bitwiseXOR(b[k]))
    return F.coalesce(7 * differ <= a[0] + b[0], F.lit(True))


def _signatures(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in text_slices(batch, "text"):
            words, index = hash_words(data, offsets)
            sets = shingle_sets(words, index, WIDTH)
            n = len(sets)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            some = np.array([len(s) > 0 for s in sets])

            def lists(values: list[np.ndarray], width: int):
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * width)]).astype(np.int32)), pa.array(np.concatenate(values or [np.zeros(0, np.int64)])))

            yield pa.RecordBatch.from_arrays([ids.slice(row, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists([bands(minmax_signature(s)) for s in sets if len(s)], 2 * PERMUTATIONS // ROWS), lists([about(s) for s in sets if len(s)], 1 + BITMAP)], names=["doc_id", "n_shingles", "cls", "bands", "about"])


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in text_slices(batch, "text"):
            sets = shingle_sets(*hash_words(data, offsets), WIDTH)
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def _confirmed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = []
        for x, y in zip(left, right, strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([s, t])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= 75 * (len(both) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text; other columns are ignored).

    Texts are lower-cased (A-Z) and cut into words; a document's set holds its distinct 5-word shingles (64-bit hashes),
    the whole sequence where it has fewer words. Documents with 100 * intersection >= 75 * union link; component_id is
    the smallest doc_id that links reach. Null, empty and blank texts have an empty set and link with nothing. Documents
    with equal sets (exact copies among them) collapse to one class before the bands are shuffled, so a group of copies
    costs one signature row; the classes of a band's bucket whose bitmaps leave a link possible are compared by hub rounds (see
    graph.link_rounds), each link confirmed on full sets. Rows with one doc_id are one vertex, which links wherever one of
    their texts does, and each is answered; one without words stands for itself. A null doc_id is answered with a null component unless its copies have ids.
    A text of any length is taken whole and must fit a task. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.write(slim.mapInArrow(trimmed(_signatures), "doc_id long, n_shingles long, cls binary, bands array<long>, about array<long>"))
    reps = scratch.write(signed.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("about").alias("about")))
    keys = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch.write(keys.join(shared, "key"))
    sizes = reps.groupBy(F.col("rep").alias("id")).agg(F.when(F.count("*") == 1, F.first("about")).alias("about"))
    degree = scratch.write(members.groupBy("id").agg(F.sum("c").alias("deg")).join(sizes, "id"))
    members = scratch.write(members.join(degree, "id").select("key", "id", "deg", "about"))
    degree = degree.select("id")
    few = degree.count() <= BROADCAST_IDS
    chosen = slim.join(F.broadcast(degree) if few else degree, F.col("doc_id") == F.col("id"), "left_semi")
    sets = scratch.write(chosen.mapInArrow(trimmed(_sets), "id long, shingles binary"))

    def verify(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b")
        sized = both.where("4 * least(length(s), length(t)) >= 3 * greatest(length(s), length(t))")
        return sized.select("a", "b", "s", "t").mapInArrow(trimmed(_confirmed), "a long, b long")

    # an id of several sets joins their classes
    several = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("doc_id")
    several = scratch.write(several)
    bridges = None
    if not several.isEmpty():
        of = signed.where("n_shingles > 0").select("doc_id", "cls").join(several, "doc_id").join(reps.select("cls", "rep"), "cls")
        bridges = scratch.write(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
    labels = link_rounds(scratch, members, verify, may_link, bridges)
    found = reps.select("cls", "rep")
    if labels is not None:
        found = found.join(labels, F.col("rep") == F.col("id"), "left").select("cls", F.coalesce("label", "rep").alias("component_id"))
    else:
        found = found.select("cls", F.col("rep").alias("component_id"))
    found = scratch.write(found)
    joined = signed.select("doc_id", "n_shingles", "cls").join(found, "cls", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
