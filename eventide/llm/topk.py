"""Exact top-k by integer inner product with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, trimmed

#: Bounded, documented samples: the pivots, and the rows whose scores give each query a first bound.
PIVOTS, SEEDS = 64, 2048
#: Vectors in a shard, in an annulus of a shard, and queries in a block.
SHARD, ANNULUS, BLOCK = 8192, 512, 1024
#: Up to so many annuli their summaries (44 bytes each) are broadcast.
BROADCAST_RINGS = 200_000


def quantized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component as long; vectors that are null or hold null or non-finite components drop."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias(column)).where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c * 64.0).cast("long")).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows as one matrix, shorter ones filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every partial sum stays below 2**53, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Best:
    """The k highest scores of each query so far, ties to smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.found = k, []
        self.top = np.full((queries, k), np.iinfo(np.int64).min)
        self.floor = floor.copy()

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, col = np.nonzero(scores >= self.floor[rows][:, None])
        if not len(at):
            return
        self.found.append((rows[at], ids[col], scores[at, col]))
        both = np.concatenate([self.top[rows], scores], axis=1)
        self.top[rows] = np.partition(both, -self.k, axis=1)[:, -self.k :]
        self.floor[rows] = np.maximum(self.floor[rows], self.top[rows].min(axis=1))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        q, i, s = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = s >= self.floor[q]
        q, i, s = q[keep], i[keep], s[keep]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < self.k], i[place < self.k], s[place < self.k]


NONE = np.iinfo(np.int64).min


def bounds(q: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each query and annulus a number that no inner product of the two exceeds.

    For x in an annulus, |q - x| is at least the gap between |q - p| and [lo, hi], so q.x is at most
    (|q|^2 + norm^2 - gap^2) / 2; and at most |q| norm. Room for rounding is added.
    """
    q, pivots = q.astype(np.float64), pivots.astype(np.float64)
    size = (q**2).sum(axis=1)
    far = np.sqrt(np.maximum(size[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * q @ pivots.T, 0))
    gap = np.maximum(np.maximum(far[:, pivot] - hi[None, :], lo[None, :] - far[:, pivot]), 0)
    bound = np.minimum((size[:, None] + norm[None, :] ** 2 - gap**2) / 2, np.sqrt(size)[:, None] * norm[None, :])
    return bound + 1e-9 * (size[:, None] + norm[None, :] ** 2) + 1e-6


def expand(mine: np.ndarray, q: np.ndarray, annuli: list[dict], pivots: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """Queries against annuli (pivot, lo, hi, norm, ids, keys, x): nearest bound first, and for each query until no bound reaches its k-th score.

    mine: each query's key; a candidate of the same key is left out. An annulus is left out only where its bound is
    below the k-th score: a tie could still win by its id.
    """
    best = Best(len(q), k, floor)
    bound = bounds(q, pivots, *(np.array([a[c] for a in annuli]) for c in ("pivot", "lo", "hi", "norm")))
    for j in np.argsort(-bound.max(axis=0), kind="stable"):
        open_ = np.flatnonzero((bound[:, j] >= best.floor) | (best.floor == NONE))
        if not len(open_):
            continue
        scores = products(q[open_], annuli[j]["x"])
        scores[mine[open_][:, None] == annuli[j]["keys"][None, :]] = NONE
        best.add(open_, annuli[j]["ids"], scores)
    return best


def top_k(vectors: DataFrame, queries: DataFrame | str, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k vectors of the highest inner product, ties to the smaller vec_id.

    vectors: (vec_id, v array<long>), as `quantized` gives them. queries: a condition that picks rows of vectors, each of
    which is compared with every row but itself; or a frame like vectors, whose rows are compared with every row of
    another vec_id. Every row is a query or a candidate of its own, also one that repeats; shorter vectors count as
    filled with zeros. Fewer candidates than k give fewer rows; an empty table gives none; other columns aren't read.

    Each vector is keyed by its nearest pivot and the distance to it; ranges of that key are shards of about 8,192
    vectors, cut into annuli of 512. Queries are packed into blocks of 1,024 by the same key. The bounds of blocks and
    annuli are compared first, by the annuli's summaries alone, and only annuli that can hold a result of a block travel
    to it. A shard returns a block's k best, which a window with a limit merges. The pivots (64), the seeds (2,048 rows,
    whose k-th score is each query's first bound) and up to 200,000 summaries are broadcast; beyond that number every
    annulus travels to every block. Nothing that could enter a result is left out, so recall is 1 whatever the sample.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    # rows get a number that lasts, as the table is written
    vectors = scratch.write(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()))
    found = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if not found["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    itself = isinstance(queries, str)
    asked = vectors.where(queries) if itself else scratch.write(queries.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()))
    width = max(1, found["width"])
    kind = np.dtype("<i2" if (found["most"] or 0) < 1 << 15 else "<i4" if found["most"] < 1 << 31 else "<i8")
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "row").limit(SEEDS).collect()
    seeds = _matrix([r["v"] for r in sample], width)
    fixed = spark.sparkContext.broadcast((np.array([r["row" if itself else "vec_id"] for r in sample], np.int64), seeds, np.unique(seeds[:PIVOTS], axis=0)))

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = fixed.value[2].astype(np.float64)
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            square = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T
            near = square.argmin(axis=1)
            away = np.sqrt(((x - p[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(away)], names=["vec_id", "v", "row", "pivot", "away"])

    def dealt(frame: DataFrame, parts: int) -> DataFrame:
        order = ["pivot", "away", "vec_id", "row"]
        return frame.mapInArrow(trimmed(keyed), "vec_id long, v array<long>, row long, pivot int, away double").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def annuli(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, ring = TaskContext.get().partitionId(), 0

        def pack(rows: list) -> "pa.RecordBatch":
            nonlocal ring
            x = _matrix([r[1] for r in rows], width)
            away = [r[4] for r in rows]
            norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
            ring += 1
            ids, own = (np.array([r[c] for r in rows], np.int64) for c in (0, 2))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "ring": pa.array([(shard << 32) + ring], pa.int64()), "pivot": pa.array([rows[0][3]], pa.int32()), "lo": [min(away)], "hi": [max(away)], "norm": [norm], "ids": [ids.tobytes()], "keys": [(own if itself else ids).tobytes()], "x": [x.astype(kind).tobytes()]})

        rows: list = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (r[3] != rows[-1][3] or len(rows) == ANNULUS):
                    yield pack(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield pack(rows)

    index = scratch.write(dealt(vectors, max(1, -(-found["n"] // SHARD))).mapInArrow(trimmed(annuli), "shard int, ring long, pivot int, lo double, hi double, norm double, ids binary, keys binary, x binary"))
    rings = index.select("ring", "shard", "pivot", "lo", "hi", "norm")
    few = rings.count() <= BROADCAST_RINGS
    known = [np.array(c) for c in zip(*(tuple(r) for r in rings.collect()), strict=True)] if few else None
    summaries = spark.sparkContext.broadcast(known)

    def packed(batches: Iterator) -> Iterator:
        """Blocks of queries, each with the shards, and the annuli, that can hold a result of one of them."""
        import pyarrow as pa
        from pyspark import TaskContext

        own, seeds, pivots = fixed.value
        number = TaskContext.get().partitionId() << 32

        def block(rows: list) -> "pa.RecordBatch":
            nonlocal number
            q = _matrix([r[1] for r in rows], width)
            ids, mine = (np.array([r[c] for r in rows], np.int64) for c in (0, 2))
            first = products(q, seeds)
            first[(mine if itself else ids)[:, None] == own[None, :]] = NONE
            floor = np.partition(first, -k, axis=1)[:, -k] if len(seeds) > k else np.full(len(q), NONE)
            wanted: list[np.ndarray] = []
            if summaries.value is not None:
                ring, shard, *about = summaries.value
                for a in range(0, len(ring), 2048):
                    bound = bounds(q, pivots, *(c[a : a + 2048] for c in about))
                    wanted.append(a + np.flatnonzero(((bound >= floor[:, None]) | (floor == NONE)[:, None]).any(axis=0)))
            at = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
            lists = [ring[at], np.unique(shard[at]).astype(np.int32)] if summaries.value is not None else [np.zeros(0, np.int64), np.zeros(0, np.int32)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids.tobytes()]), pa.array([mine.tobytes()]), pa.array([q.astype("<i8").tobytes()]), pa.array([floor.astype("<i8").tobytes()]), pa.array([lists[0]], pa.list_(pa.int64())), pa.array([lists[1]], pa.list_(pa.int32()))], names=["block", "ids", "mine", "q", "floor", "rings", "shards"])

        rows: list = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(r)
                if len(rows) == BLOCK:
                    yield block(rows)
                    rows = []
        if rows:
            yield block(rows)

    blocks = scratch.write(dealt(asked, max(1, -(-asked.count() // BLOCK))).mapInArrow(trimmed(packed), "block long, ids binary, mine binary, q binary, floor binary, rings array<long>, shards array<int>"))
    if few:
        sides = blocks.drop("rings").withColumn("shard", F.explode("shards")).drop("shards")
        index = index.join(blocks.select("block", F.explode("rings").alias("ring")), "ring")
    else:
        shards = index.agg(F.max("shard")).first()[0] + 1
        sides = blocks.drop("rings", "shards").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        # one number a block: a stated query set against all rows, in blocks
        index = index.join(sides.select("block", "shard"), "shard")
    sides = sides.select("block", "shard", "ids", "mine", "q", "floor").toDF("block", "shard", "ids", "mine", "q", "floor")
    index = index.select("block", "shard", "pivot", "lo", "hi", "norm", "ids", "keys", "x").toDF("block", "shard", "pivot", "lo", "hi", "norm", "ids", "keys", "x")

    def search(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "query", "vec_id", "score")})
        [one] = left.select(["ids", "mine", "q", "floor"]).to_pylist()
        ids, mine, floor = (np.frombuffer(one[c], "<i8") for c in ("ids", "mine", "floor"))
        q = np.frombuffer(one["q"], "<i8").reshape(-1, width)
        rings = [r | {"ids": np.frombuffer(r["ids"], np.int64), "keys": np.frombuffer(r["keys"], np.int64), "x": np.frombuffer(r["x"], kind).reshape(-1, width).astype(np.int64)} for r in right.select(["pivot", "lo", "hi", "norm", "ids", "keys", "x"]).to_pylist()]
        rows, found, scores = expand(mine if itself else ids, q, rings, fixed.value[2], floor, k).rows()
        keep = scores > NONE
        rows = rows[keep]
        return pa.table({"query_id": ids[rows], "query": mine[rows], "vec_id": found[keep], "score": scores[keep]})

    got = sides.groupBy("block", "shard").cogroup(index.groupBy("block", "shard")).applyInArrow(search, "query_id long, query long, vec_id long, score long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantized(table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0")


#: Integer products are exact, so the whole result can be said in SQL; the driver runs it on the small tables.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
