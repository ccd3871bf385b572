"""Near-duplicate vectors by an inverted multi-index: the product grid of two codebooks, its nearest cells visited, links verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, trimmed
from .graph import components

#: The bounded samples: vectors that the codebooks are fitted on, and made pairs that the number of cells is set by.
SAMPLE, PAIRS = 4096, 2048
#: The share of made pairs at exactly the threshold, the farthest that link, whose cells must be visited.
RECALL = 0.995
MOST_WORDS = 64
#: Rows of a block on either side, and visitors that are compared in one step.
CELL_ROWS, PROBE_ROWS, STEP = 4096, 16384, 512
#: Up to so many blocks the parts of their visitors are broadcast (8 bytes each).
BROADCAST_BLOCKS = 200_000


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres by Lloyd's iterations."""
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        near = distances(x, words).argmin(axis=1)
        for j in range(k):
            if (own := near == j).any():
                words[j] = x[own].mean(axis=0)
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (words**2).sum(axis=1)[None, :] - 2 * x @ words.T


class Grid:
    """Two codebooks of k words over the halves of unit vectors; cell i * k + j."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float):
        rng = np.random.default_rng(17)
        self.half, self.k = (sample.shape[1] + 1) // 2, min(k, len(sample))
        self.words = [codebook(part, self.k, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.visited = self._calibrate(sample, threshold, rng)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [distances(x[:, : self.half], self.words[0]), distances(x[:, self.half :], self.words[1])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.halves(x)
        return one.argmin(axis=1) * self.k + two.argmin(axis=1)

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` nearest cells of each vector, from the nearest on, by multi-sequence traversal.

        With both halves' words sorted by distance, the pair of ranks (a, b) is preceded by (a + 1)(b + 1) - 1 others, so
        only the staircase (a + 1)(b + 1) <= most is looked at.
        """
        one, two = self.halves(x)
        first, second = one.argsort(axis=1, kind="stable"), two.argsort(axis=1, kind="stable")
        a, b = np.nonzero(np.outer(np.arange(1, self.k + 1), np.arange(1, self.k + 1)) <= most)
        total = np.take_along_axis(one, first[:, a], axis=1) + np.take_along_axis(two, second[:, b], axis=1)
        best = total.argsort(axis=1, kind="stable")[:, :most]
        return (np.take_along_axis(first[:, a], best, axis=1) * self.k + np.take_along_axis(second[:, b], best, axis=1)).astype(np.int32)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Whether each vector visits each cell."""
        out = np.zeros((len(x), self.k * self.k), bool)
        for s in range(0, len(x), 256):
            part = self.order(x[s : s + 256], self.visited)
            out[np.arange(s, s + len(part))[:, None], part] = True
        return out

    def _calibrate(self, sample: np.ndarray, threshold: float, rng: np.random.Generator) -> int:
        """So many cells that either of a pair visits the other's cell for RECALL of pairs made at the threshold, and for all pairs that are looked at of those that link in the sample."""
        x = sample[rng.integers(0, len(sample), PAIRS)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + np.sqrt(1 - threshold**2) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        most = np.quantile(self._ranks(x, y), RECALL, method="higher")
        some = rng.permutation(len(sample))[:512]
        a, b = np.nonzero(sample[some] @ sample.T >= threshold)
        a, b = some[a][some[a] != b], b[some[a] != b]
        if len(a):
            at = rng.permutation(len(a))[:PAIRS]
            most = max(most, self._ranks(sample[a[at]], sample[b[at]]).max())
        return int(min(self.k * self.k, most + 1))

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair the place of the other's cell in the order of the one that has it nearer."""
        ranks = []
        for p, q in ((x, y), (y, x)):
            cell = self.cells(q)
            rank = np.empty(len(p), np.int64)
            for s in range(0, len(p), 256):
                one, two = self.halves(p[s : s + 256])
                total = (one[:, :, None] + two[:, None, :]).reshape(len(one), -1)
                rank[s : s + 256] = (total < np.take_along_axis(total, cell[s : s + 256, None], axis=1)).sum(axis=1) + 1
            ranks.append(rank)
        return np.minimum(*ranks)


def unit(rows: list, width: int) -> np.ndarray:
    """Unit vectors in double precision; shorter rows are filled with zeros."""
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    x /= np.abs(x).max(axis=1, initial=1e-300, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it reaches) that connect what the edges a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def step_forest(hit: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what a matrix of links between the nodes `row` and `col` connects: fewer than its rows and columns, found without listing the links."""
    label = np.full(int(max(row.max(), col.max())) + 1, -1)
    label[row], label[col] = row, col
    far = np.iinfo(np.int64).max
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    hit, row, col = hit[np.ix_(rows, cols)], row[rows], col[cols]
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for nodes, other, links in ((row, col, hit), (col, row, hit.T)):
        edges.append((nodes, other[links.argmax(axis=1)]))
    # those stars leave few groups; rows that span two of them give the rest
    a, b = forest(*(np.concatenate(z) for z in zip(*edges, strict=True)))
    while True:
        label[row], label[col] = row, col
        label[a] = b
        low = np.where(hit, label[col][None, :], far).min(axis=1)
        high = np.where(hit, label[col][None, :], -1).max(axis=1)
        split = np.flatnonzero(low != high)
        if not len(split):
            return a, b
        a, b = forest(np.concatenate([a, low[split]]), np.concatenate([b, high[split]]))


def blocks_of(sizes: dict[int, int], cells: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of each cell, none for an empty one, and how many blocks there are: cells share a block up to CELL_ROWS vectors, larger ones are dealt to several."""
    first, parts = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    block, room = -1, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if n <= room:
            room -= n
        else:
            block, room = block + 1, CELL_ROWS - n
        first[cell], parts[cell] = block, max(1, -(-n // CELL_ROWS))
        if parts[cell] > 1:
            block, room = block + int(parts[cell]) - 1, 0
    return first, parts, block + 1


def near_vectors(vectors: DataFrame, threshold: float = 0.9, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding).

    Vectors that are null or zero, hold null or non-finite components or have no vec_id link with nothing. Equal vectors
    collapse to one class with a weight. The classes are filed in a product grid whose codebooks are fitted on at most
    4,096 of them; every class visits the cells nearest to it, as many as find 99.5 % of pairs made at exactly the
    threshold and all of up to 2,048 pairs that link in that sample, and a pair is found if either side visits the other's cell. Found pairs are verified by their cosine in
    double precision. Cells meet their visitors in blocks of bounded rows, to which only vectors that visit one of their
    cells are sent; a block compares a few hundred visitors at a time and keeps counts and a spanning forest, never the
    pairs. Equal vectors link with each other as any two do. Other columns aren't read. An empty table gives no rows;
    shorter vectors count as filled with zeros.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    x = F.col("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = [int.from_bytes(hashlib.blake2b(np.trim_zeros(np.asarray(r) + 0.0, "b").tobytes(), digest_size=8).digest(), "little", signed=True) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["vec_id", "x", "cls"])

    named = scratch.write(rows.where(good).mapInArrow(trimmed(keyed), "vec_id long, x array<double>, cls long"))
    classes = scratch.write(named.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("x").alias("x")))
    links = _linked(scratch, classes, threshold)
    found = classes.select("cls", "rep", "m")
    if links is not None:
        counts, labels = links
        found = found.join(counts, "cls", "left").join(labels.select(F.col("id").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        smallest = found.groupBy("label").agg(F.min("rep").alias("component_id"))
        found = scratch.write(scratch.write(found).join(scratch.write(smallest), "label").select("cls", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"))
    else:
        found = scratch.write(found.select("cls", (F.col("m") - 1).alias("n_links"), F.col("rep").alias("component_id")))
    answered = named.select("vec_id", "cls").join(found, "cls").select("vec_id", "n_links", "component_id")
    rest = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return answered.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(scratch: Scratch, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """(cls, n), the weighted links of each class, and the components' labels; None where there are none."""
    spark = classes.sparkSession
    n = classes.count()
    if n < 2:
        return None
    width = classes.agg(F.max(F.size("x"))).first()[0]
    sample = [r["x"] for r in classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("x").collect()]
    grid = Grid(unit(sample, width), int(min(MOST_WORDS, max(4, 2 ** round(np.log2(np.sqrt(n) / 8))))), threshold)
    shared = spark.sparkContext.broadcast(grid)
    k = grid.k

    def filed(batches: Iterator) -> Iterator:
        """Each class in its cell, with the cells that it visits as bits."""
        import pyarrow as pa

        for batch in batches:
            u = unit(batch.column("x").to_pylist(), width)
            visits, cells = shared.value.visits(u), shared.value.cells(u)
            bits = np.packbits(visits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("m"), pa.array(cells, pa.int32()), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array([r.tobytes() for r in u], pa.binary())], names=["cls", "m", "cell", "bits", "u"])

    filed_rows = scratch.write(classes.select("cls", "m", "x").mapInArrow(trimmed(filed), "cls long, m long, cell int, bits binary, u binary"))
    # the grid's cells are at most MOST_WORDS ** 2, so their counts fit the driver
    sizes = {r["cell"]: r["n"] for r in filed_rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    first, parts, n_blocks = blocks_of(sizes, k * k)
    layout = spark.sparkContext.broadcast((first, parts, n_blocks))

    def sent(batches: Iterator) -> Iterator:
        """Each class with the block that holds it and the blocks whose cells it visits."""
        import pyarrow as pa

        first, parts, n_blocks = layout.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                cell, cls = part.column("cell").to_numpy(), part.column("cls").to_numpy()
                own = first[cell] + (np.abs(cls >> 7) % parts[cell])
                visits = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in part.column("bits").to_pylist()]), axis=1)[:, : k * k].astype(bool)
                to = np.zeros((len(cls), n_blocks + 1), np.int32)
                row, at = np.nonzero(visits & (parts > 0))
                np.add.at(to, (row, first[at]), 1)
                np.add.at(to, (row, first[at] + parts[at]), -1)
                asks = np.cumsum(to, axis=1)[:, :n_blocks] > 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array([np.flatnonzero(r).astype(np.int32) for r in asks], pa.list_(pa.int32()))], names=["cls", "m", "cell", "bits", "u", "own", "asks"])

    rows = filed_rows.mapInArrow(trimmed(sent), "cls long, m long, cell int, bits binary, u binary, own int, asks array<int>")
    probes = rows.select("cls", "m", "cell", "bits", "u", F.explode("asks").alias("block"))
    # one row a block of CELL_ROWS vectors: how many parts its visitors are dealt to
    askers = scratch.write(rows.select(F.explode("asks").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("parts")))
    asked = probes.join(F.broadcast(askers) if n_blocks <= BROADCAST_BLOCKS else askers, "block").withColumn("ask", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")
    held = rows.select("cls", "m", "cell", "bits", "u", F.col("own").alias("block")).join(F.broadcast(askers) if n_blocks <= BROADCAST_BLOCKS else askers, "block")
    held = held.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def compare(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("cls", "n", "to")})
        q, c = ({n: t.column(n).to_numpy() for n in ("cls", "m", "cell")} | {n: np.stack([np.frombuffer(v, d) for v in t.column(n).to_pylist()]) for n, d in (("bits", np.uint8), ("u", np.float64))} for t in (left, right))
        del left, right
        nodes = np.unique(np.concatenate([q["cls"], c["cls"]]))
        at_q, at_c = np.searchsorted(nodes, q["cls"]), np.searchsorted(nodes, c["cls"])
        count, links, waiting = np.zeros(len(nodes), np.int64), [], 0
        for cell in np.unique(c["cell"]).tolist():
            own = np.flatnonzero(c["cell"] == cell)
            ask = np.flatnonzero(q["bits"][:, cell >> 3] & (128 >> (cell & 7)))
            for s in range(0, len(ask), STEP):
                part = ask[s : s + STEP]
                hit = q["u"][part] @ c["u"][own].T >= threshold
                hit[at_q[part][:, None] == at_c[own][None, :]] = False
                if not hit.any():
                    continue
                # a visitor counts what it finds; what it finds counts it too, unless that visits back and counts it elsewhere
                cells = q["cell"][part]
                back = (c["bits"][own][:, cells >> 3] & (128 >> (cells & 7)).astype(np.uint8)).T != 0
                np.add.at(count, at_q[part], hit @ c["m"][own])
                np.add.at(count, at_c[own], (hit & ~back).T @ q["m"][part])
                links.append(step_forest(hit, at_q[part], at_c[own]))
                waiting += len(links[-1][0])
                if waiting > 4 * len(nodes):  # no more edges are held than a few times the vectors
                    links = [forest(*(np.concatenate(z) for z in zip(*links, strict=True)))]
                    waiting = len(links[0][0])
        a, b = forest(*(np.concatenate(z) for z in zip(*links, strict=True))) if links else (np.zeros(0, np.int64),) * 2
        some = np.flatnonzero(count)
        return pa.table({"cls": np.concatenate([nodes[some], nodes[a]]), "n": np.concatenate([count[some], np.zeros(len(a), np.int64)]), "to": pa.array([None] * len(some) + nodes[b].tolist(), pa.int64())})

    # renamed, as both come from one table
    asked, held = (df.select("cls", "m", "cell", "bits", "u", "block", "ask").toDF("cls", "m", "cell", "bits", "u", "block", "ask") for df in (asked, held))
    got = asked.groupBy("block", "ask").cogroup(held.groupBy("block", "ask")).applyInArrow(compare, "cls long, n long, to long")
    got = scratch.write(got)
    if got.isEmpty():
        return None
    counts = got.where("to is null").groupBy("cls").agg(F.sum("n").alias("n"))
    return counts, components(scratch, got.where("to is not null").select(F.col("cls").alias("a"), F.col("to").alias("b")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
