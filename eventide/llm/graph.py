"""Connected components and hub rounds over buckets, as DataFrame iterations whose tables live in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, label) for every id of edges (a, b): label is the smallest id that links reach.

    Each pass hooks every vertex to its smallest neighbour, jumps one pointer and contracts the edges, so the passes
    grow with the logarithm of a component's size. Minima are pre-aggregated before the shuffle; a vertex with very many
    edges is a skewed join key, which adaptive execution splits. Every pass is cut by a written table.
    """
    e = scratch.write(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("p"))
        jump = near.select(F.col("id").alias("p"), F.col("p").alias("q"))
        hop = scratch.write(near.join(jump, "p").select("id", F.col("q").alias("p")))
        left = e.join(hop.select(F.col("id").alias("a"), F.col("p").alias("x")), "a")
        after = scratch.write(left.join(hop.select(F.col("id").alias("b"), F.col("p").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(e)
        e = after
        maps.append(hop)
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = maps[0].withColumnRenamed("p", "label")
    for m in maps[1:]:
        step = m.select(F.col("id").alias("label"), F.col("p").alias("next"))
        labels = labels.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return scratch.write(labels)


def near_labels(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id within two links. Ids of one label are connected, so stars get one label at the cost of two pre-aggregated minima."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return both.join(least, "b").groupBy(F.col("a").alias("id")).agg(F.min("m").alias("label"))


#: Each round compares so many times as many hubs of a bucket as the one before.
WIDEN = 32


def _hubs(live: DataFrame, width: int) -> DataFrame:
    """The foremost members (key, hub) of each bucket; the choice is limited within each task before the shuffle."""
    if width == 1:
        return live.groupBy("key").agg(F.max_by("id", F.struct("deg", "id")).alias("hub"))
    order = Window.partitionBy("key").orderBy(F.desc("deg"), F.desc("id"))
    return live.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width).select("key", F.col("id").alias("hub"))


def link_rounds(scratch: Scratch, members: DataFrame, verify: Callable[[DataFrame], DataFrame], able: Callable[[Column, Column], Column] | None = None, known: DataFrame | None = None) -> DataFrame | None:
    """Labels of the components that links within buckets make, without listing all pairs of a bucket.

    members: (key, id, deg, about), a written table of the buckets of two or more ids, the likeliest hubs with the
    largest deg. able: of two members' `about`, whether they may link; tested as pairs are joined. verify: pairs (a, b),
    a < b -> the linked ones. known: links (a, b) that hold whatever verify says. Round r compares the WIDEN**r foremost members of each bucket with all its members of other
    labels, which the links so far give (ids of one label are connected); those hubs then leave. A bucket is done when
    its members share a label. So every pair of a bucket that may link is compared or already connected: nothing is
    lost, a group of copies costs about as many comparisons as members,
    and the rounds grow with the logarithm of the largest bucket. Returns (id, label), or None without links.
    """
    live, labels, edges, failed, width = members.withColumn("label", F.col("id")), None, known, None, 1
    while not live.isEmpty():
        hubs = _hubs(live, width)
        hubs = scratch.write(hubs) if width > 1 else hubs
        near = live.select("key", F.col("id").alias("hub"), F.col("label").alias("hub_label"), F.col("about").alias("hub_about")).join(hubs, ["key", "hub"], "left_semi").withColumnRenamed("key", "hub_key")
        may = able(F.col("about"), F.col("hub_about")) if able else F.lit(True)
        own = live.select("key", "id", "label", "about")
        pairs = own.join(near, (F.col("key") == F.col("hub_key")) & (F.col("label") != F.col("hub_label")) & may)
        pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        if failed is not None:
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs)
        linked = scratch.write(verify(pairs))
        missed = pairs.join(linked, ["a", "b"], "left_anti")
        failed = missed if failed is None else failed.union(missed)
        if not linked.isEmpty():
            edges = linked if edges is None else edges.union(linked)
            labels = scratch.write(near_labels(edges))
        live = live.select("key", "id", "deg", "about").join(hubs.select("key", F.col("hub").alias("id")), ["key", "id"], "left_anti")
        live = live.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")) if labels is not None else live.withColumn("label", F.col("id"))
        open_keys = live.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        # written, so that both sides of the join are dealt anew and a large bucket can be split
        live = scratch.write(live.select("key", "id", "deg", "about", "label").join(scratch.write(open_keys), "key", "left_semi"))
        width *= WIDEN
    return None if edges is None else components(scratch, edges)
