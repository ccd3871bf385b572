"""Line deduplication by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import let
from .common import BASE, SHINGLE, Scratch, hash_words, mix, named, partitions, table, text_slices, trimmed, unused
from .graph import WIDEN

WIDTH = 5
#: Buckets of the token counts that order tokens by rarity: a fixed 2 MB, whatever the input.
SKETCH_BITS = 18
#: Up to so many ids may be broadcast; beyond, a shuffle joins them.
BROADCAST_IDS = 500_000
#: Records of one deal to the token groups (24 bytes each).
DEAL = 1 << 18
#: The rarity from which a token is hot (some 55,000 above the sketch's noise): its records are dealt by their lines and never meet in one task.
HOT = 63
#: Buckets (of 32,768 bits) of the bitmap of changed documents, which is broadcast: 4 MB at most, whatever the input.
CHANGED = 1024


class Lines:
    """The lines of a slice of texts that have words, and their tokens.

    A token is the hash of WIDTH words in a row; a line of fewer words has one, the hash of its whole sequence. doc, line:
    where each stands. cls: a line's 64-bit key, equal for lines of equal tokens. few: whether a line has fewer words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        newline = np.flatnonzero(data == 10) + 1
        starts = np.unique(np.concatenate([offsets[:-1], newline[newline < len(data)]]))
        starts = starts[starts < len(data)]
        words, index = hash_words(data, offsets, np.append(starts, len(data)))
        count = np.diff(index)
        keep = np.flatnonzero(count)
        # a text that is empty shares its start with the next: the last text that starts here holds the line
        doc = np.searchsorted(offsets[:-1], starts, side="right") - 1
        first = np.searchsorted(starts, offsets[:-1])
        self.doc, self.line = doc[keep], (np.arange(len(starts)) - first[doc])[keep]
        count, begin = count[keep], index[keep]
        rolled, short = np.zeros(len(words), np.uint64), np.zeros(len(keep), np.uint64)
        for k in range(WIDTH):
            rolled[: len(words) - k] += words[k:] * SHINGLE[k]
            has = np.flatnonzero((count > k) & (count < WIDTH))
            short[has] += words[begin[has] + k] * SHINGLE[k]
        self.few = count < WIDTH
        n = np.maximum(count - WIDTH + 1, 1)
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.token = mix(rolled[np.repeat(begin - self.at[:-1], n) + np.arange(self.at[-1])])
        self.token[self.at[:-1][self.few]] = mix(short[self.few] + count[self.few].astype(np.uint64))
        self.size = n
        self.cls = mix(np.add.reduceat(mix(self.token ^ BASE), self.at[:-1])).view(np.int64) if len(keep) else np.zeros(0, np.int64)

    def chosen(self, lines: np.ndarray) -> None:
        """Go on with these lines alone."""
        n = self.size[lines]
        at = np.concatenate([[0], np.cumsum(n)])
        self.token = self.token[np.repeat(self.at[lines] - at[:-1], n) + np.arange(at[-1])]
        self.doc, self.line, self.cls, self.few, self.size, self.at = self.doc[lines], self.line[lines], self.cls[lines], self.few[lines], n, at

    def distinct(self, rarity: np.ndarray | None = None) -> None:
        """Make each line's tokens distinct; they stand from the rarest on by `rarity` (None: in any fixed order)."""
        lines = len(self.cls)
        where = np.repeat(np.arange(lines, dtype=np.uint64), self.size)
        token, rank = self.token, self.token >> np.uint64(26)
        if rarity is not None:
            rank = (rarity[buckets(token)].astype(np.uint64) << np.uint64(32)) | (token >> np.uint64(32))
        key = (where << np.uint64(38)) | rank
        order = np.argsort(key)
        key, token, where = key[order], token[order], where[order]
        if ((key[1:] == key[:-1]) & (token[1:] != token[:-1])).any():  # tokens of one rank: their own value decides
            order = np.lexsort((token, key))
            token, where = token[order], where[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (where[1:] != where[:-1])
        self.token, where = token[new], where[new]
        self.at = np.searchsorted(where, np.arange(lines + 1, dtype=np.uint64))
        self.size = np.diff(self.at)


def buckets(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def lines_of(batch) -> Iterator[tuple[int, Lines]]:
    for row, data, offsets in text_slices(batch, "text"):
        yield row, Lines(data, offsets)


def _places(batches: Iterator) -> Iterator:
    """A row for each line, and at the end one with the task's token counts."""
    import pyarrow as pa

    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    names = ["doc_id", "version", "line", "cls", "counts"]
    for batch in batches:
        ids, versions = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for row, lines in lines_of(batch):
            counts += np.bincount(buckets(lines.token), minlength=len(counts))
            at, n = row + lines.doc, len(lines.cls)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(versions[at]), pa.array(lines.line.astype(np.int32)), pa.array(lines.cls), pa.nulls(n, pa.binary())], names=names)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())] + [pa.array([counts.tobytes()], pa.binary())], names=names)


def _summed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def rarity_of(written: DataFrame) -> np.ndarray:
    """For each bucket of the sketch how often its tokens stand in all lines, in quarters of a power of two, less the median bucket's load.

    The load of rare tokens grows with the input and says nothing of a token; what lies above it does.
    """
    parts = written.where("counts is not null").select("counts")
    many = partitions(written.sparkSession) // 64
    for tasks in ([many] if many > 4 else []) + [4]:
        parts = parts.repartition(tasks).mapInArrow(trimmed(_summed), "counts binary")
    counts = sum((np.frombuffer(bytes(r["counts"]), np.int64) for r in parts.collect()), np.zeros(1 << SKETCH_BITS, np.int64))
    above = np.maximum(counts - int(np.median(counts)), 0)
    return np.minimum(np.floor(4 * np.log2(1 + above)), HOT).astype(np.uint8)


def prefix(n: np.ndarray) -> np.ndarray:
    """How many of a line's n rarest tokens must hold one in common with every line of similarity 3/4 or more."""
    return n - -(-3 * n // 4) + 1


def _join_on_ids(frame: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows of frame whose `on` is among ids (a written table): a broadcast where the count allows it, else a shuffle."""
    return frame.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


def later_matches(scratch: Scratch, slim: DataFrame, firsts: DataFrame, rarity) -> DataFrame | None:
    """cls of the distinct lines that match a line which first stands earlier; None where there are none."""
    deals = partitions(slim.sparkSession)

    def deal(batches: Iterator) -> Iterator:
        """Prefix tokens packed by the group they go to: a few large rows in place of a row for each token."""
        held: list[np.ndarray] = []
        known = np.zeros(0, np.int64)

        def out():
            record = np.concatenate(held)
            hot = rarity.value[buckets(record["token"])] >= HOT
            return packed(record, record["token"] + np.where(hot, record["cls"].view(np.uint64), np.uint64(0)), deals)

        count = 0
        for batch in batches:
            for _, lines in lines_of(batch):
                # lines of fewer words match only lines of their class
                own, at = np.unique(lines.cls, return_index=True)
                lines.chosen(np.sort(at[~lines.few[at] & ~np.isin(own, known)]))
                known = np.concatenate([known, lines.cls])
                lines.distinct(rarity.value)
                n = prefix(lines.size)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                record = np.zeros(len(place), RECORD)
                record["token"] = lines.token[np.repeat(lines.at[:-1], n) + place]
                record["cls"], record["n"], record["place"] = np.repeat(lines.cls, n), np.repeat(lines.size, n), place
                held.append(record)
                count += len(record)
                if count >= DEAL:
                    yield out()
                    held, count, known = [], 0, known[:0]
        if count:
            yield out()

    def shared(batches: Iterator) -> Iterator:
        """The records whose token stands in the prefix of two distinct lines or more with lengths that may match, and all of hot tokens; buckets of the same lines go to one group."""
        parts = [np.frombuffer(x.as_buffer(), RECORD) for batch in batches for x in batch.column(1)]
        if not parts:
            return
        record = np.concatenate(parts)
        del parts
        token = np.sort(record["token"])
        twice = np.unique(token[1:][token[1:] == token[:-1]])
        hot = rarity.value[buckets(record["token"])] >= HOT
        at = np.minimum(np.searchsorted(twice, record["token"]), max(len(twice) - 1, 0))
        record = record[(twice[at] == record["token"]) | hot] if len(twice) else record[hot]
        record = record[np.lexsort((record["cls"], record["n"], record["token"]))]
        new = np.ones(len(record), bool)
        new[1:] = (record["token"][1:] != record["token"][:-1]) | (record["cls"][1:] != record["cls"][:-1])
        record = record[new]
        near = (record["token"][1:] == record["token"][:-1]) & (4 * record["n"][:-1] >= 3 * record["n"][1:])
        keep = rarity.value[buckets(record["token"])] >= HOT
        keep[1:] |= near
        keep[:-1] |= near
        record = record[keep]
        if not len(record):
            return
        out = np.zeros(len(record), SHARED)
        for c in RECORD.names:
            out[c] = record[c]
        edge = edges_of(record["token"])
        each = np.diff(edge)
        out["lines"] = np.repeat(mix(np.add.reduceat(mix(record["cls"].view(np.uint64)), edge[:-1]) + each.astype(np.uint64)), each)
        hot = rarity.value[buckets(record["token"])] >= HOT
        yield packed(out, np.where(hot, record["token"] + record["cls"].view(np.uint64), out["lines"]), deals)

    def merged(batches: Iterator) -> Iterator:
        """Of buckets that hold the same lines the one of the foremost token, which is the first that each two of them have in common; a hot token's records as they are."""
        import pyarrow as pa

        parts = [np.frombuffer(x.as_buffer(), SHARED) for batch in batches for x in batch.column(1)]
        if not parts:
            return
        record = np.concatenate(parts)
        del parts
        level = rarity.value[buckets(record["token"])]
        record = record[np.lexsort((record["token"], level, record["lines"]))]
        hot = rarity.value[buckets(record["token"])] >= HOT
        edge = edges_of(record["lines"])
        foremost = np.repeat(record["token"][edge[:-1]], np.diff(edge))
        record = record[hot | (record["token"] == foremost)]
        hot = rarity.value[buckets(record["token"])] >= HOT
        each = np.diff(edge := edges_of(record["token"]))
        size = np.where(hot, HOT_SIZE, np.repeat(each, each))
        for k in range(0, len(record), 100_000):
            r = record[k : k + 100_000]
            columns = [np.ascontiguousarray(r["token"]).view(np.int64), *(np.ascontiguousarray(r[c]) for c in ("cls", "n", "place")), size[k : k + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "n", "place", "c"])

    dealt = slim.select("text").mapInArrow(trimmed(deal), "to int, records binary").repartition(deals, "to")
    alike = dealt.mapInArrow(trimmed(shared), "to int, records binary").repartition(deals, "to")
    members = scratch.write(alike.mapInArrow(trimmed(merged), "key long, id long, n int, place int, c long"))
    if members.isEmpty():
        return None
    candidates = scratch.write(members.select("id").distinct().join(firsts.withColumnRenamed("cls", "id"), "id"))
    # each document with the lines that first stand there; a long list is no longer than the document's lines
    wanted = candidates.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("id").alias("ids"))
    few = candidates.count() <= BROADCAST_IDS
    chosen = slim.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "ids")

    def sets_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(1)
            row_of = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy(zero_copy_only=False))
            asked = ids.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + row_of.astype(np.uint64) * BASE
            for row, lines in lines_of(batch):
                # a line's key in its document; one that falls together with another's by chance does no harm
                own, at = np.unique(lines.cls.view(np.uint64) + (row + lines.doc).astype(np.uint64) * BASE, return_index=True)
                lines.chosen(np.sort(at[np.isin(own, asked)]))
                lines.distinct()
                tokens = [lines.token[a:b].tobytes() for a, b in zip(lines.at, lines.at[1:], strict=False)]
                bits = bitmaps(lines)
                yield pa.RecordBatch.from_arrays([pa.array(lines.cls), pa.array(tokens, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), 4).cast(pa.list_(pa.int64()))], names=["id", "tokens", "bits"])

    # rows that repeat give a set twice; they are told apart where sets are fetched
    sets = scratch.write(chosen.mapInArrow(trimmed(sets_of), "id long, tokens binary, bits array<long>"))
    about = candidates.join(sets.groupBy("id").agg(F.first("bits").alias("bits")), "id")
    written = members
    members = scratch.write(members.join(about, "id"))
    scratch.drop(written, candidates)

    def verify(pairs: DataFrame) -> DataFrame:
        # only the sets of the pairs' lines travel
        ids = scratch.write(pairs.select(F.explode(F.array("early", "late")).alias("id")).distinct())
        own = _join_on_ids(sets.select("id", "tokens"), ids, ["id"]).groupBy("id").agg(F.first("tokens").alias("tokens"))
        left = pairs.join(own.select(F.col("id").alias("early"), F.col("tokens").alias("s")), "early")
        both = left.join(own.select(F.col("id").alias("late"), F.col("tokens").alias("t")), "late")
        return both.select("early", "late", "s", "t").mapInArrow(trimmed(_confirmed), "early long, late long")

    return match_rounds(scratch, members, verify)


#: Buckets of up to so many lines are sorted in one task.
SMALL = 4096
#: What a hot token's records give as their bucket's size.
HOT_SIZE = 1 << 40
RECORD = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("place", "<i4")])
#: lines: a hash of the lines that the token's bucket holds.
SHARED = np.dtype([*RECORD.descr, ("lines", "<u8")])


def edges_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end of the last."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)


def packed(record: np.ndarray, number: np.ndarray, groups: int):
    """Records as one row for each group that they go to, by their numbers."""
    import pyarrow as pa

    to = number % np.uint64(groups)
    order = np.argsort(to, kind="stable")
    record, to = record[order], to[order]
    ends = np.searchsorted(to, np.arange(groups + 1))
    some = [k for k in range(groups) if ends[k] < ends[k + 1]]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([record[ends[k] : ends[k + 1]].tobytes() for k in some], pa.binary())], names=["to", "records"])


def bitmaps(lines: Lines) -> np.ndarray:
    """For each line 256 bits, each the parity of the tokens that hash to it."""
    out = np.zeros((len(lines.cls), 4), np.uint64)
    spread = mix(lines.token + BASE)
    row = np.repeat(np.arange(len(lines.cls)), lines.size)
    np.bitwise_xor.at(out, (row, (spread & np.uint64(3)).astype(np.int64)), np.uint64(1) << (spread >> np.uint64(58)))
    return out.view(np.int64)


def most_common(n: Column, m: Column, a: Column, b: Column) -> Column:
    """An upper bound of the tokens that two sets of n and m share: every differing parity stands for a token of one alone."""
    differ = F.bit_count(a[0].bitwiseXOR(b[0]))
    for k in range(1, 4):
        differ = differ + F.bit_count(a[k].bitwiseXOR(b[k]))
    return (n + m - differ) / 2


def _confirmed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(4 * common >= 3 * (len(both) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def match_rounds(scratch: Scratch, members: DataFrame, verify) -> DataFrame | None:
    """The ids that match an earlier one, by rounds of hubs as in graph.link_rounds.

    members: (key, id, n, place, c, first, bits), a written table; c: the bucket's size. A hub, the bucket's earliest
    member, is compared with every other member as long as the later one of the two isn't removed yet; then it leaves
    the bucket, and later rounds take WIDEN times as many. So a pair is skipped only where it can't change the result,
    and a bucket is done when all but its earliest member are removed. The length and positional filters and a bound by
    bitmaps drop pairs that can't reach the similarity, and no others: a bucket's token is the first common one for some
    bucket of each pair.
    """
    live, removed, failed, width = members.withColumn("gone", F.lit(False)), None, None, 1
    about = ["id", "n", "place", "first", "bits", "gone"]
    order = Window.partitionBy("key").orderBy("first", "id")
    while not live.isEmpty():
        if width == 1:
            # small buckets find their hub in one sort; a large one's is joined, so that many tasks can share it
            large = live.where(F.col("c") > SMALL)
            hub = scratch.write(large.groupBy("key").agg(F.min_by(F.struct(*about), F.struct("first", "id")).alias("hub")))
            met = live.where(F.col("c") <= SMALL).withColumn("hub", F.first(F.struct(*about)).over(order)).unionByName(large.join(hub, "key"))
        else:
            hub = scratch.write(live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width).select("key", F.struct(*about).alias("hub")))
            met = live.join(hub, "key")
        at = {c: F.col(f"hub.{c}") for c in about}
        common = F.least(F.col("n") - F.col("place"), at["n"] - at["place"], most_common(F.col("n"), at["n"], F.col("bits"), at["bits"]))
        able = (4 * F.least(F.col("n"), at["n"]) >= 3 * F.greatest(F.col("n"), at["n"])) & (7 * common >= 3 * (F.col("n") + at["n"]))
        # each pair once, where its later line is the member; lines at one place are neither earlier nor later
        pairs = met.where((F.col("first") > at["first"]) & ~F.col("gone") & able).select(at["id"].alias("early"), F.col("id").alias("late")).distinct()
        if failed is not None:
            pairs = pairs.join(failed, ["early", "late"], "left_anti")
        pairs = scratch.write(pairs)
        linked = scratch.write(verify(pairs))
        late = linked.select(F.col("late").alias("id")).distinct()
        removed = scratch.write(late if removed is None else removed.union(late).distinct())
        missed = pairs.join(linked, ["early", "late"], "left_anti")
        failed = missed if failed is None else failed.union(missed)
        # the hubs leave, and with them the buckets that hold no more than they and a last member
        rest = live.drop("gone") if width > 1 else live.where("c > 2").drop("gone")
        hubs = hub.select("key", F.col("hub.id").alias("id")) if width > 1 else rest.groupBy("key").agg(F.min_by("id", F.struct("first", "id")).alias("id"))
        rest = rest.join(hubs, ["key", "id"], "left_anti").join(removed.withColumn("gone", F.lit(True)), "id", "left")
        rest = scratch.write(rest.withColumn("gone", F.coalesce("gone", F.lit(False))))
        # a pair of the bucket is left where its later line still stands; written, so that a large bucket can be split
        open_keys = scratch.write(rest.groupBy("key").agg(F.min("first").alias("lo"), F.max(F.when(~F.col("gone"), F.col("first"))).alias("hi")).where("lo < hi").select("key"))
        after = scratch.write(rest.join(open_keys, "key", "left_semi"))
        scratch.drop(rest, *([live] if width > 1 else []))
        live = after
        width *= WIDEN
    return removed


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lines): the numbers, from 0, of the lines that repeat an earlier one, for each doc_id and version (xxhash64 of the text).

    A text's lines end at newlines. A line's words are lower-cased (A-Z) and its set holds its distinct five-word
    shingles, or its whole sequence of words where it has fewer; a line without words matches nothing and stays. A line
    goes if a line that stands earlier, by (doc_id, line), has a similarity of 3/4 or more (64-bit hashes stand for
    tokens); of rows with one doc_id the lines at one number are at one place, and neither is later, but each row's
    lines are judged by their own words. Rows without doc_id, and null or empty texts, lose and match nothing. An empty
    table gives no rows; columns but doc_id and text aren't read; texts of any length are taken whole.

    Lines of equal tokens collapse first. Then each distinct line's tokens are ordered by rarity, its prefix is dealt to
    token groups in packed form, and candidates pass length, positional and bitmap filters before sets are compared.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lines")
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).where("doc_id is not null")
    written = scratch.write(slim.mapInArrow(trimmed(_places), "doc_id long, version long, line int, cls long, counts binary"))
    rarity = spark.sparkContext.broadcast(rarity_of(written))
    places = written.where("cls is not null").select("doc_id", "version", "line", "cls")
    firsts = scratch.write(places.groupBy("cls").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("c")))
    matched = later_matches(scratch, slim, firsts.select("cls", "first"), rarity)
    repeated = firsts.where("c > 1").select("cls", "first")
    if matched is not None:
        cls = matched.select(F.col("id").alias("cls"))
        repeated = repeated.join(cls, "cls", "left_anti").union(cls.select("cls", F.lit(None).cast(firsts.schema["first"].dataType).alias("first")))
    repeated = scratch.write(repeated)
    bad = places.join(repeated, "cls").where("first is null or first <> struct(doc_id, line)")
    # a set: rows that repeat say the same
    out = scratch.write(bad.groupBy("doc_id", "version").agg(F.collect_set("line").alias("lines")))
    scratch.drop(written, firsts, repeated)
    return out


def without(text: Column, lines: Column) -> Column:
    """A text without some of its lines, given by their numbers."""
    left = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lines)
    return let(F.split(text, "\n", -1), lambda parts: F.array_join(F.transform(left(parts), lambda k: F.get(parts, k)), "\n"))


def cleaned(docs: DataFrame, removed: str) -> DataFrame:
    """docs with removed_lines' lines taken out of text, its other columns as they were, and the lines' numbers in a further column named by `removed` (null: none).

    The column's name must not be among those of docs. Documents that lose nothing stay where they are: a bitmap of the
    hashes of those that do, of CHANGED * 32,768 bits, is broadcast, and only documents whose bit is set meet the lines
    in a join. Where many change, more bits are set and more documents move; the result is the same.
    """
    found = removed_lines(docs)
    # whatever names docs has, its columns stand in one struct here
    spot = F.xxhash64("doc_id", "version")
    bucket, bit = F.pmod(spot, F.lit(CHANGED)).cast("int"), F.pmod(F.shiftright(spot, 20), F.lit(32768))
    bits = found.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket", "left")
    may = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    may = marked.withColumn("may", may).drop("bucket", "bits")
    whole = may.where(~F.col("may")).select("row", F.lit(None).cast("array<int>").alias("lines"))
    met = may.where("may").join(found, ["doc_id", "version"], "left").select("row", "lines")
    out = whole.union(met).withColumn("text", F.when(F.col("lines").isNull(), text).otherwise(without(text, F.col("lines"))))
    return out.select(*(F.col("text").cast(docs.schema["text"].dataType).alias(c) if c == "text" else named(c, "row.") for c in docs.columns), F.col("lines").alias(removed))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, with its columns, without the lines that repeat an earlier one (see removed_lines)."""
    return cleaned(docs, unused(docs, "lines")).select(*map(named, docs.columns))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), "lines")
    lines = F.array_join(F.transform(F.array_sort(F.coalesce("lines", F.array().cast("array<int>"))), lambda k: k.cast("string")), ",")
    return out.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), lines.alias("removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: The same by plain comparison of all lines that share a shingle, texts in lower case by A-Z alone.
ORACLE = """
WITH l AS (
  SELECT doc_id, CAST(unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS INTEGER) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM documents
), w AS (
  SELECT doc_id, line, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM l
), g AS MATERIALIZED (
  SELECT doc_id, line, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0
), t AS MATERIALIZED (SELECT doc_id, line, len(g) AS n, unnest(g) AS t FROM g
), p AS (
  SELECT b.doc_id, b.line FROM t a JOIN t b ON a.t = b.t AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.line < b.line)
  GROUP BY a.doc_id, a.line, b.doc_id, b.line, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*))
), r AS (SELECT DISTINCT doc_id, line FROM p
), k AS (
  SELECT l.doc_id, count(r.line) AS n_removed, coalesce(string_agg(CAST(r.line AS VARCHAR), ',' ORDER BY r.line), '') AS removed,
    md5(coalesce(string_agg(CASE WHEN r.line IS NULL THEN s END, chr(10) ORDER BY l.line), '')) AS text_md5
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.line = r.line GROUP BY l.doc_id
)
SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, removed, text_md5 FROM k
"""
