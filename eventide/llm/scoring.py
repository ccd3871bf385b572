"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_words, table, text_slices, trimmed

#: Tokens are words hashed to SIDE * SIDE classes; a class is a pair of codes, predicted one after the other.
SIDE, WIDTH, WINDOW = 64, 24, 3
VOCABULARY = SIDE * SIDE
#: Positions are dealt by their place modulo MASKED over the rounds, each to one at least; every position is scored.
MASKED, BATCH, ROUNDS, RATE = 4, 1024, 2, 0.1
#: Logarithms are rounded to 1 / UNIT and summed as integers, so that sums don't depend on the order.
UNIT = 1 << 20
#: Tasks whose averaged weights meet on the driver.
FAN_IN = 4
#: Words of this share of all tokens are looked up in each task, at most 1 / COMMON of them; the others by a join.
COMMON = 1 / (1 << 18)
#: Distinct words whose counts a task holds before it sends them on.
HELD = 1 << 20
PAD = VOCABULARY


class Network:
    """Embeddings of the WINDOW words to either side, each weighted by its place, summed and squashed; then a softmax over the first code, and over the second given the first."""

    SHAPES = {"embed": (VOCABULARY + 1, WIDTH), "place": (2 * WINDOW, WIDTH), "one": (WIDTH, SIDE), "one_b": (SIDE,), "hint": (SIDE, WIDTH), "two": (WIDTH, SIDE), "two_b": (SIDE,)}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(29)
        w = {k: (rng.normal(size=s) * (0.0 if k.endswith("_b") else 0.2)).astype(np.float32) for k, s in cls.SHAPES.items()}
        w["place"] = np.ones(cls.SHAPES["place"], np.float32)
        w["embed"][PAD] = 0
        return cls(w)

    def pack(self) -> bytes:
        return b"".join(self.w[k].astype("<f4").tobytes() for k in self.SHAPES)

    @classmethod
    def unpack(cls, raw: bytes | np.ndarray) -> Network:
        flat, out, at = np.frombuffer(raw, "<f4") if isinstance(raw, bytes) else raw, {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(out)

    def _forward(self, context: np.ndarray, target: np.ndarray):
        """The context's embeddings, then hidden values and the two softmaxes with a column for each example."""
        w = self.w
        words = w["embed"][context]
        hidden = words[:, 0] * w["place"][0]
        for k in range(1, 2 * WINDOW):
            hidden += words[:, k] * w["place"][k]
        hidden = np.tanh(np.ascontiguousarray(hidden.T))
        a, b = target // SIDE, target % SIDE
        p = w["one"].T @ hidden + w["one_b"][:, None]
        second = hidden + w["hint"].T[:, a]
        q = w["two"].T @ second + w["two_b"][:, None]
        for z in (p, q):
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
        return words, hidden, second, a, b, p, q

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        *_, a, b, p, q = self._forward(context, target)
        at = np.arange(len(target))
        return np.log(np.maximum(p[a, at], 1e-30)).astype(np.float64) + np.log(np.maximum(q[b, at], 1e-30))

    def step(self, context: np.ndarray, target: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the mean negative log-probability."""
        w, n = self.w, len(target)
        words, hidden, second, a, b, p, q = self._forward(context, target)
        at = np.arange(n)
        own = np.zeros((SIDE, n), np.float32)
        own[a, at] = 1
        p -= own
        q[b, at] -= 1
        p /= n
        q /= n
        d_second = w["two"] @ q
        d_hidden = (w["one"] @ p + d_second) * (1 - hidden**2)
        d_words = np.ascontiguousarray(d_hidden.T)
        grads = {"one": hidden @ p.T, "one_b": p.sum(axis=1), "two": second @ q.T, "two_b": q.sum(axis=1), "hint": own @ d_second.T}
        spread = d_words[:, None, :] * w["place"]
        grads["place"] = np.einsum("nkw,nw->kw", words, d_words)
        for k, g in grads.items():
            memory[k] += g * g
            w[k] -= RATE * g / np.sqrt(memory[k] + 1e-8)
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        ids, g = flat[first], np.add.reduceat(spread.reshape(-1, WIDTH)[order], first)
        memory["embed"][ids] += g * g
        w["embed"][ids] -= RATE * g / np.sqrt(memory["embed"][ids] + 1e-8)
        w["embed"][PAD] = 0


def contexts_at(tokens: np.ndarray, index: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """contexts of some tokens alone, by their places."""
    doc = np.searchsorted(index, chosen, side="right") - 1
    first, last = index[doc], index[doc + 1]
    out = np.empty((len(chosen), 2 * WINDOW), np.int16)
    for k, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        at = chosen + d
        inside = (at >= first) & (at < last)
        out[:, k] = np.where(inside, tokens[np.where(inside, at, 0)], PAD)
    return out


def contexts(tokens: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each token the WINDOW tokens before and after it in its own text, PAD beyond its ends."""
    n = len(tokens)
    doc = np.repeat(np.arange(len(index) - 1), np.diff(index))
    out = np.full((n, 2 * WINDOW), PAD, np.int16)
    for k, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        here = slice(max(0, -d), n - max(0, d))
        there = slice(max(0, d), n + min(0, d))
        if abs(d) < n:
            out[here, k] = np.where(doc[here] == doc[there], tokens[there], PAD)
    return out


def class_of(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(VOCABULARY)).astype(np.int16)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, index = hash_words(data, offsets)
    return class_of(words), index


class Counter:
    """How often words stand; batches of (word, n) come out when many are held, and at the end."""

    def __init__(self):
        self.words, self.counts, self.size = [], [], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate(self.words), return_inverse=True)
        return own, np.bincount(at, np.concatenate(self.counts)).astype(np.int64)

    def add(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        own, n = np.unique(words, return_counts=True)
        self.words.append(own)
        self.counts.append(n)
        self.size += len(own)
        if self.size < HELD:
            return []
        own, n = self._merged()
        out = self._parts(own, n) if 2 * len(own) >= HELD else []
        if out:
            own, n = own[:0], n[:0]
        self.words, self.counts, self.size = [own], [n], len(own)
        return out

    def rest(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return self._parts(*self._merged()) if self.words else []

    def _parts(self, own: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(own[a : a + 100_000].view(np.int64), n[a : a + 100_000]) for a in range(0, len(own), 100_000)]


def _train(start: bytes, round_: int, shares: int, counting: bool = False):
    """Training on the positions of one of `shares` shares, which together are all; counting: the words' counts come out too, so that texts needn't be read again for them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        net = Network.unpack(start)
        memory = {k: np.full(v.shape, 1e-4, np.float32) for k, v in net.w.items()}
        seen, counter, names = 0, Counter(), ["weights", "n", "word"]

        def counted(parts):
            return [pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.binary()), pa.array(n), pa.array(w)], names=names) for w, n in parts]

        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                words, index = hash_words(data, offsets)
                tokens = class_of(words)
                if counting:
                    yield from counted(counter.add(words))
                # the place in its own text decides, so every document gives its share
                place = np.arange(len(tokens)) - np.repeat(index[:-1], np.diff(index))
                chosen = np.flatnonzero(place % MASKED % shares == round_ % shares)
                if not len(chosen):
                    continue
                context, target = contexts_at(tokens, index, chosen), tokens[chosen]
                for a in range(0, len(chosen), BATCH):
                    net.step(context[a : a + BATCH], target[a : a + BATCH], memory)
                seen += len(chosen)
        yield from counted(counter.rest())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([net.pack()], pa.binary()), pa.array([seen], pa.int64()), pa.nulls(1, pa.int64())], names=names)

    return run


def _average(batches: Iterator) -> Iterator:
    """The weights of several tasks, weighted by their examples."""
    import pyarrow as pa

    total, n = None, 0
    for batch in batches:
        for raw, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw.as_buffer(), "<f4").astype(np.float64) * k
            total, n = part if total is None else total + part, n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])


def trained(texts: DataFrame, rounds: int = ROUNDS) -> Network:
    """The network of `learned`."""
    return learned(Scratch(texts.sparkSession, "scoring"), texts, rounds)[0]


def learned(scratch: Scratch, texts: DataFrame, rounds: int = ROUNDS, counting: bool = False) -> tuple[Network, DataFrame | None]:
    """The network, and with `counting` word_counts of texts, made in the first round; the network is that after `rounds` of training on every partition of texts (text) at once, the partitions' weights averaged.

    Each position of every document is a target in one round at least, whatever their number: the rounds share the
    places modulo MASKED out. The network has a fixed size and knows classes; what grows with the vocabulary is
    word_counts. The averages go through a few tasks before the driver
    takes FAN_IN of them. The result depends on how the input is split, not on the order in which tasks end.
    """
    weights, counts = Network.fresh().pack(), None
    for k in range(rounds):
        sent = scratch.write(texts.mapInArrow(trimmed(_train(weights, k, min(rounds, MASKED), counting and not k)), "weights binary, n long, word long"))
        own = sent.where("weights is not null").select("weights", "n")
        parts = own.repartition(FAN_IN, F.crc32("weights")).mapInArrow(trimmed(_average), "weights binary, n long").collect()
        if counting and not k:
            counts = scratch.write(sent.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        scratch.drop(sent)
        n = sum(r["n"] for r in parts)
        if not n:
            break
        parts.sort(key=lambda r: bytes(r["weights"]))
        weights = (sum(np.frombuffer(bytes(r["weights"]), "<f4").astype(np.float64) * r["n"] for r in parts) / n).astype("<f4").tobytes()
    return Network.unpack(weights), counts


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    counter = Counter()

    def out(parts):
        return [pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["word", "n"]) for w, n in parts]

    for batch in batches:
        for _, data, offsets in text_slices(batch, "text"):
            yield from out(counter.add(hash_words(data, offsets)[0]))
    yield from out(counter.rest())


def word_counts(texts: DataFrame) -> DataFrame:
    """word (its 64-bit hash) and n, how often it stands in texts (text), for every distinct word."""
    return texts.mapInArrow(trimmed(_counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for c in batch.columns], names=["words", "counts"])


def scored(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, n_tokens, log_probability and mean_log_probability for every row of docs (doc_id, text).

    log_probability sums, over every word of the whole text, the logarithm of its conditional probability given the
    words to both sides: that of the word's class by the network, times the word's share of its class, counted over all
    of docs. The few words of a share of COMMON or more are looked up in each task; the others, any number, meet their
    counts in a join. A null, empty or blank text has no tokens, a sum of 0 and a null mean. Repeated rows are scored each
    and alike, but for a word whose logarithm lies at the edge of two units of 2 ** -20; a null doc_id is answered too;
    a text of any length is taken whole and must fit a task; columns but doc_id and text aren't read; an empty table
    gives no rows. Without a network one is trained on all of docs; a given one scores classes
    alone, as no counts come with it.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "scoring")
    # given a network, every word is its class: it needs no count
    counts, common, class_log = None, (np.zeros(0, np.uint64), np.zeros(0)), np.zeros(VOCABULARY)
    if network is None:
        network, counts = learned(scratch, slim.select("text"), counting=True)
        if counts is None:
            counts = scratch.write(word_counts(slim.select("text")))
        for r in counts.groupBy(F.col("word").bitwiseAND(F.lit(VOCABULARY - 1)).alias("class")).agg(F.sum("n").alias("n")).collect():
            class_log[r["class"]] = r["n"]
        least = max(1.0, class_log.sum() * COMMON)
        class_log = np.log(np.maximum(class_log, 1))
        parts = counts.where(F.col("n") >= least).select("word", "n").mapInArrow(trimmed(_packed), "words binary, counts binary").collect()
        if parts:
            own, n = (np.frombuffer(b"".join(bytes(r[c]) for r in parts), "<i8") for c in ("words", "counts"))
            order = np.argsort(own.view(np.uint64))
            common = own.view(np.uint64)[order], np.log(n[order])
        counts = counts.where(F.col("n") < least)
    shared = spark.sparkContext.broadcast((network.pack(), *common, class_log, counts is not None))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        raw, common, common_log, class_log, counted = shared.value
        net, number = Network.unpack(raw), TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, data, offsets in text_slices(batch, "text"):
                words, index = hash_words(data, offsets)
                tokens = class_of(words)
                context, each = contexts(tokens, index), np.zeros(len(tokens))
                for a in range(0, len(tokens), BATCH):
                    each[a : a + BATCH] = net.log_probability(context[a : a + BATCH], tokens[a : a + BATCH])
                rare = np.zeros(len(words), bool)
                if counted:
                    each -= class_log[tokens]
                    rare[:] = True
                    if len(common):
                        at = np.minimum(np.searchsorted(common, words), len(common) - 1)
                        rare = common[at] != words
                        each += np.where(rare, 0.0, common_log[at])
                total = np.concatenate([[0], np.cumsum(np.rint(each * UNIT).astype(np.int64))])
                n = np.diff(index)
                ends = np.concatenate([[0], np.cumsum(rare)])[index].astype(np.int32)
                left = pa.ListArray.from_arrays(pa.array(ends), pa.array(words[rare].view(np.int64)))
                sums = (total[index[1:]] - total[index[:-1]]) / UNIT
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(n))), batch.column(0).slice(row, len(n)), pa.array(n), pa.array(sums), left], names=["row", "doc_id", "n_tokens", "log_probability", "rare"])
                number += len(n)

    out = slim.mapInArrow(trimmed(run), "row long, doc_id long, n_tokens long, log_probability double, rare array<long>")
    if counts is not None:
        out = scratch.write(out)
        rest = out.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg((F.sum(F.rint(F.log("n") * UNIT).cast("long")) / UNIT).alias("rest"))
        out = out.drop("rare").join(rest, "row", "left").withColumn("log_probability", F.col("log_probability") + F.coalesce("rest", F.lit(0.0)))
    out = out.select("doc_id", "n_tokens", "log_probability")
    return out.withColumn("mean_log_probability", F.try_divide("log_probability", "n_tokens"))


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
