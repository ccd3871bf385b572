"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, kept, table, trimmed

LENGTH, OPEN_BINS, END_ID = 2048, 1024, 0
#: Pieces that are looked at together: the longest of them are placed first.
LOOK_AHEAD = 1024
#: Pieces that one packing task takes, some 2 MB.
PIECES_A_TASK = 65_536
#: Distinct words whose ids a task remembers before its older ones go.
REMEMBERED = 400_000
#: Characters of text that are cut and looked up together.
TOGETHER = 1 << 20

#: Where none of these stands in a text, the byte-level pattern cuts it before every space and around every newline,
#: whatever stands beside them, so words can be encoded one by one. Other texts are encoded whole.
JOINED = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "<|endoftext|>")
JOINED_ASCII = tuple(j for j in JOINED if j.isascii())


#: How byte-level vocabularies cut a text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs of vocabulary entries, beside all single ones, on which both encoders must agree for the fast one to be used.
COMPARED = 50_000


def fast_encoder(path: str):
    """tiktoken over the vocabulary of a tokenizer file whose merges stand in the order of their ids, as byte-level vocabularies do; None for any other."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
    if not plain or merged != sorted(merged) or -1 in merged:
        return None
    import tiktoken

    # printable Latin-1 stands for its own byte, the other bytes for the characters from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Ids:
    """Texts -> ids as little-endian uint32 bytes: each distinct word is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = fast_encoder(path)
        if self.fast is not None and not self.agree():
            self.fast = None
        self.known = Known(self.word)
        self.newline = self.encode(["\n"])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def agree(self) -> bool:
        """Whether both encoders give the same ids for every entry of the vocabulary that is text, and for COMPARED fixed pairs of entries in a row.

        What is compared depends on the file alone, so each worker comes to the same answer before it encodes a text.
        """
        size = self.tokenizer.get_vocab_size()
        entries = [t for t in self.tokenizer.decode_batch([[k] for k in range(size)]) if t and "\ufffd" not in t]
        at = np.random.default_rng(5).integers(0, max(len(entries), 1), (COMPARED if entries else 0, 2))
        words = entries + [entries[a] + entries[b] for a, b in at.tolist()]
        words = [w for w in words if "<|endoftext|>" not in w]
        return all(array("I", self.fast(w)).tobytes() == ids for k in range(0, len(words), 10_000) for w, ids in zip(words[k : k + 10_000], self.encode(words[k : k + 10_000]), strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = Known(self.word, self.known)
        get, out, whole = self.known.__getitem__, [], []
        for text in texts:
            if any(j in text for j in (JOINED_ASCII if text.isascii() else JOINED)):
                whole.append(len(out))
                out.append(b"")
                continue
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                words[0] = "\n" + words[0]
                lines.append(b"".join(map(get, words)))
            out.append(self.newline.join(lines))
        for k, ids in zip(whole, self.encode([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out

    def forget(self) -> None:
        self.known = Known(self.word)

    def word(self, word: str) -> bytes:
        """The ids of a space and the word; of the word alone where a newline stands before it."""
        word = word[1:] if word[:1] == "\n" else " " + word
        return array("I", self.fast(word)).tobytes() if self.fast is not None else self.encode([word])[0]


class Known(dict):
    """Words -> their ids, made when they are first asked for; `older` holds those of before, which come over as they are asked for."""

    def __init__(self, make, older: dict | None = None):
        self.make, self.older = make, dict(older or {})

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


def ids_for(path: str) -> Ids:
    """The worker's own encoders, kept between its tasks that cut texts."""
    own = kept.setdefault("packing", {})
    if path not in own:
        own[path] = Ids(path)
    return own[path]


class BestFit:
    """Online best fit: open bins by free space, the free spaces in use as the set bits of one integer. closed: bins that closed before they were full."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.open = self.made = self.closed = 0

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of n tokens: the fullest open bin that takes it, else a new one. Where too many are open, the fullest closes first."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, number = self.length, self.made
            self.made += 1
        left = free - n
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: all of `length` but perhaps the first."""
    first = n % length or length
    return [(0, min(first, n)), *((s, length) for s in range(first, n, length))]


def tokenized(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: its columns doc_id, piece, start, length, ids_crc32, and ids (array<int>) if kept."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids_of = ids_for(tokenizer)
        end = array("I", [END_ID]).tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]

        def rows(doc_ids: list, texts: list[str]):
            out: list[tuple] = []
            for doc_id, raw in zip(doc_ids, ids_of.of(texts), strict=True):
                raw += end
                for k, (start, n) in enumerate(pieces(len(raw) // 4, length)):
                    part = raw[4 * start : 4 * (start + n)]
                    out.append((doc_id, k, start, n, zlib.crc32(part), *((np.frombuffer(part, "<u4").astype(np.int32),) if keep_ids else ())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

        ids_of.forget()
        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.append(text.as_py() or "")
                doc_ids.append(doc_id)
                size += len(texts[-1])
                if size >= TOGETHER:
                    yield rows(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            if texts:
                yield rows(doc_ids, texts)
        ids_of.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(cut, "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_bins: int = OPEN_BINS, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there.

    A document is its tokens and an end token; a null or empty text is the end token alone. Documents over `length`
    tokens are cut into pieces of `length`, the first perhaps shorter. The pieces are written once, dealt evenly over
    tasks of about 65,536 pieces in the order of a hash of their ids, and fed there to an online best fit with
    `open_bins` open bins, of which the fullest closes where one more is needed. It looks LOOK_AHEAD pieces ahead, of
    which it takes the longest first, as short ones fill what those leave. So memory doesn't grow with the input, and a
    lost task repeats exactly. Bins left open at the end of a task are the price of packing in parallel. Rows that
    repeat, ties and null ids are packed row by row; a text of any length is encoded whole and must fit a task; an empty
    table gives no rows; columns but doc_id and text aren't read.
    """
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").write(tokenized(docs, tokenizer, length, keep_ids))
    tasks = max(1, -(-cut.count() // PIECES_A_TASK))
    names = cut.columns

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        fit = BestFit(length, open_bins)

        def out(held: list):
            rows = pa.Table.from_batches(held).combine_chunks()
            n = rows.column("length").to_numpy()
            placed = np.zeros((len(n), 2), np.int64)
            for k in np.argsort(-n, kind="stable").tolist():
                placed[k] = fit.place(int(n[k]))
            for c, at in (("sequence_id", first + placed[:, 0]), ("offset", placed[:, 1])):
                rows = rows.append_column(c, pa.array(at))
            return rows.to_batches()

        held, count = [], 0
        for batch in batches:
            while count + batch.num_rows >= LOOK_AHEAD:
                part = LOOK_AHEAD - count
                yield from out([*held, batch.slice(0, part)])
                held, count, batch = [], 0, batch.slice(part)
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
        if held:
            yield from out(held)

    dealt = cut.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "piece", "start", "ids_crc32")
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return dealt.mapInArrow(trimmed(pack), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
