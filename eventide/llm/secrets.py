"""Secret scans: pattern matches, and spans whose structure is confirmed by decoding and parsing them."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, trimmed

#: The base kinds in their order; letters of the assignment's keywords stand in either case.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")
_ORDER = {k: n for n, k in enumerate(KINDS)}

JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}")
HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}+(?![0-9A-Fa-f])")

#: A token header has fewer brackets that open; more are no header, and aren't parsed.
BRACKETS = 256
#: A run of this many bytes of the alphabets above is needed for any match but an assignment and a key block.
LEAST_RUN = 18
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-."]] = True


def der_length(raw: bytes, at: int) -> tuple[int, int] | None:
    """(start of the content, its end) of the DER value at `at`, or None where its length doesn't fit."""
    if at + 2 > len(raw):
        return None
    n, at = raw[at + 1], at + 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > len(raw):
            return None
        n, at = int.from_bytes(raw[at : at + size], "big"), at + size
        if n < 0x80:
            return None
    return (at, at + n) if at + n <= len(raw) else None


def is_der_key(raw: bytes) -> bool:
    """A SEQUENCE that fills the bytes, whose parts have known tags and nested lengths that end together, with an INTEGER and a further part."""
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    if (span := der_length(raw, 0)) is None or span[1] != len(raw):
        return False
    todo, parts, integers, depth = [(*span, 0)], 0, 0, 6
    while todo:
        at, end, level = todo.pop()
        while at < end:
            tag = raw[at]
            if tag not in (0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0x31, 0xA0, 0xA1) or (inner := der_length(raw, at)) is None or inner[1] > end:
                return False
            parts, integers = parts + 1, integers + (tag == 0x02)
            if tag in (0x30, 0x31, 0xA0, 0xA1) and level < depth:
                todo.append((*inner, level + 1))
            at = inner[1]
    return integers >= 1 and parts >= 2


def is_openssh_key(raw: bytes) -> bool:
    """The magic, then length-prefixed cipher, derivation, options, a count and as many length-prefixed keys."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at = len(magic)
    for k in range(4):
        if at + 4 > len(raw):
            return False
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4 + (n if k < 3 else 0)
    return at + 4 <= len(raw) and at + 4 + int.from_bytes(raw[at : at + 4], "big") <= len(raw)


def is_key(raw: bytes) -> bool:
    return is_der_key(raw) or is_openssh_key(raw)


def unbase64(text: str, url: bool = False) -> bytes:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except ValueError:
        return b""


def is_token_header(segment: str) -> bool:
    raw = unbase64(segment, url=True)
    if not raw.startswith(b"{") or raw.count(b"{") + raw.count(b"[") >= BRACKETS:
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def find_spans(text: str, has_keyword: bool = True, has_run: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the kinds.

    Base kinds match leftmost without overlaps, and then matches that are too short drop. Confirmed kinds are added:
    signed tokens whose header parses, private-key blocks, base64 and hex whose bytes parse as a key.
    """
    out: list[tuple[str, int, int]] = []
    if has_keyword:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if has_run:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_token_header(m[1])]
        out += [("key64", *m.span()) for m in BASE64.finditer(text) if is_key(unbase64(m[0]))]
        out += [("keyhex", *m.span()) for m in HEXES.finditer(text) if is_key(bytes.fromhex(m[0]))]
    if "PRIVATE KEY-----" in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text) if is_key(unbase64("".join(m[2].split())))]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _has_run(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a run of LEAST_RUN bytes of the alphabets."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(docs, bool)
    stops = np.flatnonzero(~_RUN[data])
    edges = np.sort(np.concatenate([[-1], stops, offsets[1:-1], [len(data)]]))
    at = edges[:-1][np.diff(edges) >= LEAST_RUN]
    out = np.zeros(docs, bool)
    out[np.minimum(np.searchsorted(offsets, at + 1, side="right") - 1, docs - 1)] = True
    return out


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for row, data, offsets in text_slices(batch, "text"):
            runs = _has_run(data, offsets)
            raw = data.tobytes()
            found = []
            for k, (a, b) in enumerate(zip(offsets.tolist(), offsets.tolist()[1:], strict=False)):
                part = raw[a:b]
                low = part.lower()
                keyword = any(w in low for w in KEYWORDS)
                found.append(find_spans(part.decode(), keyword, bool(runs[k])) if keyword or runs[k] or b"PRIVATE KEY-----" in part else [])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), pa.array([[{"kind": s[0], "start": s[1], "end": s[2]} for s in f] for f in found], kind)], names=["doc_id", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, ordered) for every row of docs (doc_id, text).

    A null text is empty and has no spans; repeated rows are answered each, and a null doc_id too. Whole texts are
    scanned, whatever their length; every pattern is linear, and a token's header with BRACKETS brackets that open isn't
    parsed. Spans that start together stand in the order of the kinds. An empty table gives no rows; columns but doc_id
    and text aren't read, whatever their names.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(trimmed(_scan), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets(table(spark, sf_dir, "documents")))
