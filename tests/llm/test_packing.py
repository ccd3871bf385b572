import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm.packing import LOOK_AHEAD, OPEN_BINS, BestFit, Ids, packed, pieces, tokenizer_path


def whole(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'st\n\t\r1.é!\xa0 \u0085Z#\x1c")), max_size=40))
def test_units_give_the_tokenizers_ids(text):
    [_, ids, _] = IDS.of(["it's a\ntext", text, ""])
    assert list(np.frombuffer(ids, "<u4")) == IDS.tokenizer.encode(text, add_special_tokens=False).ids


IDS = Ids(tokenizer_path())


def test_fast_encoder_gives_the_tokenizers_ids():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    words = sorted({" " + w for t in texts for w in t.split()} | {w for t in texts[:200] for w in t.split()})
    assert IDS.fast is not None and len(words) > 50_000
    assert [IDS.fast(w) for w in words] == [e.ids for e in IDS.tokenizer.encode_batch(words, add_special_tokens=False)]


def test_pieces():
    assert pieces(1, 4) == [(0, 1)] and pieces(4, 4) == [(0, 4)] and pieces(9, 4) == [(0, 1), (1, 4), (5, 4)] and pieces(8, 4) == [(0, 4), (4, 4)]


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    fit, open_, made = BestFit(50, 5), {}, 0
    for _ in range(3000):
        n = rng.randint(1, 50)
        number, offset = fit.place(n)
        can = {f for f in open_.values() if f >= n}
        if can:
            assert open_[number] == min(can) and offset == 50 - min(can)
        else:
            if len(open_) >= 5:  # the fullest closes
                closed = [b for b, f in open_.items() if f == min(open_.values())]
                open_.pop(next(b for b in reversed(closed) if b not in {x for s in fit.bins for x in s}))
            assert number == made and offset == 0
            made += 1
            open_[number] = 50
        open_[number] -= n
        if not open_[number]:
            open_.pop(number)
        assert fit.open == len(open_) <= 5


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, None, 1), (-2, "", 2), (-3, "x " * 9000, 3), (-3, "x " * 9000, 3), (None, "a  b", 4)], "doc_id long, text string, piece int")
    rows = docs.select("doc_id", "text").unionByName(extra, allowMissingColumns=True)
    got = packed(rows, tokenizer_path()).collect()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    want = []
    for doc_id, text in texts:
        ids = whole(IDS.tokenizer, text)
        for k, (s, n) in enumerate(pieces(len(ids), 2048)):
            want.append((doc_id is None, doc_id or 0, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= 1.1 * total / 2048 + 2


def test_kept_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    [row] = packed(docs, tokenizer_path(), keep_ids=True).collect()
    assert row.ids == whole(IDS.tokenizer, "hello world")
    assert packed(docs.limit(0), tokenizer_path()).collect() == []


def test_an_encoder_that_differs_is_not_used(monkeypatch):
    from eventide.llm import packing

    plain = packing.fast_encoder
    assert IDS.fast is not None

    def differs(path):
        encode = plain(path)
        return lambda w: [1] if w.endswith("ing") else encode(w)

    monkeypatch.setattr(packing, "fast_encoder", differs)
    ids = Ids(tokenizer_path())
    assert ids.fast is None
    assert ids.of(["some early thing", "two"]) == IDS.of(["some early thing", "two"])


def test_the_bound_on_open_bins_acts_and_costs_little(spark):
    lengths = [r.length for r in packed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), tokenizer_path()).select("length", "sequence_id").collect()]
    assert LOOK_AHEAD < len(lengths) and 8 * OPEN_BINS < len(lengths)
    fit = BestFit(2048, OPEN_BINS)
    order = np.random.default_rng(1).permutation(len(lengths))
    for a in range(0, len(order), LOOK_AHEAD):
        for k in sorted(order[a : a + LOOK_AHEAD], key=lambda k: -lengths[k]):
            fit.place(lengths[k])
    least = -(-sum(lengths) // 2048)
    assert fit.closed > 0 and fit.made <= 1.003 * least, (fit.closed, fit.made, least)


def test_workers_let_encoders_go_when_other_tasks_begin():
    """A worker keeps its encoders between tasks that cut texts, and not beside the tasks of other stages."""
    from eventide.llm import common, packing

    cut = common.trimmed(lambda batches: (packing.ids_for(packing.tokenizer_path()) for _ in batches), "packing")
    [first], [second] = list(cut([1])), list(cut([1]))
    assert first is second and common.kept["packing"]
    common._power_tables(1)
    assert list(common.trimmed(lambda batches: batches)([1])) == [1] and not common.kept and not common._powers
