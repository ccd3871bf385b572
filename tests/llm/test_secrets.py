import base64
import hashlib
import json
import random
import re

from eventide.llm import secrets as S


def plain(text):
    """The base spans by the patterns as they are stated."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def der(*parts, tag=0x30):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


KEY = der(der(b"\0", tag=2), der(bytes(range(1, 129)), tag=2), der(b"\1\0\1", tag=2), der(bytes(64), tag=2))
TOKEN = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) + ".c2lnbmF0dXJl"


def test_confirmed_structures():
    key64 = base64.b64encode(KEY).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(key64[k : k + 64] for k in range(0, len(key64), 64)) + "\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [k for k, _, _ in S.find_spans(t)]
    assert "jwt" in kinds(f"see {TOKEN} here") and "pem" in kinds(f"a {pem} b") and "key64" in kinds(f"x {key64} y") and "keyhex" in kinds(KEY.hex().upper())
    assert kinds(base64.b64encode(b"just some plain bytes, long enough to look like one").decode()) == []
    assert not S.is_der_key(KEY[:-1]) and not S.is_der_key(KEY + b"\0")
    ssh = b"openssh-key-v1\0" + b"\0\0\0\4none" * 2 + b"\0\0\0\0" + b"\0\0\0\1" + b"\0\0\0\4abcd"
    assert S.is_openssh_key(ssh) and not S.is_openssh_key(ssh[:40])


def test_query_against_the_stated_patterns(spark):
    rng = random.Random(5)
    bits = ["token=", "Secret : '", "api_key", "APIKEY=", "passwd\"=", "abc", "é", "𝒳", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 3, "\n", "ſecret=abcdefgh", "token: token: abcdefgh", TOKEN]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "a" * 300000), (1002, "x" * 10)], "doc_id long, text string")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for frame in (docs, real):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r.doc_id, []).append(plain(r.text or ""))
        got = S.digest(S.secrets(frame)).collect()
        assert len(got) == sum(map(len, texts.values()))
        for r in got:
            shas = [hashlib.sha256(S.joined(p).encode()).hexdigest() for p in texts[r.doc_id]]
            assert r.base_sha256 in shas
            want = texts[r.doc_id][shas.index(r.base_sha256)]
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
            assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == [s for s in S.joined(want).split(",") if s]


def test_empty_table(spark):
    assert S.digest(S.secrets(spark.createDataFrame([], "doc_id long, text string, spans int"))).collect() == []


def test_token_headers_are_bounded():
    def token(head):
        return base64.urlsafe_b64encode(head).decode().rstrip("=") + ".eyJzdWIiOjF9.c2ln"

    deep = b'{"alg":' + b"[" * 200_000
    assert S.find_spans("x " + token(deep)) == [] and S.find_spans(token(b'{"alg": "none", "x": ' + b'{"y":' * 300 + b"1" + b"}" * 301)) == []
    assert [k for k, _, _ in S.find_spans(token(b'{"alg": "none", "x": ' + b'{"y":' * 200 + b"1" + b"}" * 201))] == ["jwt"]


def elements(raw):
    """A reader of DER written for the tests: the tree of (tag, content), or ValueError."""
    out = []
    while raw:
        if len(raw) < 2:
            raise ValueError
        tag, n, at = raw[0], raw[1], 2
        if n & 128:
            k = n & 127
            n, at = int.from_bytes(raw[2 : 2 + k], "big"), 2 + k
            if not 1 <= k <= 4 or n < 128:
                raise ValueError
        if len(raw) < at + n:
            raise ValueError
        out.append((tag, elements(raw[at : at + n]) if tag in (0x30, 0x31, 0xA0, 0xA1) else raw[at : at + n]))
        raw = raw[at + n :]
    return out


def test_keys_by_another_reader_with_bytes_changed():
    rng = random.Random(2)
    agreed = [0, 0]
    for _ in range(3000):
        raw = bytearray(KEY)
        for _ in range(rng.choice((0, 1, 1, 2))):
            raw[rng.randrange(0, 12)] = rng.choice((0x30, 0x02, 0x82, 0x81, 0x00, 0x05, rng.randrange(256)))
        try:
            tree = elements(bytes(raw))
            flat = [t for e in tree for t in e[1]] if len(tree) == 1 and tree[0][0] == 0x30 else []
            known = {2, 3, 4, 5, 6, 0x30, 0x31, 0xA0, 0xA1}
            want = len(flat) >= 2 and all(t in known for t, _ in flat) and any(t == 2 for t, _ in flat)
        except ValueError:
            want = False
        assert S.is_der_key(bytes(raw)) == want, raw[:16].hex()
        agreed[want] += 1
    assert min(agreed) > 100


def test_plain_data_is_no_secret():
    rng = random.Random(3)
    for n in (40, 200, 2000):
        for _ in range(200):
            raw = rng.randbytes(n)
            assert not {k for k, _, _ in S.find_spans(base64.b64encode(raw).decode() + " " + raw.hex().upper())} & {"jwt", "pem", "key64", "keyhex"}
