"""Vector files and downloads, on files and a server made here."""

import http.server
import struct
import threading

import pytest

from eventide.operators import spatial
from eventide.sources import acquire, geo

SQUARE, HOLE, FAR = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0)], [(20.0, 0.0), (25.0, 0.0), (25.0, 5.0)]


def frames(spark):
    rows = [("a", 0, 0, False, SQUARE), ("a", 0, 1, True, HOLE), ("b", 0, 0, False, FAR), ("b", 1, 0, False, SQUARE), ("p", 0, 0, False, [(3.0, 4.0)])]
    features = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c", "z", 3), ("p", "é 'q'", 4)], "feature string, name string, n int")
    return features, spark.createDataFrame([(*r[:4], [x for x, _ in r[4]], [y for _, y in r[4]]) for r in rows], geo.RINGS)


def rows_of(rings):
    return sorted((r.feature, r.part, r.ring, r.hole, list(zip(r.xs, r.ys, strict=True))) for r in rings.collect())


def test_geopackages_come_back_as_written(spark, tmp_path):
    path = str(tmp_path / "m.gpkg")
    features, rings = frames(spark)
    geo.write_layers(spark, path, {"one": (features, rings), "none": (features.limit(0), rings.limit(0))})
    assert [(r.layer, r.crs, r.rows) for r in geo.layers(spark, path).orderBy("layer").collect()] == [("none", 27700, 0), ("one", 27700, 4)]
    got, shapes = geo.read_layer(spark, path, "one", ["name", "n"], "feature")
    assert sorted((r.feature, r.name, r.n) for r in got.collect()) == [("a", "x", "1"), ("b", None, "2"), ("c", "z", "3"), ("p", "é 'q'", "4")]
    assert rows_of(shapes) == rows_of(rings)
    for layer, key, crs in (("two", "feature", 27700), ("one", "gone", 27700), ("one", "feature", 4326)):
        with pytest.raises(Exception, match="layer"):
            geo.read_layer(spark, path, layer, [], key, crs)[0].collect()
    areas = {r.feature: r.a for r in shapes.groupBy("feature").agg({"part": "max"}).withColumnRenamed("max(part)", "a").collect()}
    assert areas == {"a": 0, "b": 1, "p": 0}
    edges = geo.ring_edges(shapes.where("feature = 'a'"), spark.createDataFrame([("a", "k")], "feature string, company string"))
    points = spark.createDataFrame([("in", "k", 1.0, 1.0), ("hole", "k", 3.0, 3.0), ("edge", "k", 0.0, 5.0)], "sensor string, company string, x double, y double")
    assert {(r.sensor, r.kind) for r in spatial.linked(points, edges, 5.0).collect()} == {("in", "within"), ("edge", "boundary")}


def shapefile(at, shapes, names, projection="British_National_Grid"):
    records = b""
    for k, parts in enumerate(shapes):
        points = [p for ring in parts for p in [*ring, ring[0]]]
        starts, n = [], 0
        for ring in parts:
            starts.append(n)
            n += len(ring) + 1
        body = struct.pack("<I", 5) + struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<2I", len(parts), n) + struct.pack(f"<{len(parts)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">2I", k + 1, len(body) // 2) + body
    at.with_suffix(".shp").write_bytes(struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2I", 1000, 5) + bytes(64) + records)
    head = struct.pack("<4BIHH", 3, 26, 1, 1, len(names), 32 + 32 + 1, 1 + 8) + bytes(20)
    field = b"ID".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15)
    at.with_suffix(".dbf").write_bytes(head + field + b"\r" + b"".join(b" " + n.encode().ljust(8) for n in names))
    at.with_suffix(".prj").write_text(f'PROJCS["{projection}"]')


def test_shapefiles(spark, tmp_path):
    clockwise = lambda ring: ring[::-1]
    shapefile(tmp_path / "s", [[clockwise(SQUARE), HOLE[::-1]], [clockwise(FAR), clockwise(SQUARE)]], ["A1", "B2"])
    features, rings = geo.read_shapefile(spark, str(tmp_path / "s"), "ID", ["ID"])
    assert [r.feature for r in features.orderBy("feature").collect()] == ["A1", "B2"]
    assert [r[:4] for r in rows_of(rings)] == [("A1", 0, 0, False), ("A1", 0, 1, True), ("B2", 0, 0, False), ("B2", 1, 0, False)]
    assert {(r.feature, r.part): r.a for r in rings.select("feature", "part", "hole", spatial.ring_area("xs", "ys").alias("a")).where("not hole").collect()} == {("A1", 0): 100.0, ("B2", 0): 12.5, ("B2", 1): 100.0}
    shapefile(tmp_path / "t", [[clockwise(SQUARE)]], ["A"], "WGS_84")
    with pytest.raises(Exception, match="projection"):
        geo.read_shapefile(spark, str(tmp_path / "t"), "ID", [])[0].collect()


class Archive(http.server.BaseHTTPRequestHandler):
    files = {"a.dat": bytes(range(256)) * 10, "b c.dat": b"x" * 999}
    failures: list[int] = []
    seen: list[tuple[str, str | None]] = []

    def do_GET(self):
        name = self.path.rsplit("/", 1)[-1].replace("%20", " ")
        self.seen.append((name, self.headers.get("Range")))
        if self.failures:
            self.send_response(self.failures.pop(0))
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if self.path == "/data/2021/":
            body, start = ('<a href="../">up</a> -\n' + "".join(f'<a href="{n}">{n}</a> 2021-01-01 {len(b)}\n' for n, b in self.files.items()) + '<a href="https://elsewhere.example/x.dat">x</a> 5\n').encode(), 0
        elif name in self.files:
            body, start = self.files[name], int((self.headers.get("Range") or "bytes=0-")[6:-1])
        else:
            self.send_error(404)
            return
        self.send_response(206 if start else 200)
        if start:
            self.send_header("Content-Range", f"bytes {start}-{len(body) - 1}/{len(body)}")
        self.send_header("Content-Length", str(len(body) - start))
        self.end_headers()
        self.wfile.write(body[start:])

    def log_message(self, *a):
        pass


def test_downloads_go_on_where_they_stopped(tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root, waits = f"http://127.0.0.1:{server.server_address[1]}/data", []
    options = {"sleep": waits.append, "attempts": 3, "first_wait": 0.5}
    try:
        Archive.failures[:] = [503, 429]
        entries = acquire.enumerate_year(root, 2021, str(tmp_path), **options)
        assert [(e.name, e.size, e.status) for e in entries] == [("a.dat", 2560, "INCOMPLETE"), ("b c.dat", 999, "INCOMPLETE")] and waits == [0.0, 0.0]
        assert len(acquire.validate(entries)) == 2
        (tmp_path / "2021").mkdir()
        (tmp_path / "2021" / "a.dat.part").write_bytes(Archive.files["a.dat"][:1000])
        done = [acquire.download(e, **options) for e in entries]
        assert all(e.status == "COMPLETE" for e in done) and ("a.dat", "bytes=1000-") in Archive.seen
        assert all((tmp_path / "2021" / n).read_bytes() == b for n, b in Archive.files.items())
        n = len(Archive.seen)
        acquire.download(entries[0], **options)
        assert len(Archive.seen) == n and acquire.validate(entries) == []
        acquire.write_manifest(entries, str(tmp_path / "m.csv"))
        assert (tmp_path / "m.csv").read_text().splitlines()[1].split(",")[:2] == ["2021", "a.dat"]
        Archive.failures[:] = [403]
        with pytest.raises(acquire.Refused):
            acquire.request(f"{root}/2021/", **options)
        Archive.failures[:] = [500] * 3
        with pytest.raises(ConnectionError, match="3 attempts"):
            acquire.request(f"{root}/2021/", **options)
        wrong = acquire.Entry(2021, "a.dat", f"{root}/2021/a.dat", 5000, str(tmp_path / "w" / "a.dat"))
        with pytest.raises(ValueError, match="2560 bytes"):
            acquire.download(wrong, **options)
    finally:
        server.shutdown()
