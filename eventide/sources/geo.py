"""Vector files without a geospatial library: GeoPackages, which are SQLite, and shapefiles, as rings and attributes."""

from __future__ import annotations

import sqlite3
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 27700
#: Bytes before the geometry in a GeoPackage blob, by the kind of its box (fixed values).
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
RINGS = "feature string, part int, ring int, hole boolean, xs array<double>, ys array<double>"


def _rings(blob: bytes) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a well-known-binary polygon or multipolygon, each a list of rings, closing corners dropped; points are a ring of one corner."""
    order = "<" if blob[0] else ">"
    (kind,) = struct.unpack_from(order + "I", blob, 1)
    at = 5

    def corners(n: int) -> list[tuple[float, float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{2 * n}d", blob, at)
        at += 16 * n
        points = list(zip(flat[::2], flat[1::2], strict=True))
        return points[:-1] if n > 1 and points[0] == points[-1] else points

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", blob, at)
        at += 4
        return n

    def polygon() -> list:
        return [corners(count()) for _ in range(count())]

    if kind == 1:
        return [[corners(1)]]
    if kind == 3:
        return [polygon()]
    if kind == 6:
        out = []
        for _ in range(count()):
            at += 5  # each part's own byte order and kind
            out.append(polygon())
        return out
    raise ValueError(f"geometry of kind {kind}")


def _wkb(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    def ring(points: list) -> bytes:
        closed = [*points, points[0]]
        return struct.pack("<I", len(closed)) + b"".join(struct.pack("<2d", *p) for p in closed)

    def polygon(rings: list) -> bytes:
        return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(ring, rings))

    if len(parts) == 1 and len(parts[0]) == 1 and len(parts[0][0]) == 1:
        return struct.pack("<BI2d", 1, 1, *parts[0][0][0])
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


def _opened(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    return con


def _content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def layers(spark: SparkSession, path: str) -> DataFrame:
    """(layer, crs, rows) of a GeoPackage, read where Spark reads it."""

    def of(batches):
        for batch in batches:
            for content in batch["content"]:
                con = _opened(content)
                names = con.execute("select table_name, srs_id from gpkg_contents where data_type = 'features' order by table_name").fetchall()
                yield pd.DataFrame([(n, s, con.execute(f'select count(*) from "{n}"').fetchone()[0]) for n, s in names], columns=["layer", "crs", "rows"])

    return _content(spark, path).mapInPandas(of, "layer string, crs int, rows long")


def read_layer(spark: SparkSession, path: str, layer: str, attributes: list[str], key: str, crs: int = GRID) -> tuple[DataFrame, DataFrame]:
    """(features, rings) of a GeoPackage's layer: its attributes as text, and its corners keyed by `key`; another reference system or a missing column raises.

    One file is opened by one task, as its pages can't be split; a layer must fit a task's memory. Null and empty
    geometries have no rings.
    """

    def rows(content: bytes):
        con = _opened(content)
        found = con.execute("select c.srs_id, g.column_name from gpkg_contents c join gpkg_geometry_columns g on g.table_name = c.table_name where c.table_name = ?", (layer,)).fetchone()
        if found is None:
            raise ValueError(f"no layer {layer}")
        if found[0] != crs:
            raise ValueError(f"layer {layer} has reference system {found[0]}, not {crs}")
        have = {r[1] for r in con.execute(f'pragma table_info("{layer}")')}
        if gone := [a for a in (key, *attributes) if a not in have]:
            raise ValueError(f"layer {layer} has no {', '.join(gone)}")
        names = ", ".join(f'cast("{a}" as text)' for a in (key, *attributes))
        return con.execute(f'select {names}, "{found[1]}" from "{layer}"')

    def features(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame([r[:-1] for r in rows(content)], columns=["feature", *attributes], dtype=object)

    def shapes(batches):
        for batch in batches:
            for content in batch["content"]:
                out = []
                for r in rows(content):
                    blob = r[-1]
                    if blob is None or blob[3] & 0x10:
                        continue
                    for p, polygon in enumerate(_rings(blob[8 + ENVELOPE[blob[3] >> 1 & 7] :])):
                        out += [(r[0], p, k, k > 0, [x for x, _ in ring], [y for _, y in ring]) for k, ring in enumerate(polygon)]
                yield pd.DataFrame(out, columns=["feature", "part", "ring", "hole", "xs", "ys"])

    kind = ", ".join(f"`{a}` string" for a in ("feature", *attributes))
    return _content(spark, path).mapInPandas(features, kind), _content(spark, path).mapInPandas(shapes, RINGS)


def write_layers(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, DataFrame]], crs: int = GRID) -> None:
    """A GeoPackage of layers, each (features, rings) as read_layer gives them; a map's file, so every layer must fit the driver: 1,000,000 features at most, more raise. A feature without rings has a null geometry; the file is moved into place when it is whole."""
    con = sqlite3.connect(":memory:")
    con.executescript(f"""pragma application_id = 1196444487; pragma user_version = 10300;
    create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
    insert into gpkg_spatial_ref_sys values ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', null), ('Undefined geographic', 0, 'NONE', 0, 'undefined', null), ('EPSG:{crs}', {crs}, 'EPSG', {crs}, 'EPSG:{crs}', null);
    create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text not null default '2000-01-01T00:00:00.000Z', min_x double, min_y double, max_x double, max_y double, srs_id integer references gpkg_spatial_ref_sys(srs_id));
    create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));""")
    for name, (features, rings) in tables.items():
        if features.limit(1_000_001).count() > 1_000_000:
            raise ValueError(f"layer {name} has too many features for one file")
        names = [c for c in features.columns if c != "feature"]
        shapes: dict[str, dict[int, dict[int, list]]] = {}
        for r in rings.collect():
            shapes.setdefault(r["feature"], {}).setdefault(r["part"], {})[r["ring"]] = list(zip(r["xs"], r["ys"], strict=True))
        con.execute(f'create table "{name}" (fid integer primary key, geom blob, feature text{"".join(f", {chr(34)}{c}{chr(34)} text" for c in names)})')
        for r in features.orderBy("feature").collect():
            parts = shapes.get(r["feature"])
            blob = None if parts is None else b"GP" + struct.pack("<BBi", 0, 1, crs) + _wkb([[rs[k] for k in sorted(rs)] for _, rs in sorted(parts.items())])
            con.execute(f'insert into "{name}" (geom, feature{"".join(f", {chr(34)}{c}{chr(34)}" for c in names)}) values (?, ?{", ?" * len(names)})', (blob, r["feature"], *(None if r[c] is None else str(r[c]) for c in names)))
        corners = [p for parts in shapes.values() for rs in parts.values() for ring in rs.values() for p in ring]
        box = (min(x for x, _ in corners), min(y for _, y in corners), max(x for x, _ in corners), max(y for _, y in corners)) if corners else (None,) * 4
        con.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (name, name, *box, crs))
        con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, crs))
    con.commit()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    staged, target = fs_path(f"{path}.staging"), fs_path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(staged, True)
    stream.write(bytearray(con.serialize()))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(staged, target):
        raise OSError(f"could not move {staged} to {path}")


def read_shapefile(spark: SparkSession, path: str, key: str, attributes: list[str], projection: str = "British_National_Grid") -> tuple[DataFrame, DataFrame]:
    """(features, rings) of a polygon or point shapefile, path without its ending: .shp, .dbf and .prj are read together, and the projection's name must stand in .prj.

    Rings that run clockwise begin a part, the others are its holes, as the format says. One file is one task's work.
    """
    raw = spark.read.format("binaryFile").load([f"{path}.{e}" for e in ("shp", "dbf", "prj")])
    one = raw.select(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("kind"), "content").groupBy().pivot("kind", ["shp", "dbf", "prj"]).agg(F.first("content"))

    def table(dbf: bytes) -> list[dict[str, str]]:
        rows, head, size = struct.unpack_from("<IHH", dbf, 4)
        fields, at = [], 32
        while dbf[at] != 0x0D:
            fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
            at += 32
        out = []
        for k in range(rows):
            at = head + k * size + 1
            row = {}
            for name, width in fields:
                row[name] = dbf[at : at + width].decode("utf-8", "replace").strip()
                at += width
            out.append(row)
        return out

    def shapes(shp: bytes) -> list[list]:
        out, at = [], 100
        while at < len(shp):
            (words,) = struct.unpack_from(">I", shp, at + 4)
            (kind,) = struct.unpack_from("<I", shp, at + 8)
            if kind == 0:
                out.append([])
            elif kind == 1:
                out.append([[[struct.unpack_from("<2d", shp, at + 12)]]])
            elif kind == 5:
                n_parts, n = struct.unpack_from("<2I", shp, at + 44)
                starts = [*struct.unpack_from(f"<{n_parts}I", shp, at + 52), n]
                flat = struct.unpack_from(f"<{2 * n}d", shp, at + 52 + 4 * n_parts)
                points = list(zip(flat[::2], flat[1::2], strict=True))
                polygons: list[list] = []
                for a, b in zip(starts, starts[1:], strict=False):
                    ring = points[a:b]
                    turn = sum((x2 - x1) * (y2 + y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False))
                    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
                    if turn >= 0 or not polygons:
                        polygons.append([ring])
                    else:
                        polygons[-1].append(ring)
                out.append(polygons)
            else:
                raise ValueError(f"shapes of kind {kind}")
            at += 8 + 2 * words
        return out

    def both(row) -> tuple[list[dict], list[list]]:
        if projection not in bytes(row.prj or b"").decode("utf-8", "replace"):
            raise ValueError(f"the projection isn't {projection}")
        records, found = table(bytes(row.dbf)), shapes(bytes(row.shp))
        if len(records) != len(found):
            raise ValueError(f"{len(records)} records and {len(found)} shapes")
        if records and (gone := [a for a in (key, *attributes) if a not in records[0]]):
            raise ValueError(f"no columns {', '.join(gone)}")
        return records, found

    def features(batches):
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame([(r[key], *(r[a] for a in attributes)) for r in both(row)[0]], columns=["feature", *attributes], dtype=object)

    def corners(batches):
        for batch in batches:
            for row in batch.itertuples():
                records, found = both(row)
                yield pd.DataFrame([(r[key], p, k, k > 0, [x for x, _ in ring], [y for _, y in ring]) for r, polygons in zip(records, found, strict=True) for p, rings in enumerate(polygons) for k, ring in enumerate(rings)], columns=["feature", "part", "ring", "hole", "xs", "ys"])

    return one.mapInPandas(features, ", ".join(f"`{a}` string" for a in ("feature", *attributes))), one.mapInPandas(corners, RINGS)


def ring_edges(rings: DataFrame, company: DataFrame) -> DataFrame:
    """The edge table of rings, for the joins of points with polygons; company: (feature, company)."""
    after = F.concat(F.slice("xs", 2, F.size("xs")), F.slice("xs", 1, 1)), F.concat(F.slice("ys", 2, F.size("ys")), F.slice("ys", 1, 1))
    e = rings.select(F.col("feature").alias("polygon"), F.explode(F.arrays_zip(F.col("xs").alias("x1"), F.col("ys").alias("y1"), after[0].alias("x2"), after[1].alias("y2"))).alias("e"))
    return e.join(company.withColumnRenamed("feature", "polygon"), "polygon").select("polygon", "company", "e.x1", "e.y1", "e.x2", "e.y2")
