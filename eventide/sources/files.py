"""Readers and writers: event files, provider JSON, manual decisions, polygons, staged writes and manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import inside_grid, number, year_in_name

EVENTS = T.StructType([T.StructField(n, T.StringType()) for n in ("company", "permit_number", "location_name", "start_time", "stop_time")])
PROVIDED = T.StructType([T.StructField(n, T.StringType()) for n in ("location_name", "permit_number", "start_time", "stop_time", "duration_minutes")])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _listed(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((s.getPath().toString(), s.isDirectory(), s.getLen()) for s in found)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = EVENTS) -> DataFrame:
    """One CSV, a list of them or every CSV below a folder, columns by name with trimmed headers, permits as text; `source_file` and `source_year` are added.

    The driver looks at each file's first line; files of one header are read together and united by name with the others.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    headers: dict[str, list[str]] = {}
    for r in _headers(spark, path):
        headers.setdefault(r[1], []).append(r[0])
    parts = []
    for head, files in headers.items():
        names = [h.strip().strip('"') for h in head.lstrip("﻿").split(",")]
        if missing := [f.name for f in schema.fields if f.name not in names]:
            raise ValueError(f"{files[0]}: missing columns {', '.join(missing)}")
        own = T.StructType([T.StructField(n, T.StringType()) for n in names])
        frame = reader.schema(own).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(files)
        parts.append(frame.select(*(F.col(f.name) for f in schema.fields), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("__name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("source_year", year_in_name(F.regexp_replace("__name", r"\.[^.]*$", ""))).drop("__name")


def _headers(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str]]:
    """(file, first line) of each CSV."""
    found = csv_files(spark, path) if isinstance(path, str) else list(path)
    if not found:
        raise FileNotFoundError(str(path))
    fs = spark._jvm.org.apache.hadoop.fs
    out = []
    for f in found:
        p = fs.Path(f)
        stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
        lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        out.append((f, lines.readLine() or ""))
        lines.close()
    return out


def csv_files(spark: SparkSession, path: str) -> list[str]:
    if path.endswith(".csv"):
        return [path]
    out = []
    for name, folder, _ in _listed(spark, path):
        out += csv_files(spark, name) if folder else [name] * name.endswith(".csv")
    return sorted(out)


def company_files(spark: SparkSession, root: str, companies: list[str], excluded: set[tuple[str, str]] = frozenset()) -> dict[str, list[str]]:
    """The CSV files of each company's folder but those of excluded (company, year); missing and unknown folders raise."""
    found = {name.rstrip("/").rsplit("/", 1)[-1]: name for name, folder, _ in _listed(spark, root) if folder}
    if found.keys() != set(companies):
        raise ValueError(f"missing folders {sorted(set(companies) - found.keys())}, unknown folders {sorted(found.keys() - set(companies))}")
    return {c: [f for f in csv_files(spark, found[c]) if (c, infer_year(f)) not in excluded] for c in companies}


def company_events(spark: SparkSession, root: str, companies: list[str], excluded: set[tuple[str, str]] = frozenset(), schema: T.StructType = PROVIDED) -> DataFrame:
    """All companies' events pooled, each row's company that of its folder, whatever the file says; excluded (company, year) files aren't read."""
    out = None
    for company, found in company_files(spark, root, companies, excluded).items():
        if found:
            own = read_csv(spark, found, schema).withColumn("company", F.lit(company))
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise FileNotFoundError(root)
    return out


def hourly_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rainfall of daily NPZ files (YYYYMMDD.npz) as rows (date, hour, place, mm, samples, source_samples).

    A file holds rainfall_hourly_mm and valid_5min_count_by_hour, hours by places, and source_5min_count_by_hour, by
    hour. Files are read where Spark reads them and taken apart one at a time; a file of another shape raises.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def parts(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                stem = name.rsplit("/", 1)[-1].removesuffix(".npz")
                with np.load(io.BytesIO(content)) as z:
                    mm, samples, source = (np.asarray(z[k]) for k in ("rainfall_hourly_mm", "valid_5min_count_by_hour", "source_5min_count_by_hour"))
                if mm.ndim != 2 or samples.shape != mm.shape or source.shape != mm.shape[:1]:
                    raise ValueError(f"{name}: arrays of shapes {mm.shape}, {samples.shape}, {source.shape}")
                hours, places = mm.shape
                yield pd.DataFrame({"day": stem, "hour": np.repeat(np.arange(hours), places), "place": np.tile(np.arange(places), hours), "mm": mm.ravel().astype(float), "samples": samples.ravel().astype(np.int32), "source_samples": np.repeat(source, places).astype(np.int32)})

    rows = raw.mapInPandas(parts, "day string, hour int, place int, mm double, samples int, source_samples int")
    return rows.select(F.to_date("day", "yyyyMMdd").alias("date"), "hour", "place", "mm", "samples", "source_samples")


def raster_cells(cells: DataFrame, tags: dict[str, str], size: float = 1000.0, variable: str = "rainfall", units: str = "mm") -> DataFrame:
    """A raster band given as cells (row, col, x, y, value), x and y a cell's upper left corner, with `valid`: the gates of its metadata and of its grid come first.

    tags: grid_mapping_name, variable, units and the projection's numbers. The cells must lie on one grid of `size`, rows
    downward, one value a cell; some must be finite. Negative and huge values mark cells without data.
    """
    want = {"longitude_of_central_meridian": -2.0, "latitude_of_projection_origin": 49.0, "false_easting": 400_000.0, "false_northing": -100_000.0, "scale_factor_at_central_meridian": 0.9996012717}
    bad = [k for k, v in want.items() if abs(float(tags.get(k, "nan")) - v) > 1e-6 or k not in tags]
    if tags.get("grid_mapping_name") != "transverse_mercator" or bad:
        raise ValueError(f"the grid isn't the national one: {bad or tags.get('grid_mapping_name')}")
    if tags.get("variable") != variable or tags.get("units") != units:
        raise ValueError(f"the band isn't {variable} in {units}")
    usable = F.coalesce(~F.isnan("value") & (F.col("value") < 1e10), F.lit(False))
    left, top = F.col("x") - F.col("col") * size, F.col("y") + F.col("row") * size
    one = cells.agg(F.min(left).alias("l0"), F.max(left).alias("l1"), F.min(top).alias("t0"), F.max(top).alias("t1"), F.count_if(usable).alias("usable")).first()
    if one["l0"] is None or one["l0"] != one["l1"] or one["t0"] != one["t1"]:
        raise ValueError(f"the cells aren't aligned at {size}")
    if n := cells.groupBy("row", "col").agg(F.count("*").alias("n")).where("n > 1").count():
        raise ValueError(f"{n} cells stand more than once")
    if not one["usable"]:
        raise ValueError("no usable cell")
    return cells.withColumn("valid", usable & (F.col("value") >= 0))


def infer_year(path: str) -> str:
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    years = set(re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", stem))
    return years.pop() if len(years) == 1 else ""


def columns_json(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """A JSON object of columns, each an object of row ids -> values, as rows (row_id, fields); the columns must have the same row ids."""
    kind = T.StructType([T.StructField(f, T.MapType(T.StringType(), T.StringType())) for f in fields])
    raw = spark.read.schema(kind).option("multiLine", True).json(path)
    keys = F.map_keys(F.col(next(iter(fields))))
    bad = raw.where(" or ".join([f"`{f}` is null" for f in fields] + [f"size(array_except(map_keys(`{f}`), map_keys(`{next(iter(fields))}`))) > 0 or size(`{f}`) <> size(`{next(iter(fields))}`)" for f in list(fields)[1:]]))
    if not bad.isEmpty():
        raise ValueError("columns are missing or have different row ids")
    rows = raw.select(F.explode(keys).alias("row_id"), *fields)
    return rows.select("row_id", *(F.element_at(F.col(f), F.col("row_id")).alias(to) for f, to in fields.items()))


def provider_events(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Provider columns as events: epoch milliseconds become times, and rows whose stop precedes their start raise."""
    out = columns_json(spark, path, fields)
    for c in ("start_time", "stop_time"):
        out = out.withColumn(c, F.timestamp_millis(F.col(c).try_cast("double").cast("long")))
    out = out.withColumn("duration_minutes", (F.unix_micros("stop_time") - F.unix_micros("start_time")) / 6e7)
    if n := out.where("start_time is null or stop_time is null or duration_minutes < 0").count():
        raise ValueError(f"{n} rows without two ordered times")
    return out


def repaired_coordinates(frame: DataFrame) -> DataFrame:
    """x and y exchanged where only the exchanged pair is inside the grid's bounds; `swapped` and `valid` say so."""
    x, y = number(F.col("x")), number(F.col("y"))
    swap = ~inside_grid(x, y, True) & inside_grid(y, x, True)
    out = frame.withColumn("swapped", swap).withColumn("__x", F.when(swap, y).otherwise(x)).withColumn("__y", F.when(swap, x).otherwise(y))
    return out.drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"}).withColumn("valid", inside_grid(F.col("x"), F.col("y"), True))


def manual_matches(lines: DataFrame, works: str = r"\b(UK[A-Z0-9_]+)\b", sensors: str = r"\b([a-z_]+::[A-Za-z0-9./-]+)") -> DataFrame:
    """Free-text decisions (line_no, value): the ids that a line holds and what it decides."""
    w, s = F.array_distinct(F.regexp_extract_all("value", F.lit(works), 1)), F.array_distinct(F.regexp_extract_all("value", F.lit(sensors), 1))
    status = F.when((F.size(w) == 0) & (F.size(s) == 0), "no_ids").when(F.size(w) != 1, "not_one_works").when(F.size(s) == 0, "no_sensor").when(F.size(s) == 1, "one_sensor").otherwise("several_sensors")
    return lines.where("trim(value) <> ''").select("line_no", w.alias("works"), s.alias("sensors"), status.alias("status"))


def polygon_edges(spark: SparkSession, path: str, identifier: str = "identifier", company: str = "company") -> DataFrame:
    """The edge table of a GeoJSON file's polygons; rings that aren't closed, or have under four points, raise."""
    ring = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    kind = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", ring)]))])))])
    f = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rings = f.select(F.col("f.properties")[identifier].alias("polygon"), F.col("f.properties")[company].alias("company"), F.posexplode("f.geometry.coordinates").alias("ring", "points"))
    if not rings.where("size(points) < 4 or points[0] <> points[size(points) - 1] or polygon is null").isEmpty():
        raise ValueError("a ring is open or too short, or a polygon has no identifier")
    pairs = F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b")))
    e = rings.select("polygon", "company", "ring", pairs.alias("e"))
    return e.select("polygon", "company", "ring", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


def _proof(frame: DataFrame) -> list:
    """Aggregates that tell two frames apart: rows, and the sum of their hashes (columns that can't be hashed, maps, are left out)."""
    names = [f.name for f in frame.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = F.sum(F.xxhash64(*(F.col(f"`{n}`") for n in names)).cast("decimal(38,0)")) if names else F.lit(0)
    return [F.count(F.lit(1)).alias("n"), hashed.alias("hash")]


def write_once(frame: DataFrame, path: str, force: bool = False, kind: str = "parquet") -> DataFrame:
    """Written to a staging folder, read back and compared by count, schema and a sum of row hashes, then moved into place; an existing target is refused unless forced.

    What is written is counted as it is written, so the frame is computed once. A target that is replaced stands aside
    until the new one is in place, and comes back if that fails.
    """
    spark = frame.sparkSession
    if exists(spark, path) and not force:
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staging"
    proof = _proof(frame) if kind != "csv" else [F.count(F.lit(1)).alias("n")]
    seen = Observation("written")
    writer = frame.observe(seen, *proof).write.mode("overwrite")
    writer.option("header", True).csv(staged) if kind == "csv" else writer.parquet(staged)
    back = spark.read.option("header", True).csv(staged) if kind == "csv" else spark.read.parquet(staged)
    same = back.columns == frame.columns and (kind == "csv" or [f.dataType.simpleString() for f in back.schema.fields] == [f.dataType.simpleString() for f in frame.schema.fields])
    if not same or back.agg(*proof).first().asDict() != seen.get:
        raise ValueError(f"{staged} doesn't read back as written")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}.replaced"
    before = exists(spark, path)
    if before:
        fs.delete(fs_path(aside), True)
        if not fs.rename(fs_path(path), fs_path(aside)):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(fs_path(staged), fs_path(path)):
        if before:
            fs.rename(fs_path(aside), fs_path(path))
        raise OSError(f"could not move {staged} to {path}")
    if before:
        fs.delete(fs_path(aside), True)
    return spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)


def digests(spark: SparkSession, *paths: str) -> dict[str, tuple[int, str]]:
    """path -> (bytes, SHA-256), computed where the files are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return {r[0]: (r[1], r[2]) for r in files.select("path", "length", F.sha2("content", 256)).orderBy("path").collect()}


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_manifest(spark: SparkSession, path: str, inputs: dict, outputs: dict, **more) -> None:
    write_text(spark, path, json.dumps({"inputs": inputs, "outputs": outputs, **more}, indent=1, sort_keys=True))


def latest_run(spark: SparkSession, root: str) -> str:
    """The run that LATEST.txt names: exactly one line, a folder below root."""
    lines = [r[0].strip() for r in spark.read.text(f"{root}/LATEST.txt").collect() if r[0].strip()]
    if len(lines) != 1 or not exists(spark, f"{root}/{lines[0]}"):
        raise ValueError(f"{root}/LATEST.txt doesn't name one run")
    return f"{root}/{lines[0]}"


def archive_once(spark: SparkSession, source: str, target: str) -> dict[str, tuple[int, str]]:
    """A copy of a run with its digests; a target that exists must hold the same files."""
    before = {k.rsplit("/", 1)[-1]: v for k, v in digests(spark, source).items()}
    if not exists(spark, target):
        fs = spark._jvm.org.apache.hadoop.fs
        a, b, conf = fs.Path(source), fs.Path(target), spark._jsc.hadoopConfiguration()
        fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    after = {k.rsplit("/", 1)[-1]: v for k, v in digests(spark, target).items()}
    if before != after:
        raise ValueError(f"{target} differs from {source}")
    return after
