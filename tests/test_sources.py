"""Readers, writers, the configured run and the stream, on files written here."""

import datetime as dt
import json

import numpy as np
import pytest

from eventide.plans import workflow
from eventide.sources import files
from eventide.streaming import tails


def csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n")


HEAD = "company,permit_number,location_name,start_time,stop_time"


def test_folder_of_csv_files(spark, tmp_path):
    z = ("2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z")
    csv(tmp_path / "a" / "run_2021.csv", HEAD, [("a", "007", "x", *z)])
    csv(tmp_path / "b" / "run_2021_2022.csv", " stop_time , company,location_name,permit_number,start_time,extra", [(z[1], "b", "y", "8", z[0], 1)])
    rows = sorted(files.read_csv(spark, str(tmp_path)).collect(), key=lambda r: r.company)
    assert [(r.company, r.permit_number, r.stop_time, r.source_year) for r in rows] == [("a", "007", z[1], "2021"), ("b", "8", z[1], "")]
    assert rows[0].source_file.endswith("run_2021.csv")
    assert files.company_files(spark, str(tmp_path), ["a", "b"], {("a", "2021")}) == {"a": [], "b": files.csv_files(spark, str(tmp_path / "b"))}
    with pytest.raises(ValueError, match="unknown folders"):
        files.company_files(spark, str(tmp_path), ["a"])
    csv(tmp_path / "c" / "x.csv", "company", [("a",)])
    with pytest.raises(ValueError, match="missing columns"):
        files.read_csv(spark, str(tmp_path / "c"))


def test_provider_columns(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"Permit": {"0": "P1", "1": "P2"}, "Start": {"0": 0, "1": 60000}, "Stop": {"0": 90000, "1": 60000}}))
    fields = {"Permit": "permit_number", "Start": "start_time", "Stop": "stop_time"}
    assert {(r.permit_number, r.duration_minutes) for r in files.provider_events(spark, str(p), fields).collect()} == {("P1", 1.5), ("P2", 0.0)}
    p.write_text(json.dumps({"Permit": {"0": "P1"}, "Start": {"0": 5}, "Stop": {"0": 1}}))
    with pytest.raises(ValueError, match="ordered"):
        files.provider_events(spark, str(p), fields)
    p.write_text(json.dumps({"Permit": {"0": "P1"}, "Start": {"1": 5}, "Stop": {"0": 9}}))
    with pytest.raises(ValueError, match="row ids"):
        files.provider_events(spark, str(p), fields)


def test_coordinates_and_manual_lines(spark):
    frame = spark.createDataFrame([("1000000", "600000"), ("600000", "1000000"), ("x", "1")], "x string, y string")
    assert [(r.x, r.y, r.swapped, r.valid) for r in files.repaired_coordinates(frame).collect()] == [(600000.0, 1000000.0, True, True), (600000.0, 1000000.0, False, True), (None, 1.0, False, False)]
    lines = spark.createDataFrame([(1, "UK12 is demo::S1"), (2, ""), (3, "UK1 UK2"), (4, "none")], "line_no int, value string")
    assert [(r.line_no, r.status) for r in files.manual_matches(lines).orderBy("line_no").collect()] == [(1, "one_sensor"), (3, "not_one_works"), (4, "no_ids")]


def test_polygons(spark, tmp_path):
    feature = lambda ring: {"features": [{"properties": {"identifier": "p", "company": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    p = tmp_path / "p.json"
    p.write_text(json.dumps(feature([[0, 0], [1, 0], [1, 1], [0, 0]])))
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in files.polygon_edges(spark, str(p)).collect()) == [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)]
    p.write_text(json.dumps(feature([[0, 0], [1, 0], [1, 1], [0, 1]])))
    with pytest.raises(ValueError, match="ring"):
        files.polygon_edges(spark, str(p))


def test_writes_archives_and_pointers(spark, tmp_path):
    frame = spark.range(5).withColumnRenamed("id", "k")
    at = str(tmp_path / "runs" / "one")
    assert files.write_once(frame, at).count() == 5
    with pytest.raises(FileExistsError):
        files.write_once(frame, at)
    assert files.write_once(frame.limit(2), at, force=True).count() == 2
    (tmp_path / "runs" / "LATEST.txt").write_text("one\n")
    assert files.latest_run(spark, str(tmp_path / "runs")).endswith("one")
    assert files.archive_once(spark, at, str(tmp_path / "copy")) == files.archive_once(spark, at, str(tmp_path / "copy"))
    files.write_once(frame, at, force=True)
    with pytest.raises(ValueError, match="differs"):
        files.archive_once(spark, at, str(tmp_path / "copy"))


def inputs(tmp_path, evidence="polygon"):
    rng = np.random.default_rng(0)
    uids = [("demo_a" if k % 2 == 0 else "demo_b", f"S{k:03d}") for k in range(18)]
    rows = []
    for c, p in uids:
        at = dt.datetime(2025, 1, 1)
        for d in [*rng.exponential(500, 14) + 241, *rng.uniform(5, 200, 6)]:
            rows.append((c, p, "x", f"{at.isoformat()}Z", f"{(at + dt.timedelta(minutes=float(d))).isoformat()}Z"))
            at += dt.timedelta(days=5)
    csv(tmp_path / "events.csv", HEAD, rows)
    csv(tmp_path / "assignments.csv", "sensor_uid,company,uwwCode,assignment_evidence", [(f"{c}::{p}", c, f"U{k}", evidence if k else "polygon") for k, (c, p) in enumerate(uids)])
    csv(tmp_path / "exposure.csv", "sensor_uid,monitoring_years", [(f"{c}::{p}", 1 + k / 10) for k, (c, p) in enumerate(uids)])
    csv(tmp_path / "predictors.csv", "company,uwwCode,rain,area", [(c, f"U{k}", 700 + k * 13 % 50, 3 + k * 7 % 11) for k, (c, _) in enumerate(uids)])
    return workflow.Config(*(str(tmp_path / f"{n}.csv") for n in ("events", "assignments", "exposure", "predictors")), str(tmp_path / "out"), ["rain", "area"])


def test_configured_run(spark, tmp_path):
    config = inputs(tmp_path)
    done = workflow.run(spark, config)
    assert list(done) == list(workflow.STAGES) and done["master"].count() == 18 and done["univariate"].count() == 8
    assert {r.status for r in done["fit"].collect()} == {"fitted"} and done["univariate"].where("q < p").count() == 0
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["outputs"]["master"] == 18 and all(len(v[1]) == 64 for v in manifest["inputs"].values())
    with pytest.raises(FileExistsError):
        workflow.run(spark, config)
    config.force = True
    assert list(workflow.run(spark, config, through="fit")) == ["clean", "fit"]


def test_contracts_refuse(spark, tmp_path):
    config = inputs(tmp_path, evidence=" ")
    with pytest.raises(ValueError, match="evidence"):
        workflow.run(spark, config)
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="locked"):
        workflow.Config("", "", "", "", "", threshold=239)
    with pytest.raises(ValueError, match="outcomes"):
        workflow.Config("", "", "", "", "", ["fitted_beta"])


def test_stream_counts_once(spark, tmp_path):
    schema = "company string, permit_number string, start_time timestamp, stop_time timestamp"
    at = dt.datetime(2026, 1, 1, 6)
    rows = [("A ", "1", at, at + dt.timedelta(minutes=241))] * 2 + [("a", "2", at, at + dt.timedelta(minutes=240)), ("a", "3", at, at - dt.timedelta(minutes=1)), ("a", "9", at + dt.timedelta(days=9), at + dt.timedelta(days=9))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tails.tail_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tails").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.company, r.events, r.tail_events) for r in spark.table("tails").collect()] == [("a", 2, 1)]


PROVIDED = "location_name,permit_number,start_time,stop_time,duration_minutes"


def test_pooled_companies_and_counters(spark, tmp_path):
    row = ("x", "P1", "2026-01-01 00:00:00", "2026-01-01 01:00:00", "60")
    csv(tmp_path / "a" / "f_2024.csv", PROVIDED, [row, row, ("x", "", *row[2:]), ("x", "P2", "soon", row[3], "abc")])
    csv(tmp_path / "a" / "f_2023.csv", PROVIDED, [row])
    csv(tmp_path / "b" / "f.csv", " permit_number ,location_name,duration_minutes,stop_time,start_time", [("P9", "y", "-1", row[3], row[2])])
    got = files.company_events(spark, str(tmp_path), ["a", "b"], {("a", "2023")}).collect()
    assert sorted((r.company, r.permit_number or "", r.duration_minutes) for r in got) == [("a", "", "60"), ("a", "P1", "60"), ("a", "P1", "60"), ("a", "P2", "abc"), ("b", "P9", "-1")]
    kept, counters = workflow.scan_provided(spark, str(tmp_path / "a"))
    assert kept.count() == 3
    by = {r.source_file.rsplit("/", 1)[-1]: r for r in counters.collect()}
    r = by["f_2024.csv"]
    assert (r.rows_read, r.rows_valid, r.rows_rejected, r.missing_permit, r.non_numeric, r.duplicate_rows) == (4, 2, 2, 1, 1, 2) and by["f_2023.csv"].rows_valid == 1


def test_hourly_arrays(spark, tmp_path):
    mm = np.arange(48, dtype=np.float32).reshape(24, 2)
    counts = np.full((24, 2), 12)
    counts[3, 1] = 11
    (tmp_path / "2024").mkdir()
    np.savez_compressed(tmp_path / "2024" / "20240229.npz", rainfall_hourly_mm=mm, valid_5min_count_by_hour=counts, source_5min_count_by_hour=np.full(24, 12))
    rows = files.hourly_arrays(spark, str(tmp_path)).collect()
    assert len(rows) == 48 and {r.date for r in rows} == {dt.date(2024, 2, 29)}
    assert {(r.hour, r.place): (r.mm, r.samples) for r in rows}[(3, 1)] == (7.0, 11)
    np.savez_compressed(tmp_path / "2024" / "20240301.npz", rainfall_hourly_mm=mm, valid_5min_count_by_hour=counts[:5], source_5min_count_by_hour=np.full(24, 12))
    with pytest.raises(Exception, match="shapes"):
        files.hourly_arrays(spark, str(tmp_path)).collect()


def test_raster_gates(spark):
    tags = {"grid_mapping_name": "transverse_mercator", "variable": "rainfall", "units": "mm", "longitude_of_central_meridian": "-2", "latitude_of_projection_origin": "49", "false_easting": "400000", "false_northing": "-100000", "scale_factor_at_central_meridian": "0.9996012717"}
    cells = spark.createDataFrame([(r, c, 1000.0 * c, 2000.0 - 1000 * r, v) for r, c, v in ((0, 0, 1.0), (0, 1, -1.0), (1, 0, 1e20), (1, 1, float("nan")))], "row int, col int, x double, y double, value double")
    assert {(r.row, r.col): r.valid for r in files.raster_cells(cells, tags).collect()} == {(0, 0): True, (0, 1): False, (1, 0): False, (1, 1): False}
    for bad, other in ((cells, tags | {"units": "m"}), (cells, tags | {"false_easting": "0"}), (cells.withColumn("x", cells.x + cells.row), tags), (cells.union(cells), tags), (cells.where("row = 1"), tags)):
        with pytest.raises(ValueError):
            files.raster_cells(bad, other)


def test_configuration_files(spark, tmp_path):
    config = inputs(tmp_path)
    found = {"paths": {n: f"{n}.csv" for n in ("events", "assignments", "exposure", "predictors")} | {"output": "out"}, "predictors": ["rain", "area"], "seed": 7, "analysis": {"tail_threshold_minutes": 240, "tail_rule": "strictly_greater_than"}}

    def write(change):
        (tmp_path / "c.json").write_text(json.dumps(found | change))
        return str(tmp_path / "c.json")

    got = workflow.load_config(spark, write({}))
    assert (got.events, got.declared, got.seed, got.output) == (config.events, ["rain", "area"], 7, str(tmp_path / "out"))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(found))
    assert workflow.load_config(spark, str(tmp_path / "c.yaml")) == got
    for change, error in (({"paths": {}}, "without paths"), ({"predictors": []}, "predictors"), ({"analysis": {"tail_rule": "at_least"}}, "locked"), ({"analysis": {"tail_threshold_minutes": 239}}, "locked")):
        with pytest.raises(ValueError, match=error):
            workflow.load_config(spark, write(change))
    with pytest.raises(FileNotFoundError, match="events"):
        workflow.load_config(spark, write({"paths": found["paths"] | {"events": "gone.csv"}}))


def test_a_write_computes_its_frame_once_and_keeps_the_old_until_the_new_is_there(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame(spark.sparkContext.parallelize(range(10)).map(lambda k: (seen.add(1), (k, {"a": k}))[1]), "k long, m map<string, int>")
    at = str(tmp_path / "out")
    assert files.write_once(frame, at).count() == 10 and seen.value == 10
    bad = frame.selectExpr("raise_error('no') as k")
    with pytest.raises(Exception, match="no"):
        files.write_once(bad, at, force=True)
    assert spark.read.parquet(at).count() == 10
    assert files.write_once(frame.limit(3), at, force=True).count() == 3 and not files.exists(spark, at + ".replaced")
