"""Operators on hand-made cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import names as N
from eventide.functions import scalars as S
from eventide.operators import events as E
from eventide.operators import gates, joins, master, models, regress, series, spatial, tailfit

EVENT = "company string, permit_number string, location_name string, start_time string, stop_time string"


def test_core_clean(spark):
    z = "2026-01-01T00:00:00Z"
    rows = [
        (" Demo_A ", " 00123 ", "x", z, "2026-01-01T01:30:00Z"), (" Demo_A ", "00123", "a", z, "2026-01-01T01:30:00Z"),
        ("b", "1", "x", "2026-01-01T02:00:00Z", z), ("b", "1", "x", z, z), ("b", "1", "x", "soon", z),
    ]
    got = {(r.sensor_uid, r.duration_minutes, r.location_name) for r in E.clean(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {("demo_a::00123", 90.0, "a"), ("b::1", 0.0, "x")}
    with pytest.raises(ValueError, match="stop_time"):
        E.clean(spark.createDataFrame(rows, EVENT).drop("stop_time"))


PROVIDED = "source_file string, location_name string, permit_number string, start_time string, stop_time string, duration_minutes string"


def test_historical_contract(spark):
    base = ("f", "Fixture location", "P1", "2026-01-01 00:00:00", "2026-01-01 01:00:00", "60")
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(PROVIDED.split(", "), base, strict=True))
    rows = [base, base, change(permit_number=" "), change(duration_minutes="0"), change(duration_minutes="-1"), change(duration_minutes="not-a-number"), change(duration_minutes="inf"), change(start_time="bad", permit_number="P2")]
    frame = spark.createDataFrame(rows, PROVIDED)
    [q] = E.quality(frame).collect()
    assert (q.rows_read, q.rows_valid, q.rows_rejected, q.missing_permit, q.non_numeric, q.non_finite, q.non_positive, q.invalid_start_time, q.duplicate_rows) == (8, 3, 5, 1, 1, 1, 2, 1, 2)
    kept = E.historical(frame, round_15=True).collect()
    assert len(kept) == 3 and {r.duration_minutes for r in kept} == {60.0} and any(r.start_time is None for r in kept)
    assert E.hybrid(frame).count() == 2  # one of the copies, and the zero


def test_threshold_is_strict(spark):
    frame = spark.createDataFrame([(239.0,), (240.0,), (240.0001,), (float("nan"),), (float("inf"),), (None,)], "d double")
    assert [r.d for r in frame.where(E.tail(F.col("d"))).collect()] == [240.0001]


def test_modal_value_ties_by_alphabet(spark):
    frame = spark.createDataFrame([("P", n) for n in ("Zulu", "Alpha", "Zulu", "Alpha")], "p string, n string")
    assert [tuple(r) for r in E.modal(frame, ["p"], "n").collect()] == [("P", "Alpha", 2, 4)]


def test_parsers_and_labels(spark):
    row = spark.range(1).select(
        S.permit_letters(F.lit("a b-1")).alias("a"), S.file_token(F.lit("  A--b! ")).alias("b"), S.duration_label(F.lit(90.0)).alias("c"), S.duration_label(F.lit(10080.0)).alias("d"), S.year_in_name(F.lit("x_2021_v2")).alias("e"),
        S.erfc_p(F.lit(1.5)).alias("p"), S.erfc_p(F.lit(7.0)).alias("q"), S.file_token(F.lit("!!")).alias("f"),
    ).first()
    assert tuple(row)[:5] == ("AB1", "a_b", "1.5 h", "1 wk", "2021") and row.f == "unknown"
    assert row.p == pytest.approx(math.erfc(1.5 / 2**0.5), abs=1e-12) and row.q == pytest.approx(math.erfc(7 / 2**0.5), rel=1e-9)


def test_names(spark):
    texts = ["SCAYNES HILL SSO", "Scaynes  Hill, STW", "Ｆｕｌｌ Width STW", "STORM STORM", "North Dale No 2 PS"]
    frame = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("f", N.full_name(F.col("raw")))
    got = {r.raw: (r.core, r.kind) for r in frame.select("raw", N.place_core(F.col("f")).alias("core"), N.facility_kind(F.col("f")).alias("kind")).collect()}
    assert got == {texts[0]: ("SCAYNES HILL", "STORM OVERFLOW"), texts[1]: ("SCAYNES HILL", "TREATMENT WORKS"), texts[2]: ("FULL WIDTH", "TREATMENT WORKS"), texts[3]: ("", ""), texts[4]: ("NORTH DALE NO 2", "PUMPING STATION")}
    pairs = [("NORTH DALE", "SOUTH DALE"), ("DALE NO 2", "DALE NO 3"), ("DALE", "DALE MILL"), ("DALE", "DALE"), ("", "DALE"), ("OX", "OX MILL")]
    frame = spark.createDataFrame(pairs, "l string, r string")
    rows = frame.select("l", "r", N.qualifier_conflict(F.col("l"), F.col("r")).alias("c"), N.subset_match(F.col("l"), F.col("r")).alias("s"), N.composite_score(F.col("l"), F.col("r")).alias("x")).collect()
    assert [r.c for r in rows] == [True, True, False, False, False, False] and [r.s for r in rows] == [False, False, True, False, False, False]
    assert rows[3].x == 100 and rows[4].x == 0 and 50 < rows[2].x < 100


def test_token_scores():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return 200 * t[-1][-1] / (len(a) + len(b))

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert N._indel(a, b) == pytest.approx(plain(a, b))
    assert N.token_set_score("mill dale", "dale") == 100 and N.token_set_score("a", "") == 0 and N.weighted_score("dale", "dale") == 100


def test_nearest_same_company_first_on_ties(spark):
    s = spark.createDataFrame([("s", "a", 0.0, 0.0), ("t", "a", 9000.0, 0.0)], "sensor string, company string, x double, y double")
    w = spark.createDataFrame([("w2", "a", 10.0, 0.0), ("w1", "a", 0.0, 10.0), ("w0", "b", 0.0, 0.0)], "works string, company string, works_x double, works_y double")
    assert [tuple(r) for r in joins.nearest(s, w, "company", 5000.0).collect()] == [("s", "w1", 10.0)]


def test_checked_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 10)], "k int, b int")
    assert joins.preserving_join(a, b, ["k"]).count() == 3
    with pytest.raises(ValueError, match="right side"):
        joins.checked_join(a, b.union(b), ["k"])
    with pytest.raises(ValueError, match="left side"):
        joins.checked_join(a, b, ["k"], validate="one_to_one")


def test_cascade_is_ambiguous(spark):
    locations = spark.createDataFrame([("l1", "AB-1"), ("l2", "A B1"), ("l3", "C 2")], "location string, permit string")
    keys = spark.createDataFrame([("AB.1",), ("C2",), ("C 2",), ("zz",)], "key string")
    assert {r.key: r.status for r in joins.cascade(locations, keys).collect()} == {"AB.1": "ambiguous", "C2": "normalised", "C 2": "exact", "zz": "unmatched"}


PAIR = "company string, code string, sensor string, x double, y double, works_x double, works_y double, audited double, exact boolean, score double, margin double"


def choose(spark, rows):
    frame = spark.createDataFrame(rows, PAIR)
    universe = spark.createDataFrame([("a", "W", True), ("a", "none", True)], "company string, code string, works_ok boolean")
    return {r.code: r for r in joins.review(joins.primary(universe, joins.candidate_distances(frame))).collect()}


def pair(sensor, d, exact=True, score=90.0):
    return ("a", "W", sensor, d, 0.0, 0.0, 0.0, d, exact, score, 9.0)


def test_primary_selection(spark):
    got = choose(spark, [pair("s1", 900.0), pair("s2", 200.0)])
    assert (got["W"].sensor, got["W"].status) == ("s2", "selected_nearest_of_multiple_within_1000m") and got["none"].status == "unassigned_no_accepted_name_candidate"
    got = choose(spark, [pair("s1", 1500.0), pair("s2", 2500.0)])["W"]
    assert (got.sensor, got.tier, got.status) == ("s1", 2000.0, "selected_unique_within_2000m")
    both = [pair("s1", 500.0, False, 99.0), pair("s2", 500.0, True, 85.0)]
    assert choose(spark, both)["W"].sensor == choose(spark, both[::-1])["W"].sensor == "s2"
    assert choose(spark, [pair("s1", None)])["W"].status == "unassigned_no_coordinate_eligible_candidate"
    assert choose(spark, [pair("s1", 3001.0)])["W"].status == "unassigned_no_candidate_within_max_radius"


def test_latest_capacity(spark):
    rows = [("a", "n", 2020.0, 1.0, 2.0), ("a", "n", 2021.0, 3.0, 2.0), ("a", "n", 2021.0, 3.0, 2.0), ("b", "n", 2021.0, 1.0, 2.0), ("b", "m", 2021.0, 1.0, 4.0), ("c", "n", 2021.0, -1.0, 2.0), ("c", "n", 2020.0, 1.0, 0.0)]
    got = {r.code: (r.status, r.ratio, r.over_design) for r in master.latest_capacity(spark.createDataFrame(rows, "code string, name string, year double, load double, capacity double")).collect()}
    assert got == {"a": ("valid", 1.5, True), "b": ("conflicting_latest_records", None, False), "c": ("no_valid_capacity_record", None, False)}


def test_runs_and_windows_break_at_gaps(spark):
    import datetime as dt

    wet = [1, 1, 1, None, 1, 1, 1, 1, 1, 0, 0]
    rows = [("p", dt.date(2024, 1, 1) + dt.timedelta(k), None if v is None else float(v) * 5, v is not None) for k, v in enumerate(wet)]
    [r] = series.annual(spark.createDataFrame(rows, "place string, date date, mm double, complete boolean")).collect()
    assert (r.cwd, r.cdd, r.rx5, r.rx1, r.sdii, r.complete_days) == (5, 2, 25.0, 5.0, 5.0, 10)


def test_tail_fit_against_a_grid():
    rng = np.random.default_rng(3)
    for x in (np.linspace(241, 2000, 40), 240 + rng.pareto(1.2, 200) * 100, 240 + rng.exponential(300, 60), np.repeat([250.0, 400.0], 8)):
        (b,), (l,), (v,) = tailfit.fit_many(x, np.ones((1, len(x))), 240.0)
        assert 0.01 <= b <= 2 and -50 <= l <= 20
        beta, rate = np.meshgrid(np.geomspace(0.01, 2, 120), np.linspace(-50, 20, 1401), indexing="ij")
        u = np.log(240.0)
        with np.errstate(over="ignore"):
            best = len(x) * (np.log(beta) + beta * rate) + (beta - 1) * np.log(x).sum() - sum(np.exp(beta * (rate + t)) - np.exp(beta * (rate + u)) for t in np.log(x))
        assert v >= np.nanmax(best) - 1e-6


def test_fit_statuses_and_bootstrap_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [("a", "none", 10.0)] + [("a", "few", 300.0 + k) for k in range(9)] + [("a", "some", 300.0 + k) for k in range(12)] + [("a", "many", float(v)) for v in 240 + rng.exponential(400, 80)]
    frame = spark.createDataFrame(rows, "company string, permit_number string, duration_minutes double")
    one = {r.permit_number: r for r in tailfit.fits(frame, replicates=60).collect()}
    two = {r.permit_number: r for r in tailfit.fits(frame.orderBy(F.rand(1)).repartition(7), replicates=60).collect()}
    assert {k: r.status for k, r in one.items()} == {"none": "no_tail_events", "few": "too_few_tail_events", "some": "fitted_too_few_for_bootstrap", "many": "completed"}
    assert one["many"] == two["many"] and one["many"].ci_low <= one["many"].beta <= one["many"].ci_high


def test_polygons_with_hole_edge_and_vertex(spark):
    def ring(points):
        return [(*a, *b) for a, b in zip(points, points[1:] + points[:1], strict=True)]

    edges = [("p", "a", *e) for e in ring([(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]) + ring([(50.0, 50.0), (100.0, 50.0), (100.0, 100.0), (50.0, 100.0)])]
    edges += [("q", "a", *e) for e in ring([(300.0, 0.0), (400.0, 0.0), (400.0, 100.0), (350.0, 20.0), (300.0, 100.0)])] + [("r", "b", *e) for e in ring([(0.0, 300.0), (10.0, 300.0), (10.0, 310.0)])]
    frame = spark.createDataFrame(edges, "polygon string, company string, x1 double, y1 double, x2 double, y2 double")
    points = {"in": (150.0, 150.0), "hole": (75.0, 75.0), "edge": (0.0, 100.0), "vertex": (200.0, 200.0), "notch": (350.0, 60.0), "leg": (310.0, 60.0), "other": (8.0, 304.0), "out": (900.0, 900.0)}
    s = spark.createDataFrame([(k, "a", *v) for k, v in points.items()], "sensor string, company string, x double, y double")
    got = {r.sensor: (r.kind, r.polygon) for r in spatial.linked(s, frame, 64.0).collect()}
    assert got == {"in": ("within", "p"), "leg": ("within", "q"), "edge": ("boundary", "p"), "vertex": ("boundary", "p"), "other": ("other_company", "r")}
    near = {r.sensor: (r.polygon, round(r.distance, 6)) for r in spatial.nearest_polygon(s, frame).collect()}
    assert near["hole"] == ("p", 25.0) and near["edge"] == ("p", 0.0)


def test_grid_golden_case(spark):
    assert spatial.clip_area(np.array([(500.0, 500.0), (1500.0, 500.0), (1500.0, 1500.0), (500.0, 1500.0)]), 0, 1000, 1000, 2000) == 250_000
    rings = spark.createDataFrame([("p", [500.0, 1500.0, 1500.0, 500.0], [500.0, 500.0, 1500.0, 1500.0], False)], "polygon string, xs array<double>, ys array<double>, hole boolean")
    cells = spatial.grid_overlap(rings, (0.0, 2000.0), 1000.0).collect()
    assert {(r.row, r.col): r.area for r in cells} == {(i, j): 250_000.0 for i in (0, 1) for j in (0, 1)}
    valid = spark.createDataFrame([(1.0,), (-1.0,), (1e20,), (float("nan"),)], "v double").select(spatial.valid_cell(F.col("v")).alias("ok")).collect()
    assert [r.ok for r in valid] == [True, False, False, False]


def test_projection_of_a_known_point(spark):
    [r] = spark.createDataFrame([(651409.903, 313177.270)], "e double, n double").select(spatial.to_degrees(F.col("e"), F.col("n")).alias("w")).collect()
    assert r.w.lat == pytest.approx(52.6579786, abs=2e-4) and r.w.lon == pytest.approx(1.7160519, abs=2e-4)


def test_complete_linkage_radius():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 100_000, (120, 2))
    labels = spatial.complete_linkage(x, 25_000.0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    groups = [np.flatnonzero(labels == k) for k in np.unique(labels)]
    assert all(d[np.ix_(g, g)].max() <= 25_000 for g in groups)
    assert all(d[np.ix_(g, h)].max() > 25_000 for g, h in itertools.combinations(groups, 2))


def test_assignment_of_shared_codes(spark):
    sensors = spark.createDataFrame([("one", True), ("two", True), ("no", False), ("far", True)], "sensor string, eligible boolean")
    relations = spark.createDataFrame([("one", "within", "a", "U1", 1), ("two", "within", "b", "U1", 1), ("two", "within", "a", "U1", 1), ("no", "within", "a", "U1", 1)], "sensor string, kind string, polygon string, code string, n_codes int")
    got = {r.sensor: (r.status, r.polygons, r.code, r.review) for r in master.assignment_status(sensors, relations).collect()}
    assert got["one"] == ("unique_same_company_containment", "a", "U1", False) and got["two"] == ("multiple_same_uwwcode", "a|b", "U1", False)
    assert got["no"][0] == "not_eligible_for_catchment_matching" and got["far"] == ("no_catchment_match", "", "", True)


def test_hc3_against_matrix_form(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=60), rng.normal(size=60)
    y = y + 0.5 * x
    [r] = regress.simple(spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double"), ["g"]).collect()
    m = np.column_stack([np.ones(60), x])
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ y
    e, h = y - m @ b, np.einsum("ij,jk,ik->i", m, inv, m)
    se = np.sqrt((inv @ (m.T * (e / (1 - h)) ** 2 @ m) @ inv)[1, 1])
    assert (r.slope, r.se) == (pytest.approx(b[1], abs=1e-12), pytest.approx(se, abs=1e-12)) and r.p == pytest.approx(math.erfc(abs(b[1] / se) / 2**0.5), abs=1e-12)
    bad = spark.createDataFrame([("c", 1.0, 2.0)] * 5 + [("n", 1.0, 2.0)], "g string, x double, y double")
    assert {r.g: r.status for r in regress.simple(bad, ["g"]).collect()} == {"c": "constant_predictor", "n": "too_few_rows"}


def test_linear_models_meet_their_conditions(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, 0.0, -0.5] + rng.normal(size=80) * 0.1
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    ready = models.prepare(frame, ["a", "b", "c"])
    g = models.grams(frame, ready, F.col("y"))[None]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    centred = y - y.mean()
    ridge = models.solve(g, "ridge", 3.0)
    assert np.allclose(z.T @ (centred - z @ ridge.weights), 3.0 * ridge.weights)
    ols = models.solve(g, "ols")
    assert ols.sse(g) == pytest.approx(((centred - z @ np.linalg.lstsq(z, centred, rcond=None)[0]) ** 2).sum())
    net = models.solve(g, "elastic", 0.1, 0.5)
    grad = z.T @ (centred - z @ net.weights) / 80 - 0.05 * net.weights
    assert np.allclose(grad[net.weights != 0], 0.05 * np.sign(net.weights[net.weights != 0]), atol=1e-6) and (np.abs(grad[net.weights == 0]) <= 0.05 + 1e-9).all()
    assert models.leakage(["rain", "fitted_beta", "spill_rate"]) == ["fitted_beta", "spill_rate"]


def test_split_is_disjoint_and_covers(spark):
    frame = spark.range(400).withColumn("g", F.col("id") % 4).withColumn("split", models.split_of(F.col("id"), F.col("g")))
    counts = {(r.g, r.split): r["count"] for r in frame.groupBy("g", "split").count().collect()}
    assert counts == {(g, s): n for g in range(4) for s, n in (("TEST", 15), ("VALIDATION", 15), ("TRAIN", 70))}


def test_gates(spark):
    frame = spark.createDataFrame([(1, 5.0), (1, 150.0), (None, None)], "k int, pct double")
    got = {r.gate: r.violations for r in gates.violations(frame, gates.percent("pct") | {"has key": F.col("k").isNotNull()}).collect()}
    assert got == {"pct in 0..100": 1, "has key": 1}
    assert gates.messages(gates.uniqueness(frame, "unique k", "k")) == ["unique k: 2 violations"]
    with pytest.raises(ValueError, match="unique k"):
        gates.demand(gates.uniqueness(frame, "unique k", "k"))
    assert gates.unchanged(frame, frame, ["pct"]).first().passed and not gates.unchanged(frame, frame.limit(1), ["pct"]).first().passed


def test_override(spark):
    selection = spark.createDataFrame([("a", "1", "s1"), ("a", "2", None), ("a", "3", "s3")], "company string, code string, sensor string")
    decisions = spark.createDataFrame([("a", "1", "none", None), ("a", "2", "select", "s9"), ("a", "3", "accept", None)], "company string, code string, action string, chosen string")
    assert {r.code: (r.final, r.overridden) for r in joins.override(selection, decisions).collect()} == {"1": (None, True), "2": ("s9", True), "3": ("s3", False)}
    with pytest.raises(ValueError, match="several"):
        joins.override(selection, decisions.union(decisions))


def test_resampled_gain_uses_every_row(spark):
    rng = np.random.default_rng(3)
    y = np.sort(rng.integers(1, 51, 30_000)).astype(float)
    p, b = y * 0.6 + rng.integers(0, 23, len(y)), np.full(len(y), 25.0)
    frame = spark.createDataFrame([*zip(y.tolist(), p.tolist(), b.tolist(), strict=True), (None, 1.0, 1.0)], "y double, predicted double, base double")
    got = models.resampled_gain(frame.repartition(5), "y", "predicted", "base", 400)
    assert np.allclose(got, models.bootstrap_gain(y, p, b, 400), atol=0.4)
    assert np.allclose(got, models.resampled_gain(frame.repartition(2), "y", "predicted", "base", 400), atol=1e-9)


def test_bootstrap_gain_query_covers_the_whole_table(spark):
    from eventide.plans.catalog import QUERIES

    at = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{at}/lineitem.parquet").where("l_linenumber % 4 = 1").selectExpr("double(l_quantity) y", "double(l_partkey % 23) k").toPandas()
    y = rows.y.to_numpy()
    want = models.bootstrap_gain(y, y * 0.6 + rows.k.to_numpy(), np.full(len(y), 25.0), 100)
    got = QUERIES["F29_bootstrap_gain"](spark, at).first()
    assert len(y) == 170_951 and np.allclose(got, want, atol=0.15)


def test_fuzzy_candidates_score_each_pair_of_texts_once(spark, monkeypatch):
    """The query against all pairs scored plainly; texts are dealt over tasks before they are scored, and windows that can't be the best aren't compared."""
    from eventide.plans.catalog import QUERIES

    sf, least = "/root/testdata/sf0.001", {}
    frame = QUERIES["J14_fuzzy_candidates"](spark, sf)
    assert "REPARTITION_BY_NUM" in frame._jdf.queryExecution().toString()
    own = QUERIES["C13_C14_C15_C16_place_names"](spark, sf).where("core <> ''").collect()
    for s, w in itertools.product(own, own):
        if s.p_partkey // 50 == w.p_partkey // 50 and s.p_partkey % 3 and not w.p_partkey % 3:
            of = lambda a, b: 100.0 if a == b else 0.4 * 100 * (1 - _edits(a, b) / max(len(a), len(b))) + 0.35 * N.token_set_score(a, b) + 0.25 * N.weighted_score(a, b)
            least[s.p_partkey, w.p_partkey] = max(of(a, b) for a in {s.core, s.f} for b in {w.core, w.f})
    got = {(r.sensor, r.works): r for r in frame.collect()}
    for s in {k for k, _ in least}:
        mine = sorted((v for (k, _), v in least.items() if k == s), reverse=True)
        assert {k for k in got if k[0] == s} == {k for k, v in least.items() if k[0] == s and v >= mine[:5][-1] - 1e-6}
    assert all(r.score == pytest.approx(least[k], abs=1e-6) for k, r in got.items())

    compared = []
    plain = N._indel
    monkeypatch.setattr(N, "_indel", lambda a, b: compared.append(b) or plain(a, b))
    best = N.weighted_score("COLD PLATE", "WARM BOLTS SEWAGE TREATMENT WORKS NO 2")
    assert len(compared) < 40  # 142 before
    short, long = "COLD PLATE", "WARM BOLTS SEWAGE TREATMENT WORKS NO 2"
    assert N._partial(short, long) == max(plain(short, long[max(0, k) : k + 10]) for k in range(-9, len(long))) and best > 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]
