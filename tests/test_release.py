"""Release tables refuse what they must, and models agree with plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import gates, joins, models, regress, release, spatial, tailfit


def test_population_and_audit_refuse(spark):
    part = lambda company, *keys: spark.createDataFrame([(company, k, 1) for k in keys], "company string, permit_number string, n int")
    assert release.sensor_population({"a": part(" a", "1", " 2 "), "b": part("b", "1")}).count() == 3
    for bad in ({"a": part("a", "1"), "b": part("a", "2")}, {"a": part("a", "1", " 1")}, {"a": part("a", " ")}, {"a": part("a", "1"), "b": part("b")}, {"a": part("a", "1"), "b": part("b", "1").select("permit_number", "company", "n")}):
        with pytest.raises(ValueError):
            release.sensor_population(bad).count()
    rows = spark.createDataFrame([("a", "1"), ("a", " 1 "), ("a", None)], "company string, key string")
    with pytest.raises(ValueError, match="more than once"):
        release.coordinate_audit(rows, "key")
    assert release.coordinate_audit(rows.limit(1), "key").columns == ["company", "permit_number"]


def test_master_cross_check(spark):
    fit = "1.0 as beta, 0.9 as ci_low, 1.1 as ci_high, 0.2 as ci_width, 1.0 as success_rate, 0.0 as hit_rate, true as fitted, true as bootstrapped, 5 as tail_count, 9 as total_count"
    population = spark.sql(f"select 'a' as company, '1' as permit_number, '' as location_name, {fit}")
    audit = spark.sql("select 'a' as company, '1' as permit_number, 'exact' as match, false as conflict, true as coordinate_valid, 1e5 as x, 2e5 as y, 'from json' as json_location_name, true as strict")
    [row] = release.sensor_master(population, audit, ("exact",)).collect()
    assert (row.sensor_uid, row.location_name, row.beta_quality, row.issue_type) == ("a::1", "from json", "strict_quality_beta", "")
    with pytest.raises(ValueError, match="strict"):
        release.sensor_master(population, audit.withColumn("strict", F.lit(False)), ("exact",))
    [row] = release.sensor_master(population, audit.limit(0), ("exact",)).collect()
    assert row.location_name == "" and not row.eligible_for_beta


def test_manual_lines_one_by_one(spark):
    works = spark.createDataFrame([("W1", "a"), ("W2", "a"), ("W3", "a"), ("W4", "a"), ("W5", "a"), ("W5", "a")], "code string, company string")
    sensors = spark.createDataFrame([("S1", "a", 0.0, 0.0), ("S2", "a", 3.0, 4.0), ("S3", "b", 0.0, 0.0), ("S4", "a", None, 0.0), ("S5", "a", 3.0, 4.0), ("S6", "a", 1.0, 1.0)], "sensor string, company string, x double, y double")
    base = spark.createDataFrame([("W1", "a", 6.0, 8.0, None), ("W2", "a", None, 0.0, None), ("W3", "a", 0.0, 0.0, "S6"), ("W4", "a", 0.0, 0.0, None), ("W5", "a", 0.0, 0.0, None)], "code string, company string, works_x double, works_y double, sensor string")
    def one(code, ids, parsed=True):
        lines = spark.createDataFrame([(1, code, ids, parsed)], "line_no int, code string, ids array<string>, parsed boolean")
        [r] = release.validate_manual(lines, works, sensors, base).collect()
        return r
    r = one("W1", ["S5", "S1", "S2"])
    assert (r.status, r.chosen, r.alternatives, r.distance, r.method) == ("valid_manual_assignment", "S2", "S5 | S1", 5.0, "nearest_of_manually_approved_candidates_outcome_blind")
    assert one("W1", ["S1"]).method == "explicit_manual_single_sensor"
    for code, ids, status in (("W9", ["S1"], "manual_wwtw_not_exactly_once"), ("W5", ["S1"], "manual_wwtw_not_exactly_once"), ("W1", ["S9"], "manual_sensor_not_exactly_once:S9"), ("W1", ["S3"], "manual_company_conflict:S3"), ("W1", ["S6"], "manual_sensor_selected_for_other_wwtw:S6:W3"), ("W2", ["S1"], "manual_wwtw_geometry_missing"), ("W1", ["S4"], "manual_sensor_geometry_missing"), ("W1", ["S1", "S1"], "duplicate_manual_sensor_record")):
        r = one(code, ids)
        assert r.status == status and r.chosen is None, (r.status, status)
    assert one("W1", ["S9", "S8"], False).notes == "manual_parse_error; manual_sensor_not_exactly_once:S9; manual_sensor_not_exactly_once:S8"
    with pytest.raises(ValueError, match="outcomes"):
        release.validate_manual(spark.createDataFrame([(1, "W1", ["S1"], True)], "line_no int, code string, ids array<string>, parsed boolean"), works, sensors.withColumn("fitted_beta", F.lit(1.0)), base)
    with pytest.raises(ValueError, match="final sensors"):
        release.frozen(base.withColumn("sensor", F.lit("S1")), spark.createDataFrame([], "code string, chosen string"))


def test_gates_that_refuse(spark):
    a = spark.createDataFrame([("a", "1", 1.0)], "company string, code string, x double")
    with pytest.raises(ValueError, match="different works"):
        release.works_universe(a, a.withColumn("code", F.lit("2")))
    with pytest.raises(ValueError, match="unknown companies"):
        release.sensor_scope(spark.createDataFrame([("s", "z")], "sensor string, company string"), a)
    with pytest.raises(ValueError, match="valid coordinates"):
        release.sensor_points(spark.createDataFrame([("s", "a", None, 1.0, True)], "sensor string, company string, x double, y double, eligible boolean"))
    kinds = spark.createDataFrame([("x", None)], "a string, b string")
    lookup = spark.createDataFrame([("x", None, "t", True)], "a string, b string, target string, approved boolean")
    assert release.category_lookup(kinds, lookup, ["a", "b"], "target", ["t"]).first().target == "t"
    for bad in (lookup.withColumn("approved", F.lit(False)), lookup.withColumn("b", F.lit("y")), lookup.union(lookup)):
        with pytest.raises(ValueError):
            release.category_lookup(kinds, bad, ["a", "b"], "target", ["t"])
    with pytest.raises(ValueError, match="geometries"):
        spatial.consistent_geometry(spark.createDataFrame([("p", 1.0), ("p", 2.0)], "k string, x double"), "k", ["x"])
    with pytest.raises(ValueError, match="on the grid"):
        spatial.union_area(spark.createDataFrame([("p", 0.0, 0.0, 1.5, 1.0)], "k string, x0 double, y0 double, x1 double, y1 double"), "k", 1.0)
    with pytest.raises(ValueError, match="violations"):
        gates.demand(gates.unchanged(a, a.withColumn("x", F.lit(2.0)), ["x"]))
    more = spark.createDataFrame([("a", "1", 2.0)], "company string, code string, y double")
    assert release.joined_master(a.withColumn("old_x", F.lit(1)), more, ["company", "code"], ("old_",)).columns == ["company", "code", "x", "y"]
    with pytest.raises(ValueError, match="duplicate"):
        release.joined_master(a, more.union(more), ["company", "code"], ("old_",))


def test_the_single_case_that_was_once_missed(spark):
    """A works with two accepted sensors takes the nearer one, whatever their names score; it alone is assigned."""
    pairs = spark.createDataFrame([("a", "U1", "near", 100.0, 0.0, 0.0, 0.0, None, False, 86.0, 1.0), ("a", "U1", "far", 900.0, 0.0, 0.0, 0.0, None, True, 100.0, 9.0)], "company string, code string, sensor string, x double, y double, works_x double, works_y double, audited double, exact boolean, score double, margin double")
    universe = spark.createDataFrame([("a", "U1", True)], "company string, code string, works_ok boolean")
    ranked = joins.candidate_distances(pairs)
    final = joins.primary(universe, ranked)
    [row] = final.collect()
    assert (row.sensor, row.status) == ("near", "selected_nearest_of_multiple_within_1000m")
    audit = release.candidate_audit(ranked, joins.review(final))
    assert {r.sensor: r.selected_as_primary for r in audit.collect()} == {"near": True, "far": False}
    assert release.primary_gates(universe, final, audit).where("not passed").isEmpty()


def test_global_numbers_and_ranks(spark):
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 5, 400), rng.normal(size=400), np.zeros(50)):
        rows = [(float(v) if k % 9 else None, k) for k, v in enumerate(values)]
        frame = spark.createDataFrame(rows, "v double, k int").repartition(3)
        got = [r.k for r in joins.numbered(frame, F.col("v"), ["k"], "n").orderBy("n").collect()]
        assert got == [k for v, k in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
        ranks = {r.k: r.r for r in regress.average_rank(frame, [], "v", "r").collect()}
        some = [v for v, _ in rows if v is not None]
        for v, k in rows:
            assert ranks[k] is None if v is None else ranks[k] == sum(x < v for x in some) + (sum(x == v for x in some) + 1) / 2
    assert joins.numbered(frame.limit(0), F.col("v"), [], "n").count() == 0


def test_nearest_works_and_polygons_by_search(spark):
    rng = np.random.default_rng(1)
    s = [(f"s{k}", "ab"[k % 2], *map(float, rng.uniform(0, 1000, 2))) for k in range(120)]
    w = [(f"w{k}", "ab"[k % 3 % 2], *map(float, rng.uniform(0, 1000, 2))) for k in range(25)]
    got = {r.sensor: (r.works, round(r.distance, 6)) for r in joins.nearest(spark.createDataFrame(s, "sensor string, c string, x double, y double"), spark.createDataFrame(w, "works string, c string, works_x double, works_y double"), "c", 150.0).collect()}
    want = {}
    for name, c, x, y in s:
        d, best = min((float(np.hypot(x - u, y - v)), n) for n, k, u, v in w if k == c)
        if d <= 150:
            want[name] = (best, round(d, 6))
    assert got == want
    edges, boxes = [], []
    for k in range(15):
        x, y, d = *rng.uniform(0, 900, 2), float(rng.uniform(5, 60))
        c = "ab"[k % 2]
        corners = [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
        edges += [(f"p{k}", c, *map(float, (*corners[j], *corners[(j + 1) % 4]))) for j in range(4)]
    got = {r.sensor: (r.polygon, round(r.distance, 6)) for r in spatial.nearest_polygon(spark.createDataFrame(s, "sensor string, company string, x double, y double"), spark.createDataFrame(edges, "polygon string, company string, x1 double, y1 double, x2 double, y2 double"), cell=10.0).collect()}

    def away(x, y, x1, y1, x2, y2):
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return float(np.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))

    for name, c, x, y in s:
        d, best = min((round(away(x, y, *e[2:]), 6), e[0]) for e in edges if e[1] == c)
        assert got[name] == (best, d)


def test_small_counts_bytes(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "x" * 1000)] * 20, "k int, t string")
    assert "broadcast" in joins.small(frame)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10_000)
    assert "broadcast" not in joins.small(frame)._jdf.queryExecution().logical().toString().lower()


def test_clusters_by_plain_complete_linkage():
    rng = np.random.default_rng(2)
    for _ in range(5):
        x = rng.uniform(0, 100, (40, 2))
        got = spatial.complete_linkage(x, 30.0)
        groups = [[k] for k in range(40)]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        while True:
            height, a, b = min((d[np.ix_(p, q)].max(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
            if height > 30:
                break
            groups[a] += groups.pop(b)
        assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == {frozenset(g) for g in groups}


def test_overlay_with_holes_and_odd_shapes(spark):
    units = spark.createDataFrame([("u", [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0], False), ("u", [2.0, 4.0, 4.0, 2.0], [2.0, 2.0, 4.0, 4.0], True), ("l", [20.0, 26.0, 26.0, 23.0, 23.0, 20.0], [0.0, 0.0, 3.0, 3.0, 6.0, 6.0], False)], "polygon string, xs array<double>, ys array<double>, hole boolean")
    zones = spark.createDataFrame([("z", [0.0, 5.0, 0.0], [0.0, 0.0, 5.0], False), ("y", [22.0, 22.0, 30.0, 30.0], [1.0, 9.0, 9.0, 1.0], False)], "polygon string, xs array<double>, ys array<double>, hole boolean")
    for cell in (1.5, 7.0, 1000.0):
        got = {(r.unit, r.zone): r.area for r in spatial.overlay(units, zones, cell).collect()}
        # the hole takes the triangle (2,2), (3,2), (2,3) from the zone's 12.5
        assert got == {("u", "z"): pytest.approx(12.0), ("l", "y"): pytest.approx(11.0)}


def test_random_intercept_against_the_dense_likelihood(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 12, 150)
    x = rng.normal(size=150)
    y = 1 + 0.5 * x + rng.normal(size=12)[g] * 0.8 + rng.normal(size=150) * 0.5
    frame = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, g, strict=True)], "x double, y double, g int")
    ready = models.prepare(frame, ["x"])
    got = models.random_intercept(frame, ready, F.col("y"), F.col("g"))
    z = np.column_stack([np.ones(150), (x - x.mean()) / x.std()])

    def likelihood(t):
        v = np.eye(150) + t * (g[:, None] == g[None, :])
        inverse = np.linalg.inv(v)
        w = np.linalg.solve(z.T @ inverse @ z, z.T @ inverse @ y)
        r = y - z @ w
        s = r @ inverse @ r / 150
        return -0.5 * (150 * np.log(2 * np.pi * s) + np.linalg.slogdet(v)[1] + 150), w, s

    ts = np.exp(np.linspace(-5, 4, 2000))
    best = max(ts, key=lambda t: likelihood(t)[0])
    value, w, s = likelihood(best)
    assert got["log_likelihood"] == pytest.approx(value, abs=1e-4) and got["x"] == pytest.approx(w[1], abs=1e-3) and got["residual_variance"] == pytest.approx(s, rel=1e-2) and got["singular"] == 0.0
    plain = spark.createDataFrame([(float(a), float(2 * a + e), int(k % 5)) for k, (a, e) in enumerate(zip(x, rng.normal(size=150), strict=True))], "x double, y double, g int")
    flat = models.random_intercept(plain, models.prepare(plain, ["x"]), F.col("y"), F.col("g"))
    assert flat["icc"] < 0.1 and abs(flat["residual_variance"] - 1) < 0.4


def test_permutation_split(spark):
    frame = spark.range(20).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in models.permutation_split(frame, ["k"], 7).collect()}
    order = np.random.default_rng(7).permutation(20)
    assert [got[k] for k in order] == ["TRAIN"] * 14 + ["VALIDATION"] * 3 + ["TEST"] * 3
    with pytest.raises(ValueError, match="12 rows"):
        models.permutation_split(frame.limit(5), ["k"])
    n = models.hashed_split(spark.range(1000).withColumnRenamed("id", "k"), "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in n} == {"TEST": 150, "VALIDATION": 150, "TRAIN": 700}


def test_fits_by_multiplicity(spark):
    """Equal durations counted once give the fit of all events; sources without enough have their default row."""
    rng = np.random.default_rng(5)
    x = np.round(241 + rng.exponential(300, 60) / 30) * 1.0
    (a,), (b,), (c,) = tailfit.fit_many(np.sort(x), np.ones((1, 60)), 240.0)
    rows = [("a", "1", float(v)) for v in x] + [("a", "2", 300.0)] * 9 + [("a", "3", 100.0), ("a", "4", None)]
    got = {r.permit_number: r for r in tailfit.fits(spark.createDataFrame(rows, "company string, permit_number string, duration_minutes double"), replicates=50).collect()}
    r = got["1"]
    assert (r.n_tail, r.status) == (60, "completed") and r.beta == pytest.approx(a, abs=1e-6) and r.log_likelihood == pytest.approx(c, abs=1e-6) and r.ci_low <= r.ci_high
    empty = ("beta", "log_rate", "log_likelihood", "replicates", "ci_low", "ci_high", "ci_width", "beta_sd", "success_rate", "hit_rate", "stability")
    for permit, n, status in (("2", 9, "too_few_tail_events"), ("3", 0, "no_tail_events"), ("4", 0, "no_tail_events")):
        r = got[permit]
        assert (r.n_tail, r.status, r.at_bound) == (n, status, False) and all(r[c] is None for c in empty)


def test_bootstrap_fits_share_their_grid():
    """A thousand replicates of twenty sources (over seven seconds before) find the maxima that a fine search finds, clipped rates and bounds among them."""
    import time

    rng = np.random.default_rng(8)
    x = np.sort(240 + rng.exponential(600, 60))
    began = time.process_time()
    for k in range(20):
        row = tailfit._one("a", str(k), x, np.ones(60, int), 240.0, 1000, 42)
        assert row["status"] == "completed" and row["ci_low"] < row["beta"] < row["ci_high"]
    assert time.process_time() - began < 4
    for x in (x, 240 * np.exp(rng.exponential(8, 50)), 240 + rng.weibull(3, 50) * 30, 240 + rng.uniform(1e-4, 1e-2, 30)):
        draws = rng.multinomial(len(x), np.ones(len(x)) / len(x), size=40).astype(float)
        beta, _, value = tailfit.fit_many(x, draws, 240.0)
        for b in np.concatenate([np.geomspace(0.01, 2, 300), *(np.clip(beta * (1 + d), 0.01, 2) for d in (-1e-3, -1e-5, 1e-5, 1e-3))]).reshape(-1, 1):
            assert (tailfit._profile(np.full(40, b[0]), np.log(x), draws, np.log(240.0))[0] <= value + 1e-8 * np.abs(value)).all()


def test_distances_are_dealt_over_tasks(spark, monkeypatch):
    """All pairs of a group, by a broadcast and by parts alike; rounding is Spark's own, ties and large numbers among them."""
    from eventide.plans.catalog import QUERIES

    assert "REPARTITION_BY_NUM" in QUERIES["F10_distances"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    sensors = spark.createDataFrame([(f"s{k}", "ab"[k % 2] if k else None, float(k * 37 % 101), float(k)) for k in range(40)] + [("none", "a", None, 1.0)], "sensor string, company string, x double, y double")
    works = spark.createDataFrame([(f"w{k}", "abc"[k % 3], float(k * 17 % 89), float(-k)) for k in range(30)], "works string, company string, works_x double, works_y double")
    want = sorted((s.sensor, w.works, None if s.x is None else round(float(np.hypot(s.x - w.works_x, s.y - w.works_y)), 3)) for s in sensors.collect() for w in works.collect() if s.company == w.company)
    assert sorted(map(tuple, joins.distances(sensors, works, "company", 3).collect())) == want
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    assert sorted(map(tuple, joins.distances(sensors, works, "company", 3).collect())) == want
    numbers = [(float(v),) for v in (0.0, 0.0005, 0.0015, 2.5005, 1.0005, 1e6 + 0.0005, 4e6, 1e12, 1e300, -1.0005, "nan", "inf", *np.random.default_rng(1).uniform(0, 2e6, 5000))] + [(k / 2000,) for k in range(4000)] + [(None,)]
    for r in spark.createDataFrame(numbers, "v double").select("v", F.round("v", 3).alias("a"), joins.rounded_half_up(F.col("v"), 3).alias("b")).collect():
        assert r.a == r.b or (r.a != r.a and r.b != r.b), r


def test_overlay_of_rectangles_without_python(spark):
    """Rectangles, whatever corner they begin at, holes and other rings give what clipping gives; where all are rectangles nothing reaches Python."""
    from eventide.plans.catalog import QUERIES

    assert "Python" not in (plan := QUERIES["J15_overlay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()) and "MapInPandas" not in plan
    rng, rings = np.random.default_rng(4), {"u": [], "z": []}
    for k in range(60):
        x0, y0, w, h = rng.uniform(0, 40, 4)
        xs, ys = np.array([x0, x0 + w, x0 + w, x0]), np.array([y0, y0, y0 + h, y0 + h])
        for name in rings:
            turn = slice(None, None, -1) if rng.random() < 0.5 else slice(None)
            a, b = (np.roll(c, int(k))[turn] + rng.integers(0, 9) for c in (xs, ys))
            if k % 7 == 3:  # a triangle, or a rectangle that a closing point ends
                a, b = (a[:3], b[:3]) if k % 2 else (np.append(a, a[0]), np.append(b, b[0]))
            rings[name].append((f"{name}{k // 2 if name == 'u' else k}", a.tolist(), b.tolist(), name == "u" and k % 8 == 1))
    schema, want = "polygon string, xs array<double>, ys array<double>, hole boolean", {}
    for u, xs, ys, hole in rings["u"]:
        for z, zx, zy, _ in rings["z"]:
            want[u, z] = want.get((u, z), 0.0) + (-1 if hole else 1) * spatial.clip_convex(np.column_stack([xs, ys]), np.column_stack([zx, zy]))
    frames = [spark.createDataFrame(rings[n], schema) for n in ("u", "z")]
    for cell in (7.0, 1000.0):
        rows = spatial.overlay(*frames, cell).collect()
        assert len({(r.unit, r.zone) for r in rows}) == len(rows)
        got = {(r.unit, r.zone): r.area for r in rows}
        assert {k for k, v in want.items() if v > 1e-9} == {k for k, v in got.items() if v > 1e-9} and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items() if v > 1e-9)
