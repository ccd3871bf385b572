"""Queries on space: containment, boundaries, nearest polygons, grids, shares, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, joins, master, regress, spatial
from .adapters import view
from .registry import query, rounded

CELL = 50_000.0


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _edges(spark, sf):
    """The squares' four edges."""
    s = view(spark, sf, "squares")
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("side"), F.col("y0") + F.col("side")
    corners = ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))
    e = F.explode(F.array(*(F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")) for a, b, c, d in corners)))
    return s.select("polygon", "company", e.alias("e")).select("polygon", "company", "e.*")


def _points(spark, sf):
    """Sensors, of which every seventh is moved to a corner or an edge of a square of its company."""
    corner = view(spark, sf, "squares").groupBy("company").agg(F.min_by(F.struct("x0", "y0", "side"), "polygon").alias("q"))
    own = view(spark, sf, "sensors").join(joins.small(corner), "company", "left")
    k = F.col("c_custkey") % 14
    x = F.when(F.col("q").isNotNull() & (k == 0), F.col("q.x0")).when(F.col("q").isNotNull() & (k == 7), F.col("q.x0") + F.col("q.side") / 2).otherwise(F.col("x"))
    y = F.when(F.col("q").isNotNull() & k.isin(0, 7), F.col("q.y0")).otherwise(F.col("y"))
    return own.select("sensor", "company", x.alias("x"), y.alias("y"))


_POINTS = """(SELECT sensor, s.company, CASE WHEN q.polygon IS NOT NULL AND c_custkey % 14 = 0 THEN q.x0 WHEN q.polygon IS NOT NULL AND c_custkey % 14 = 7 THEN q.x0 + q.side / 2 ELSE x END AS x, CASE WHEN q.polygon IS NOT NULL AND c_custkey % 14 IN (0, 7) THEN q.y0 ELSE y END AS y
 FROM sensors s LEFT JOIN (SELECT company, arg_min(x0, polygon) AS x0, arg_min(y0, polygon) AS y0, arg_min(side, polygon) AS side, min(polygon) AS polygon FROM squares GROUP BY 1) q ON s.company = q.company)"""
_INSIDE = "p.x > q.x0 AND p.x < q.x0 + q.side AND p.y > q.y0 AND p.y < q.y0 + q.side"
_CLOSED = "p.x >= q.x0 AND p.x <= q.x0 + q.side AND p.y >= q.y0 AND p.y <= q.y0 + q.side"
_LINKED = f"""WITH p AS MATERIALIZED {_POINTS}, w AS (SELECT sensor, polygon FROM p JOIN squares q ON p.company = q.company AND {_INSIDE}),
b AS (SELECT sensor, polygon FROM p JOIN squares q ON p.company = q.company AND {_CLOSED} WHERE sensor NOT IN (SELECT sensor FROM w)),
o AS (SELECT sensor, polygon FROM p JOIN squares q ON p.company <> q.company AND {_INSIDE} WHERE sensor NOT IN (SELECT sensor FROM w) AND sensor NOT IN (SELECT sensor FROM b)),
r AS (SELECT sensor, 'within' AS kind, polygon FROM w UNION ALL SELECT sensor, 'boundary', polygon FROM b UNION ALL SELECT sensor, 'other_company', polygon FROM o)
"""


@query("J10_J11_J12_point_in_polygon", _LINKED + "SELECT * FROM r")
def _(spark, sf):
    return spatial.linked(_points(spark, sf), _edges(spark, sf), CELL)


@query("F7_assignment_status", _LINKED + """, c AS (SELECT r.*, CASE WHEN CAST(substr(polygon, 2) AS INTEGER) % 5 <> 0 THEN 'U' || (CAST(substr(polygon, 2) AS INTEGER) % 4) END AS code FROM r),
a AS (SELECT sensor, kind, string_agg(DISTINCT polygon, '|' ORDER BY polygon) AS polygons, count(DISTINCT polygon) AS n, coalesce(string_agg(DISTINCT code, '|' ORDER BY code), '') AS codes, count(DISTINCT code) AS code_n, min(CASE WHEN code IS NULL THEN 0 ELSE 1 END) = 1 AS each FROM c GROUP BY 1, 2),
s AS (SELECT p.sensor, a.*, length(p.sensor) % 5 <> 2 AS eligible FROM p LEFT JOIN a ON p.sensor = a.sensor)
SELECT p.sensor, status, coalesce(polygons, '') AS polygons, CASE WHEN status IN ('unique_same_company_containment', 'multiple_same_uwwcode') AND kind = 'within' AND code_n = 1 THEN codes ELSE '' END AS code,
 NOT (status IN ('unique_same_company_containment', 'multiple_same_uwwcode') AND coalesce(code_n = 1, false) AND (coalesce(n = 1, false) OR coalesce(each, false))) AS review FROM (
 SELECT p.sensor, a.kind, a.polygons, a.n, a.codes, a.code_n, a.each, CASE WHEN length(p.sensor) % 5 = 2 THEN 'not_eligible_for_catchment_matching' WHEN kind = 'within' AND n = 1 THEN 'unique_same_company_containment' WHEN kind = 'within' AND code_n = 1 THEN 'multiple_same_uwwcode' WHEN kind = 'within' THEN 'multiple_different_uwwcodes'
  WHEN kind = 'boundary' THEN 'boundary_match' WHEN kind = 'other_company' THEN 'company_conflict' ELSE 'no_catchment_match' END AS status FROM p LEFT JOIN a ON p.sensor = a.sensor) p""")
def _(spark, sf):
    points = _points(spark, sf)
    k = F.substring("polygon", 2, 20).cast("int")
    code = F.when(k % 5 != 0, F.concat(F.lit("U"), (k % 4).cast("string")))
    relations = spatial.linked(points, _edges(spark, sf), CELL).withColumn("code", code).withColumn("n_codes", F.when(F.col("code").isNull(), 0).otherwise(1))
    out = master.assignment_status(points.select("sensor", (F.length("sensor") % 5 != 2).alias("eligible")), relations)
    return out.select("sensor", "status", "polygons", "code", "review")


@query("J13_nearest_polygon", f"""WITH p AS {_POINTS}, e AS (SELECT p.sensor, q.polygon, CASE WHEN {_CLOSED} THEN least(p.x - q.x0, q.x0 + q.side - p.x, p.y - q.y0, q.y0 + q.side - p.y) ELSE sqrt(pow(greatest(q.x0 - p.x, 0, p.x - q.x0 - q.side), 2) + pow(greatest(q.y0 - p.y, 0, p.y - q.y0 - q.side), 2)) END AS d FROM p JOIN squares q ON p.company = q.company),
m AS (SELECT sensor, min(d) AS least FROM e GROUP BY 1) SELECT e.sensor, min(polygon) AS polygon, round(any_value(least), 4) AS distance FROM e JOIN m ON e.sensor = m.sensor WHERE d <= least + 1e-9 GROUP BY 1""")
def _(spark, sf):
    return rounded(spatial.nearest_polygon(_points(spark, sf), _edges(spark, sf)), "distance", digits=4)


@query("X11_sensors_per_polygon", _LINKED + "SELECT q.polygon, count(DISTINCT r.sensor) AS sensors FROM squares q LEFT JOIN r ON q.polygon = r.polygon AND kind = 'within' GROUP BY 1")
def _(spark, sf):
    counts = spatial.linked(_points(spark, sf), _edges(spark, sf), CELL).where("kind = 'within'").groupBy("polygon").agg(F.countDistinct("sensor").alias("sensors"))
    return view(spark, sf, "squares").select("polygon").join(counts, "polygon", "left").withColumn("sensors", F.coalesce("sensors", F.lit(0)))


@query("F10_distances", "SELECT sensor, works, round(sqrt(pow(x - works_x, 2) + pow(y - works_y, 2)), 3) AS distance FROM sensors JOIN works USING (company)")
def _(spark, sf):
    return joins.distances(view(spark, sf, "sensors").select("sensor", "company", "x", "y"), view(spark, sf, "works").select("works", "company", "works_x", "works_y"), "company", 3)


_ORIGIN, _SIZE = (0.0, 1_400_000.0), 40_000.0
_RANGE = "CAST(floor((1400000 - y0 - side) / 40000) AS INTEGER) AS r0, CAST(ceil((1400000 - y0) / 40000) - 1 AS INTEGER) AS r1, CAST(floor(x0 / 40000) AS INTEGER) AS c0, CAST(ceil((x0 + side) / 40000) - 1 AS INTEGER) AS c1"


@query("F12_cell_ranges", f"SELECT polygon, {_RANGE} FROM squares")
def _(spark, sf):
    x, y, s = F.col("x0"), F.col("y0"), F.col("side")
    cells = spatial.cell_range(x, x + s, y, y + s, _ORIGIN, _SIZE)
    return view(spark, sf, "squares").select("polygon", *(c.alias(n) for c, n in zip(cells, ("r0", "r1", "c0", "c1"), strict=True)))


_OVERLAP = f"""(SELECT polygon, row, col, (least(x0 + side, (col + 1) * 40000) - greatest(x0, col * 40000)) * (least(y0 + side, 1400000 - row * 40000) - greatest(y0, 1400000 - (row + 1) * 40000)) AS area
 FROM (SELECT *, unnest(generate_series(c0, c1)) AS col FROM (SELECT *, unnest(generate_series(r0, r1)) AS row FROM (SELECT polygon, x0, y0, side, {_RANGE} FROM squares))))"""


def _overlap(spark, sf):
    s = view(spark, sf, "squares")
    x, y, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("side"), F.col("y0") + F.col("side")
    rings = s.select("polygon", F.array(x, x1, x1, x).alias("xs"), F.array(y, y, y1, y1).alias("ys"), F.lit(False).alias("hole"))
    return spatial.grid_overlap(rings, _ORIGIN, _SIZE)


@query("J16_grid_overlap", f"SELECT polygon, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(area, 2) AS area FROM {_OVERLAP} WHERE area > 0")
def _(spark, sf):
    return rounded(_overlap(spark, sf), "area", digits=2)


_GRID = "(SELECT row, col, CAST((row * 31 + col * 17) % 101 AS DOUBLE) AS value, (row + col) % 9 <> 0 AS valid FROM (SELECT unnest(generate_series(0, 40)) AS row) CROSS JOIN (SELECT unnest(generate_series(0, 30)) AS col))"


def _grid(spark):
    r, c = F.col("row"), F.col("col")
    own = spark.range(41 * 31).select((F.col("id") / 31).cast("int").alias("row"), (F.col("id") % 31).cast("int").alias("col"))
    return own.withColumn("value", ((r * 31 + c * 17) % 101).cast("double")).withColumn("valid", (r + c) % 9 != 0)


@query("A28_cell_means", f"""SELECT polygon, round(s / c, 6) AS mean, round(100 * coalesce(c, 0) / (side * side), 4) AS coverage_pct, CASE WHEN cells = 0 THEN 'no_raster_overlap' WHEN coalesce(c, 0) <= 0 THEN 'failed_extraction' WHEN 100 * c / (side * side) >= 99.5 THEN 'complete' WHEN 100 * c / (side * side) >= 95 THEN 'minor_nodata' ELSE 'substantial_nodata' END AS status
 FROM (SELECT polygon, any_value(side) AS side, count(*) AS cells, sum(CASE WHEN valid THEN area END) AS c, sum(CASE WHEN valid THEN area * value END) AS s FROM (SELECT o.*, side, coalesce(valid, false) AS valid, value FROM {_OVERLAP} o JOIN squares USING (polygon) LEFT JOIN {_GRID} g ON o.row = g.row AND o.col = g.col WHERE area > 0) GROUP BY 1)""")
def _(spark, sf):
    totals = view(spark, sf, "squares").select("polygon", (F.col("side") * F.col("side")).alias("total"))
    out = spatial.cell_mean(_overlap(spark, sf), F.broadcast(_grid(spark)), totals)
    out = out.withColumn("status", master.coverage_status(F.col("coverage_pct"), F.col("cells"), F.col("overlap")))
    return rounded(rounded(out.select("polygon", "mean", "coverage_pct", "status"), "mean"), "coverage_pct", digits=4)


@query("F13_raster_validity", "SELECT l_orderkey, l_linenumber, l_partkey, v, NOT isnan(v) AND v >= 0 AND v < 1e10 AS valid FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN -1e0 WHEN 2 THEN 1e20 ELSE CAST(l_quantity AS DOUBLE) END AS v FROM lineitem)")
def _(spark, sf):
    k = F.col("l_linenumber")
    own = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(k == 1, -1.0).when(k == 2, 1e20).otherwise(F.col("l_quantity")).alias("v"))
    return own.withColumn("valid", spatial.valid_cell(F.col("v")))


_KINDS = ["A", "N", "R"]
_AREAS = "(SELECT l_suppkey AS unit, l_returnflag AS kind, sum(l_quantity) AS area, any_value(total) AS total FROM lineitem JOIN (SELECT l_suppkey, sum(l_quantity) * 1.25 AS total FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1, 2)"
_WIDE = "(SELECT unit, " + ", ".join(f"100 * coalesce(sum(area) FILTER (kind = '{k}'), 0) / any_value(total) AS {k}_pct" for k in _KINDS) + f" FROM {_AREAS} GROUP BY 1)"


def _shares(spark, sf):
    own = _read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").alias("area"))
    whole = own.groupBy("unit").agg((F.sum("area") * 1.25).alias("total"))
    return master.shares(own.join(whole, "unit"), "unit", "kind", "area", "total", _KINDS)


@query("A24_A25_area_shares", f"""SELECT unit, round(A_pct, 6) AS A_pct, round(N_pct, 6) AS N_pct, round(R_pct, 6) AS R_pct, concat_ws('|', CASE WHEN abs(A_pct - m) <= 1e-6 THEN 'A' END, CASE WHEN abs(N_pct - m) <= 1e-6 THEN 'N' END, CASE WHEN abs(R_pct - m) <= 1e-6 THEN 'R' END) AS dominant, round(A_pct + N_pct + R_pct, 6) AS covered_pct FROM (SELECT *, greatest(A_pct, N_pct, R_pct) AS m FROM {_WIDE})""")
def _(spark, sf):
    return rounded(_shares(spark, sf), "A_pct", "N_pct", "R_pct", "covered_pct")


@query("V7_percent_gates", f"SELECT 'A_pct in 0..100' AS gate, count(*) FILTER (NOT A_pct BETWEEN 0 AND 100) AS violations, count(*) FILTER (NOT A_pct BETWEEN 0 AND 100) = 0 AS passed FROM {_WIDE} UNION ALL SELECT 'parts sum to covered_pct', count(*) FILTER (abs(A_pct + N_pct + R_pct - covered) > 1e-6), count(*) FILTER (abs(A_pct + N_pct + R_pct - covered) > 1e-6) = 0 FROM {_WIDE} JOIN (SELECT unit, 100 * sum(area) / any_value(total) AS covered FROM {_AREAS} GROUP BY 1) USING (unit) UNION ALL SELECT 'under half', count(*) FILTER (A_pct >= 30), count(*) FILTER (A_pct >= 30) = 0 FROM {_WIDE}")
def _(spark, sf):
    rules = gates.percent("A_pct") | gates.composition(["A_pct", "N_pct", "R_pct"], "covered_pct") | {"under half": F.col("A_pct") < 30}
    return gates.violations(_shares(spark, sf), rules)


@query("A26_group_attributes", "SELECT company, count(*) AS parts, string_agg(polygon, '|' ORDER BY polygon) AS polygons, round(sum(side * side), 2) AS area FROM squares GROUP BY 1")
def _(spark, sf):
    return view(spark, sf, "squares").groupBy("company").agg(F.count("*").alias("parts"), F.array_join(F.array_sort(F.collect_list("polygon")), "|").alias("polygons"), F.round(F.sum(F.col("side") * F.col("side")), 2).alias("area"))


@query("X16_geometry_counts", "SELECT company, count(DISTINCT x0 || '/' || y0) AS geometries, count(DISTINCT x0 || '/' || y0) = 1 AS consistent FROM squares GROUP BY 1")
def _(spark, sf):
    n = F.countDistinct(F.struct("x0", "y0"))
    return view(spark, sf, "squares").groupBy("company").agg(n.alias("geometries"), (n == 1).alias("consistent"))


@query("X21_grid_alignment", f"SELECT count(*) FILTER (a.row IS NULL OR b.row IS NULL) AS unmatched, count(*) FILTER (a.valid <> b.valid) AS mask_differs FROM {_GRID} a FULL JOIN (SELECT row, col, (row + col) % 9 <> 0 OR row = 3 AS valid FROM {_GRID} WHERE row < 38) b ON a.row = b.row AND a.col = b.col")
def _(spark, sf):
    g = _grid(spark)
    a, b = g.select("row", "col", F.col("valid").alias("a")), g.where("row < 38").select("row", "col", (F.col("valid") | (F.col("row") == 3)).alias("b"))
    return a.join(b, ["row", "col"], "full").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.count_if(F.col("a") != F.col("b")).alias("mask_differs"))


@query("F31_block_sizes", "SELECT CAST(floor(x / 100000) AS BIGINT) || '_' || CAST(floor(y / 100000) AS BIGINT) AS block, count(*) AS n FROM sensors GROUP BY 1")
def _(spark, sf):
    from ..operators import models

    return view(spark, sf, "sensors").groupBy(models.block_id(F.col("x"), F.col("y")).alias("block")).agg(F.count("*").alias("n"))


def _works(spark, sf):
    return view(spark, sf, "works").select(F.col("company"), F.col("works").alias("code"), (F.col("works_x") / 10).alias("x"), (F.col("works_y") / 10).alias("y"))


@query("F33_regions")
def _(spark, sf):
    return spatial.clusters(_works(spark, sf), 25.0).select("company", "code", "region")


@query("X43_radius_sensitivity")
def _(spark, sf):
    """Region counts and the spread of a measure's logarithm at three radii."""
    out = None
    for radius in (10.0, 25.0, 50.0):
        r = spatial.clusters(_works(spark, sf), radius).withColumn("m", 1 + F.col("x") + F.col("y")).groupBy("region").agg(F.avg("m").alias("m"))
        one = r.agg(F.lit(radius).alias("radius_km"), F.count("*").alias("regions"), F.var_samp(F.log("m")).alias("variance"), (F.percentile(F.log("m"), F.lit(0.75)) - F.percentile(F.log("m"), F.lit(0.25))).alias("iqr"))
        out = one if out is None else out.unionByName(one)
    return out


@query("A15_A16_A17_A18_region_rollup", f"""SELECT company, count(*) AS sensors, round(sum(beta * w) FILTER (beta IS NOT NULL) / sum(w) FILTER (beta IS NOT NULL), 6) AS weighted_beta, round(sum(beta / (se * se)) FILTER (ok) / sum(1 / (se * se)) FILTER (ok), 6) AS precise_beta, round(exp(avg(ln(beta)) FILTER (beta > 0)), 6) AS geometric_beta, round(sum(tail_count) / sum(total_count), 6) AS ratio,
 count(*) >= 3 AS ge_3, count(*) >= 60 AS ge_60 FROM (SELECT *, CAST(1 + tail_count AS DOUBLE) AS w, (ci_high - ci_low) / 3.92 AS se, beta IS NOT NULL AND ci_high > ci_low AS ok FROM masters) GROUP BY 1""")
def _(spark, sf):
    beta, w = F.col("beta"), (1 + F.col("tail_count")).cast("double")
    out = view(spark, sf, "masters").groupBy("company").agg(
        F.count("*").alias("sensors"), regress.weighted_mean(beta, w).alias("weighted_beta"), regress.precision_mean(beta, F.col("ci_low"), F.col("ci_high")).alias("precise_beta"), regress.geometric_mean(beta).alias("geometric_beta"),
        F.try_divide(F.sum("tail_count"), F.sum("total_count")).alias("ratio"), (F.count("*") >= 3).alias("ge_3"), (F.count("*") >= 60).alias("ge_60"),
    )
    return rounded(out, "weighted_beta", "precise_beta", "geometric_beta", "ratio")
