"""Planar geometry without a library: grid-bucketed point-in-polygon joins, grid overlap, clipping, projections, clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let

#: Parts that an overlay's cell is cut into.
PARTS_A_CELL = 8

#: Polygons are edge tables (polygon, company, x1, y1, x2, y2); rings of holes are edges like others.


def boxes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("polygon", "company").agg(F.min(F.least("x1", "x2")).alias("x_min"), F.max(F.greatest("x1", "x2")).alias("x_max"), F.min(F.least("y1", "y2")).alias("y_min"), F.max(F.greatest("y1", "y2")).alias("y_max"))


def candidates(points: DataFrame, edges: DataFrame, cell: float, same_company: bool = True) -> DataFrame:
    """Pairs of points (sensor, company, x, y) and polygons whose box holds them, by an equi-join on grid cells."""
    def at(c: Column) -> Column:
        return F.floor(c / cell).cast("long")

    box = boxes(edges).withColumn("cx", F.explode(F.sequence(at(F.col("x_min")), at(F.col("x_max"))))).withColumn("cy", F.explode(F.sequence(at(F.col("y_min")), at(F.col("y_max")))))
    box = box.withColumnRenamed("company", "polygon_company")
    out = points.withColumn("cx", at(F.col("x"))).withColumn("cy", at(F.col("y"))).join(box, ["cx", "cy"])
    own = F.col("company") == F.col("polygon_company")
    return out.where((own if same_company else ~own) & F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))).select("sensor", "company", "x", "y", "polygon", "polygon_company")


def relations(points: DataFrame, edges: DataFrame, cell: float, same_company: bool = True) -> DataFrame:
    """(sensor, polygon, inside, on_edge): a ray's crossings are counted over the polygon's edges; a point on an edge or vertex isn't inside."""
    e = edges.select("polygon", "x1", "y1", "x2", "y2")
    pairs = candidates(points, edges, cell, same_company).join(e, "polygon")
    x, y = F.col("x"), F.col("y")
    cross = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    on = (cross == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    crosses = spans & (x < F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    crosses = F.when(spans, crosses).otherwise(False)
    out = pairs.groupBy("sensor", "polygon").agg((F.count_if(crosses) % 2 == 1).alias("odd"), F.max(on).alias("on_edge"))
    return out.select("sensor", "polygon", (F.col("odd") & ~F.col("on_edge")).alias("inside"), "on_edge")


def linked(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(sensor, kind, polygon): within its company's polygons; else on their boundary; else within another company's. Each step takes the rest of the one before."""
    own = relations(points, edges, cell)
    within = own.where("inside").select("sensor", F.lit("within").alias("kind"), "polygon")
    rest = points.join(within, "sensor", "left_anti")
    edge = own.where("on_edge").join(rest.select("sensor"), "sensor", "left_semi").select("sensor", F.lit("boundary").alias("kind"), "polygon")
    last = rest.join(edge, "sensor", "left_anti")
    other = relations(last, edges, cell, same_company=False).where("inside").select("sensor", F.lit("other_company").alias("kind"), "polygon")
    return within.unionByName(edge).unionByName(other)


def segment_distance(x: Column, y: Column) -> Column:
    """From a point to the segment of the row's edge."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / size))).otherwise(0.0)
    return F.hypot(x - F.col("x1") - t * dx, y - F.col("y1") - t * dy)


def nearest_polygon(points: DataFrame, edges: DataFrame, slack: float = 1e-9, cell: float | None = None) -> DataFrame:
    """Each point's nearest polygon of its company by boundary distance, the smallest identifier on ties.

    Edges are entered in the cells that they come within a cell's length of, so whatever lies that near a point is met
    by an equi-join on its cell. Points that find nothing so near go on with cells four times as long, until these are
    as long as the whole extent. The first cells, unless given, are as long as polygons of one company stand apart.
    """
    x0, x1, y0, y1 = (F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2"))
    ends = edges.agg(F.min(x0), F.max(x1), F.min(y0), F.max(y1), F.approx_count_distinct("polygon"), F.approx_count_distinct("company")).first()
    own = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None or own[0] is None:
        return points.select("sensor", F.lit(None).cast("string").alias("polygon"), F.lit(None).cast("double").alias("distance")).limit(0)
    span = max(max(ends[1], own[1]) - min(ends[0], own[0]), max(ends[3], own[3]) - min(ends[2], own[2]), cell or 1e-9)
    found, rest, size = None, points, cell or span / max(1.0, (ends[4] / max(ends[5], 1)) ** 0.5)
    while True:
        size = min(size, 2 * span)
        at = lambda c: F.floor(c / size).cast("long")  # noqa: E731, B023
        near = edges.withColumn("cx", F.explode(F.sequence(at(x0 - size), at(x1 + size)))).withColumn("cy", F.explode(F.sequence(at(y0 - size), at(y1 + size))))
        met = rest.withColumn("cx", at(F.col("x"))).withColumn("cy", at(F.col("y"))).join(near, ["company", "cx", "cy"])
        each = met.groupBy("sensor", "polygon").agg(F.min(segment_distance(F.col("x"), F.col("y"))).alias("distance"))
        least = each.groupBy("sensor").agg(F.min("distance").alias("least"))
        last = size >= 2 * span
        least = least if last else least.where(F.col("least") <= size)
        best = each.join(least, "sensor").where(F.col("distance") <= F.col("least") + slack).groupBy("sensor").agg(F.min("polygon").alias("polygon"), F.first("least").alias("distance"))
        best = best if last else best.persist()
        found = best if found is None else found.unionByName(best)
        if last:
            return found
        rest = rest.join(best.select("sensor"), "sensor", "left_anti")
        if rest.isEmpty():
            return found
        size *= 4


def cell_range(x_min: Column, x_max: Column, y_min: Column, y_max: Column, origin: tuple[float, float], size: float) -> tuple[Column, Column, Column, Column]:
    """First and last row and column of the cells that a box meets; rows count down from the origin's y."""
    ox, oy = origin
    return F.floor((oy - y_max) / size).cast("int"), (F.ceil((oy - y_min) / size) - 1).cast("int"), F.floor((x_min - ox) / size).cast("int"), (F.ceil((x_max - ox) / size) - 1).cast("int")


def clip_area(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """The area of a ring inside a rectangle: four half-plane cuts, then the shoelace sum."""
    points = ring
    for axis, bound, keep_above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        if not len(points):
            return 0.0
        d = points[:, axis] - bound if keep_above else bound - points[:, axis]
        out = []
        for k in range(len(points)):
            j = (k + 1) % len(points)
            if d[k] >= 0:
                out.append(points[k])
            if (d[k] >= 0) != (d[j] >= 0):
                out.append(points[k] + (points[j] - points[k]) * (d[k] / (d[k] - d[j])))
        points = np.array(out)
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def grid_overlap(rings: DataFrame, origin: tuple[float, float], size: float) -> DataFrame:
    """(polygon, row, col, area) of rings (polygon, xs, ys, hole): cells of the box by sequences, areas by clipping in Arrow batches, holes subtracted."""
    r0, r1, c0, c1 = cell_range(F.array_min("xs"), F.array_max("xs"), F.array_min("ys"), F.array_max("ys"), origin, size)
    cells = rings.withColumn("row", F.explode(F.sequence(r0, r1))).withColumn("col", F.explode(F.sequence(c0, c1)))

    def clip(batches):
        for part in batches:
            areas = []
            for r in part.itertuples():
                x0, y1 = origin[0] + r.col * size, origin[1] - r.row * size
                areas.append((-1 if r.hole else 1) * clip_area(np.column_stack([r.xs, r.ys]), x0, y1 - size, x0 + size, y1))
            yield pd.DataFrame({"polygon": part["polygon"], "row": part["row"], "col": part["col"], "area": areas})

    out = cells.mapInPandas(clip, "polygon string, row int, col int, area double")
    return out.groupBy("polygon", "row", "col").agg(F.sum("area").alias("area")).where("area > 0")


def cell_mean(overlap: DataFrame, grid: DataFrame, totals: DataFrame) -> DataFrame:
    """Area-weighted means of a grid (row, col, value, valid) over polygons, with coverage. totals: (polygon, total)."""
    own = overlap.join(grid, ["row", "col"], "left").withColumn("ok", F.coalesce(F.col("valid"), F.lit(False)))
    out = own.groupBy("polygon").agg(F.sum(F.when(F.col("ok"), F.col("area"))).alias("covered"), F.sum(F.when(F.col("ok"), F.col("area") * F.col("value"))).alias("s"), F.count("*").alias("cells"))
    out = totals.join(out, "polygon", "left")
    covered = F.coalesce("covered", F.lit(0.0))
    return out.select("polygon", F.try_divide("s", "covered").alias("mean"), (100.0 * covered / F.col("total")).alias("coverage_pct"), F.coalesce("cells", F.lit(0)).alias("cells"), covered.alias("overlap"))


def valid_cell(value: Column, least: float = 0.0, most: float = 1e10) -> Column:
    return F.coalesce(~F.isnan(value) & (value >= least) & (value < most), F.lit(False))


#: The national grid's ellipsoid, scale and origin, and the seven-parameter shift to the world frame (fixed values).
AIRY, WORLD = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
SCALE, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
SHIFT, TURN, STRETCH = (446.448, -125.157, 542.060), tuple(math.radians(s / 3600) for s in (0.1502, 0.2470, 0.8421)), -20.4894e-6


def _arc(lat: Column) -> Column:
    a, b = AIRY
    t = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    return b * SCALE * ((1 + t + 1.25 * t**2 + 1.25 * t**3) * d - (3 * t + 3 * t**2 + 2.625 * t**3) * F.sin(d) * F.cos(s) + (1.875 * t**2 + 1.875 * t**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * t**3 * F.sin(3 * d) * F.cos(3 * s))


def _repeat(start: Column, step, times: int = 5) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda v, _: step(v))


def _unprojected(lat: Column, d: Column) -> Column:
    """Latitude and longitude on the grid's own ellipsoid, d metres east of the central meridian at the foot latitude."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    s2 = F.pow(F.sin(lat), 2)
    nu, rho = a * SCALE / F.sqrt(1 - e2 * s2), a * SCALE * (1 - e2) / F.pow(1 - e2 * s2, 1.5)
    q, tan, sec = nu / rho, F.tan(lat), 1 / F.cos(lat)
    p = F.pow
    phi = lat - tan / (2 * rho * nu) * p(d, 2) + tan / (24 * rho * p(nu, 3)) * (4 + 3 * p(tan, 2) + q - 9 * p(tan, 2) * (q - 1)) * p(d, 4) - tan / (720 * rho * p(nu, 5)) * (61 + 90 * p(tan, 2) + 45 * p(tan, 4)) * p(d, 6)
    lam = LON0 + sec / nu * d - sec / (6 * p(nu, 3)) * (q + 2 * p(tan, 2)) * p(d, 3) + sec / (120 * p(nu, 5)) * (5 + 28 * p(tan, 2) + 24 * p(tan, 4)) * p(d, 5)
    return F.struct(phi.alias("phi"), lam.alias("lam"))


def _shifted(g: Column) -> Column:
    """World-frame latitude and longitude in radians of a struct (phi, lam)."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    phi, lam = g["phi"], g["lam"]
    v = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    x, y, z = v * F.cos(phi) * F.cos(lam), v * F.cos(phi) * F.sin(lam), (1 - e2) * v * F.sin(phi)
    (tx, ty, tz), (rx, ry, rz), k = SHIFT, TURN, 1 + STRETCH
    moved = F.struct((tx + k * x - rz * y + ry * z).alias("x"), (ty + rz * x + k * y - rx * z).alias("y"), (tz - ry * x + rx * y + k * z).alias("z"))
    wa, wb = WORLD
    we2 = 1 - (wb / wa) ** 2

    def angles(m: Column) -> Column:
        p = F.hypot(m["x"], m["y"])
        lat = _repeat(F.atan2(m["z"], p * (1 - we2)), lambda t: F.atan2(m["z"] + we2 * wa / F.sqrt(1 - we2 * F.pow(F.sin(t), 2)) * F.sin(t), p))
        return F.struct(lat.alias("lat"), F.atan2(m["y"], m["x"]).alias("lon"))

    return let(moved, angles)


def to_degrees(e: Column, n: Column) -> Column:
    """A struct (lat, lon) in degrees of national-grid coordinates: the inverse projection's series, then the shift; good to some metres."""
    foot = _repeat((n - N0) / (AIRY[0] * SCALE) + LAT0, lambda t: t + (n - N0 - _arc(t)) / (AIRY[0] * SCALE))
    world = let(let(foot, lambda t: _unprojected(t, e - E0)), _shifted)
    return let(world, lambda w: F.struct(F.degrees(w["lat"]).alias("lat"), F.degrees(w["lon"]).alias("lon")))


def complete_linkage(x: np.ndarray, limit: float) -> np.ndarray:
    """Cluster numbers of points by complete linkage cut at `limit`: nearest-neighbour chains on the distance matrix."""
    n = len(x)
    d = np.empty((n, n), np.float32 if n > 2000 else np.float64)
    for k in range(0, n, 256):  # no more than a few rows are held twice
        part = x[k : k + 256]
        d[k : k + 256] = np.hypot(part[:, :1] - x[None, :, 0], part[:, 1:] - x[None, :, 1])
    np.fill_diagonal(d, np.inf)
    label, alive, merges, chain = np.arange(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            best = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[best]:
                best = chain[-2]
            if len(chain) > 1 and best == chain[-2]:
                break
            chain.append(best)
        b, a = chain.pop(), chain.pop()
        merges.append((d[a, b], a, b))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        alive[b] = False
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for height, a, b in merges:
        if height <= limit:
            parent[root(b)] = root(a)
    return np.unique([root(i) for i in label], return_inverse=True)[1]


def clusters(works: DataFrame, radius_km: float) -> DataFrame:
    """works (company, code, x, y) with `region`: complete-linkage clusters of each company, at most radius_km across, numbered by centroid.

    A company's works have to fit a task, with their distance matrix: four bytes a pair, 1.6 GB for the 20,000 works
    beyond which a company is refused.
    """
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > 20_000:
            raise ValueError(f"{len(part)} works in one company")
        part = part.sort_values(["code", "x", "y"]).reset_index(drop=True)
        return part.assign(cluster=complete_linkage(part[["x", "y"]].to_numpy(float), radius_km * 1000))

    own = works.select("company", "code", "x", "y").groupBy("company").applyInPandas(kernel, "company string, code string, x double, y double, cluster int")
    order = own.groupBy("company", "cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).withColumn("k", F.row_number().over(Window.partitionBy("company").orderBy("mx", "my")))
    return own.join(order.select("company", "cluster", "k"), ["company", "cluster"]).withColumn("region", F.format_string(f"%s_R{radius_km:02.0f}_%03d", F.upper("company"), F.col("k"))).drop("cluster", "k")


def polygon_parts(frame: DataFrame, column: str = "coordinates") -> DataFrame:
    """One row for each ring of multipolygons given as arrays of polygons, arrays of rings, arrays of (x, y): polygon, part, ring, hole, xs, ys; empty parts drop."""
    parts = frame.select("polygon", F.posexplode(column).alias("part", "__rings")).where(F.size("__rings") > 0)
    rings = parts.select("polygon", "part", F.posexplode("__rings").alias("ring", "__p")).where(F.size("__p") >= 3)
    return rings.select("polygon", "part", "ring", (F.col("ring") > 0).alias("hole"), F.transform("__p", lambda p: p[0]).alias("xs"), F.transform("__p", lambda p: p[1]).alias("ys"))


def consistent_geometry(frame: DataFrame, key: str, geometry: list[str]) -> DataFrame:
    """One row a key with its geometry; a key whose rows disagree is an error, as none is chosen."""
    g = F.struct(*geometry)
    own = frame.groupBy(key).agg(F.countDistinct(g).alias("__n"), F.min(g).alias("__g"))
    if n := own.where("__n > 1").count():
        raise ValueError(f"{n} keys with several geometries")
    return own.select(key, "__g.*")


def geometry_counts(frame: DataFrame, key: str, geometry: list[str]) -> DataFrame:
    """How many rows and different geometries a key has, and whether they agree."""
    n = F.countDistinct(F.struct(*geometry))
    return frame.groupBy(key).agg(F.count("*").alias("rows"), n.alias("geometries"), (n == 1).alias("consistent"))


def repaired(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rings, the others with a reason): rings (polygon, xs, ys, hole) with a coordinate that isn't finite, under three different points or no area are put aside; a part that repeats stands once."""
    own = rings.dropDuplicates(["polygon", "xs", "ys", "hole"])
    odd = F.exists("xs", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | F.exists("ys", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    points = F.size(F.array_distinct(F.arrays_zip("xs", "ys")))
    reason = F.when(F.col("xs").isNull() | F.col("ys").isNull() | (F.size("xs") != F.size("ys")), "malformed").when(odd, "not_finite").when(points < 3, "too_few_points").when(ring_area("xs", "ys") <= 0, "no_area")
    own = own.withColumn("reason", reason)
    return own.where("reason is null").drop("reason"), own.where("reason is not null")


def ring_area(xs: str, ys: str) -> Column:
    """The shoelace area of a ring in arrays of its corners, closed or not."""
    n = F.size(xs)
    turn = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(xs, k) * F.get(ys, (k + 1) % n) - F.get(xs, (k + 1) % n) * F.get(ys, k))
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda a, v: a + v)) / 2


def clip_convex(ring: np.ndarray, clip: np.ndarray) -> float:
    """The area of a ring inside a convex ring: a half-plane cut for each of its edges, then the shoelace sum."""
    x, y = clip[:, 0], clip[:, 1]
    if np.dot(x, np.roll(y, -1)) < np.dot(y, np.roll(x, -1)):
        clip = clip[::-1]
    points = ring
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        if len(points) < 3:
            return 0.0
        d = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
        out = []
        for k in range(len(points)):
            j = (k + 1) % len(points)
            if d[k] >= 0:
                out.append(points[k])
            if (d[k] >= 0) != (d[j] >= 0):
                out.append(points[k] + (points[j] - points[k]) * (d[k] / (d[k] - d[j])))
        points = np.array(out).reshape(-1, 2)
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def upright(xs: str, ys: str) -> Column:
    """Whether a ring's corners are those of an upright rectangle, one after the other; its area is then its box's."""
    turned = lambda a, b: (F.get(a, F.lit(0)) == F.get(a, F.lit(3))) & (F.get(a, F.lit(1)) == F.get(a, F.lit(2))) & (F.get(b, F.lit(0)) == F.get(b, F.lit(1))) & (F.get(b, F.lit(2)) == F.get(b, F.lit(3)))
    four = (F.size(xs) == 4) & (F.size(ys) == 4)
    return F.coalesce(four & (turned(xs, ys) | turned(ys, xs)), F.lit(False))


def overlay(units: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """(unit, zone, area) where rings of units (polygon, xs, ys, hole) and of zones, which must be convex, overlap.

    Boxes meet in the cell that holds the lower left corner of their overlap, by an equi-join on cells, so each pair is
    compared once. Cells are cut in parts by the units, as one cell's few rings may make most pairs; zones go to all
    parts. Two upright rectangles overlap in a rectangle, by plain columns; other pairs are clipped in Arrow batches.
    Where no polygon has a second ring, and so no hole, a pair is its own sum; else areas are summed, holes taken off.
    """
    spark = units.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def boxed(rings: DataFrame, name: str) -> DataFrame:
        own = rings.select(F.col("polygon").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("xs", "ys", "hole")), F.array_min("xs").alias(f"{name}_x0"), F.array_max("xs").alias(f"{name}_x1"), F.array_min("ys").alias(f"{name}_y0"), F.array_max("ys").alias(f"{name}_y1"), upright("xs", "ys").alias(f"{name}_upright"))
        # a rectangle's corners are its box
        own = own.withColumns({f"{name}_{c}": F.when(~F.col(f"{name}_upright"), F.col(f"{name}_{c}")) for c in ("xs", "ys")})
        for axis in "xy":
            own = own.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(F.col(f"{name}_{axis}0") / cell).cast("long"), F.floor(F.col(f"{name}_{axis}1") / cell).cast("long"))))
        return own

    left = boxed(units, "unit").withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(PARTS_A_CELL)))
    right = boxed(zones, "zone").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS_A_CELL - 1).cast("long"))))
    both = left.repartition(tasks, "cx", "cy", "part").join(right.repartition(tasks, "cx", "cy", "part").hint("shuffle_hash"), ["cx", "cy", "part"])
    corner = {axis: F.greatest(f"unit_{axis}0", f"zone_{axis}0") for axis in "xy"}
    far = {axis: F.least(f"unit_{axis}1", f"zone_{axis}1") for axis in "xy"}
    meet = [corner[a] < far[a] for a in "xy"] + [F.floor(corner[a] / cell).cast("long") == F.col(f"c{a}") for a in "xy"]
    both = both.where(meet[0] & meet[1] & meet[2] & meet[3])
    plain = F.col("unit_upright") & F.col("zone_upright")
    sign = F.when(F.col("unit_hole") != F.col("zone_hole"), -1.0).otherwise(1.0)
    out = both.where(plain).select("unit", "zone", (sign * (far["x"] - corner["x"]) * (far["y"] - corner["y"])).alias("area"))

    def ring(r, name: str) -> np.ndarray:
        xs, ys = getattr(r, f"{name}_xs"), getattr(r, f"{name}_ys")
        if xs is None:
            x0, x1, y0, y1 = (getattr(r, f"{name}_{c}") for c in ("x0", "x1", "y0", "y1"))
            xs, ys = [x0, x1, x1, x0], [y0, y0, y1, y1]
        return np.column_stack([xs, ys])

    def clip(batches):
        for part in batches:
            areas = [(-1 if r.unit_hole != r.zone_hole else 1) * clip_convex(ring(r, "unit"), ring(r, "zone")) for r in part.itertuples()]
            yield pd.DataFrame({"unit": part["unit"], "zone": part["zone"], "area": areas})

    uneven = lambda rings: rings.where(~upright("xs", "ys"))
    if not (uneven(units).isEmpty() and uneven(zones).isEmpty()):
        out = out.unionByName(both.where(~plain).drop("unit_upright", "zone_upright", "cx", "cy", "part").mapInPandas(clip, "unit string, zone string, area double"))
    single = all(rings.groupBy("polygon").agg(F.count("*").alias("n"), F.max("hole").alias("hole")).where("n > 1 or hole").isEmpty() for rings in (units, zones))
    if not single:
        out = out.groupBy("unit", "zone").agg(F.sum("area").alias("area"))
    return out.where("area > 0")


def union_area(rectangles: DataFrame, by: str, step: float) -> DataFrame:
    """(by, area) that rectangles (by, x0, y0, x1, y1) on a grid of `step` cover together, overlaps once; a corner off the grid is an error, as the area would not be exact."""
    off = lambda c: F.abs(F.col(c) / step - F.round(F.col(c) / step)) > 1e-9
    if n := rectangles.where(off("x0") | off("y0") | off("x1") | off("y1")).count():
        raise ValueError(f"{n} rectangles aren't on the grid")
    at = lambda c: F.round(F.col(c) / step).cast("long")
    cells = rectangles.where("x1 > x0 and y1 > y0").select(by, F.explode(F.sequence(at("x0"), at("x1") - 1)).alias("cx"), at("y0").alias("r0"), at("y1").alias("r1"))
    # a column of cells is a set of intervals: their union is summed by runs, not listed
    order = Window.partitionBy(by, "cx").orderBy("r0", "r1")
    reach = F.max("r1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("r1") - F.greatest(F.col("r0"), F.coalesce(reach, F.col("r0"))), F.lit(0))
    return cells.distinct().withColumn("fresh", fresh).groupBy(by).agg((F.sum("fresh") * step * step).alias("area"))


def dissolved(rectangles: DataFrame, by: str, key: str, step: float) -> DataFrame:
    """Groups of grid-aligned rectangles as one feature: its parts' keys in order, how many there are, and the exact area of their union."""
    parts = rectangles.groupBy(by).agg(F.count("*").alias("parts"), F.array_join(F.array_sort(F.collect_set(key)), "|").alias("keys"))
    return parts.join(union_area(rectangles, by, step), by, "left")
