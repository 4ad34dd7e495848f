"""Raster and terrain operators over a long raster (row, col, v); row 0 is north, nodata is null.

Stencils are windows within (row, block) keys where one row is enough, and equi-joins on shifted keys elsewhere, so every
operator shuffles by cell or row key and holds no raster in one place.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.geodesy import DEGREE_M, MERCATOR_LIMIT, A, from_mercator
from quarrystone.operators.lineage import settled, spread

_AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
#: Names of the neighbours, by row and column.
_NAMES = dict(zip(_AROUND, ("a", "b", "c", "d", "f", "g", "h", "i")))


def neighbourhood(raster: DataFrame, steps: list[tuple[int, int]] = _AROUND) -> DataFrame:
    """Each cell with its neighbours' values as columns a..i (a b c / d . f / g h i); one shuffle.

    Every cell sends its value to the cells around it; a cell keeps its row if it sent one to itself.
    """
    sent = F.explode(F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(_NAMES.get((dr, dc), "e")).alias("n")) for dr, dc in [*steps, (0, 0)]])).alias("s")
    rows = raster.select("row", "col", "v", sent).select((F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), "s.n", "v")
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("v"))).alias(n)
    out = rows.groupBy("row", "col").agg(F.max(F.when(F.col("n") == "e", 1)).alias("own"), pick("e"), *[pick(_NAMES[s]) for s in steps])
    return out.where("own = 1").drop("own").withColumnRenamed("e", "v")


def gradient(cells: DataFrame, size: float) -> DataFrame:
    """Horn's gradient: dx eastwards and dy northwards; null where any of the nine is."""
    c = F.col
    dx = ((c("c") + 2 * c("f") + c("i")) - (c("a") + 2 * c("d") + c("g"))) / (8 * size)
    dy = ((c("a") + 2 * c("b") + c("c")) - (c("g") + 2 * c("h") + c("i"))) / (8 * size)
    known = c("v").isNotNull()
    return cells.select("row", "col", "v", F.when(known, dx).alias("dx"), F.when(known, dy).alias("dy"))


def slope(dx: Column, dy: Column) -> Column:
    """Degrees."""
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def aspect(dx: Column, dy: Column) -> Column:
    """Compass degrees of the downward direction, 0 = north; null on flat ground."""
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(-dx, -dy)) + 360, F.lit(360.0)))


def hillshade(dx: Column, dy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Lambert's shade, 0 to 255."""
    zenith, az = math.radians(90 - altitude), math.radians(azimuth)
    s = F.atan(F.sqrt(dx * dx + dy * dy))
    facing = F.when((dx != 0) | (dy != 0), F.atan2(-dx, -dy)).otherwise(0.0)
    return F.greatest(F.lit(0.0), 255 * (math.cos(zenith) * F.cos(s) + math.sin(zenith) * F.sin(s) * F.cos(F.lit(az) - facing)))


def irradiance(slope_deg: Column, aspect_deg: Column, lat: float, day: int) -> Column:
    """Beam irradiance at solar noon, W/m2: sun due south, no shadows, no diffuse light."""
    declination = 23.45 * math.sin(math.radians(360 / 365 * (284 + day)))
    alt = math.radians(max(90 - abs(lat - declination), 0))
    s = F.radians(slope_deg)
    facing = F.cos(F.radians(180 - F.coalesce(aspect_deg, F.lit(180.0))))
    return 1000 * F.greatest(math.sin(alt) * F.cos(s) + math.cos(alt) * F.sin(s) * facing, F.lit(0.0))


def sampled(places: DataFrame, raster: DataFrame, clamp: tuple[int, int] | None = None, ignore_weightless: bool = False) -> DataFrame:
    """Bilinear samples of places (id, fr, fc: row and column as fractions): id, v; null if a corner is.

    ``clamp`` (last row, last column) holds corners to the raster's edge; otherwise all four must exist. With
    ``ignore_weightless``, corners of weight 0 may be missing.
    """
    r0, c0 = F.floor("fr"), F.floor("fc")
    tr, tc = F.col("fr") - r0, F.col("fc") - c0
    corners = [(0, 0, (1 - tr) * (1 - tc)), (0, 1, (1 - tr) * tc), (1, 0, tr * (1 - tc)), (1, 1, tr * tc)]
    rows = places.select("id", F.explode(F.array(*[F.struct((r0 + dr).alias("row"), (c0 + dc).alias("col"), w.alias("w")) for dr, dc, w in corners])).alias("s")).select("id", "s.*")
    if clamp:
        rows = rows.withColumn("row", F.greatest(F.least("row", F.lit(clamp[0])), F.lit(0))).withColumn("col", F.greatest(F.least("col", F.lit(clamp[1])), F.lit(0)))
    met = rows.join(spread(raster.select("row", "col", "v")), ["row", "col"], "left")
    missing = F.col("v").isNull() & (F.col("w") > 0) if ignore_weightless else F.col("v").isNull()
    return met.groupBy("id").agg(F.when(F.sum(missing.cast("int")) == 0, F.sum(F.coalesce("v", F.lit(0.0)) * F.col("w"))).alias("v"))


def flooded(raster: DataFrame, level: float, cell_m2: float) -> DataFrame:
    """Cells strictly below a level: how many, and their area. Nodata is never flooded."""
    return raster.where(F.col("v") < level).agg(F.count("*").alias("cells"), (F.count("*") * cell_m2).alias("area"))


def cell_metres(size_deg: float, lat: float) -> tuple[float, float]:
    return size_deg * DEGREE_M * math.cos(math.radians(lat)), size_deg * DEGREE_M


def ndvi(bands: DataFrame, since: str) -> DataFrame:
    """(b1 - b0) / (b1 + b0 - 2000) of the medians of each cell's bands from a day on."""
    rows = bands.where(F.col("day") >= F.lit(since).cast("timestamp"))
    wide = rows.groupBy("row", "col").agg(*[F.median(F.when(F.col("band") == b, F.col("v"))).alias(f"b{b}") for b in (0, 1)])
    return wide.select("row", "col", F.try_divide(F.col("b1") - F.col("b0"), F.col("b1") + F.col("b0") - 2000).alias("ndvi"))


def filled_rings(raster: DataFrame, rings: int) -> DataFrame:
    """Voids filled ring by ring with the mean of the known cells beside, all cells of a ring at once."""
    for _ in range(rings):
        cells = neighbourhood(raster, [(-1, 0), (0, -1), (0, 1), (1, 0)])
        near = [F.col(n) for n in "bdfh"]
        total = sum((F.coalesce(n, F.lit(0.0)) for n in near[1:]), F.coalesce(near[0], F.lit(0.0)))
        known = sum((n.isNotNull().cast("int") for n in near[1:]), near[0].isNotNull().cast("int"))
        raster = cells.select("row", "col", F.coalesce("v", F.when(known > 0, total / known)).alias("v"))
    return raster


def flow_directions(raster: DataFrame) -> DataFrame:
    """D8: to_row, to_col of the steepest way down (diagonals over the root of two; ties to the first of a..i); else null."""
    cells = neighbourhood(raster)
    ways = F.array(*[F.struct(((F.col("v") - F.col(n)) / (math.sqrt(2) if s[0] and s[1] else 1.0)).alias("drop"), F.lit(-k).alias("k"), F.lit(s[0]).alias("dr"), F.lit(s[1]).alias("dc")) for k, (s, n) in enumerate(_NAMES.items())])
    best = F.array_max(F.filter(ways, lambda w: w["drop"] > 0))
    return cells.where("v is not null").select("row", "col", "v", (F.col("row") + best["dr"]).alias("to_row"), (F.col("col") + best["dc"]).alias("to_col"))


def watersheds(directions: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Each cell's outlet, by pointer jumping: every round doubles how far a cell looks. Directions in a circle raise."""
    at = directions.select("row", "col", F.coalesce("to_row", "row").alias("r"), F.coalesce("to_col", "col").alias("c"))
    known = directions.select(F.col("row").alias("r"), F.col("col").alias("c")).withColumn("known", F.lit(True))
    at = at.join(known, ["r", "c"], "left").select("row", "col", F.when(F.col("known"), F.col("r")).otherwise(F.col("row")).alias("r"), F.when(F.col("known"), F.col("c")).otherwise(F.col("col")).alias("c"))
    for _ in range(most_rounds):
        at = settled(at)
        nxt = at.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("r").alias("r2"), F.col("c").alias("c2"))
        jumped = settled(at.join(nxt, ["r", "c"]).select("row", "col", F.col("r2").alias("r"), F.col("c2").alias("c"), ((F.col("r2") != F.col("r")) | (F.col("c2") != F.col("c"))).alias("moved")))
        if jumped.where("moved").isEmpty():
            return at.select("row", "col", F.col("r").alias("outlet_row"), F.col("c").alias("outlet_col"))
        at = jumped.drop("moved")
    raise ValueError("the flow directions hold a circle")


def accumulation(directions: DataFrame, most_rounds: int = 40) -> DataFrame:
    """How many cells drain through each, itself included, by path doubling: the sum over the cells at most 2**k steps above is
    that over 2**k - 1 steps, and as much again of the cells 2**k steps above. As many rounds as the longest way's logarithm.
    Directions in a circle raise."""
    cells = directions.select("row", "col")
    inside = directions.where("to_row is not null").select("row", "col", F.col("to_row").alias("r"), F.col("to_col").alias("c"))
    # ways: where a cell's water is after 2**k steps; sums: the cells at most 2**k - 1 steps above, itself included
    ways = inside.join(cells.select(F.col("row").alias("r"), F.col("col").alias("c")), ["r", "c"], "left_semi").select("row", "col", "r", "c")
    sums = cells.withColumn("cells", F.lit(1).cast("long"))
    for _ in range(most_rounds):
        ways = settled(ways)
        if ways.isEmpty():
            return sums
        moved = ways.join(sums, ["row", "col"]).select(F.col("r").alias("row"), F.col("c").alias("col"), "cells")
        sums = settled(sums.union(moved).groupBy("row", "col").agg(F.sum("cells").alias("cells")))
        nxt = ways.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("r").alias("r2"), F.col("c").alias("c2"))
        ways = ways.join(nxt, ["r", "c"]).select("row", "col", F.col("r2").alias("r"), F.col("c2").alias("c"))
    raise ValueError("the flow directions hold a circle")


def sinks_filled(raster: DataFrame, by: str = "raster") -> DataFrame:
    """Priority flood of each raster (one tile a group): no cell is below its way out."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["row"].max()) + 1, int(rows["col"].max()) + 1
        v = np.full((h, w), np.nan)
        v[rows["row"], rows["col"]] = rows["v"]
        known = ~np.isnan(v)
        done, heap = ~known, []
        for r, c in zip(*np.nonzero(known)):
            edge = r in (0, h - 1) or c in (0, w - 1) or not known[r - 1 : r + 2, c - 1 : c + 2].all()
            if edge:
                heapq.heappush(heap, (v[r, c], r, c))
                done[r, c] = True
        while heap:
            level, r, c = heapq.heappop(heap)
            for dr, dc in _AROUND:
                i, j = r + dr, c + dc
                if 0 <= i < h and 0 <= j < w and not done[i, j]:
                    done[i, j] = True
                    v[i, j] = max(v[i, j], level)
                    heapq.heappush(heap, (v[i, j], i, j))
        return pd.DataFrame({by: rows[by], "row": rows["row"], "col": rows["col"], "v": v[rows["row"], rows["col"]]})

    return raster.groupBy(by).applyInPandas(one, f"{by} long, row int, col int, v double")


def visible(raster: DataFrame, row: int, col: int, height: float, radius: int) -> DataFrame:
    """Cells seen from a cell: along the ray to each cell no angle is larger. The window of the radius bounds the work.

    A ray to a cell passes one cell per step of its longer side; steps meet the raster in one equi-join.
    """
    near = raster.where(F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius) & F.col("v").isNotNull())
    eye = near.where((F.col("row") == row) & (F.col("col") == col)).select((F.col("v") + height).alias("eye"))
    dr, dc = F.col("row") - row, F.col("col") - col
    n = F.greatest(F.abs(dr), F.abs(dc))
    targets = near.select("row", "col", "v", n.alias("n")).where((F.col("n") > 0) & (dr * dr + dc * dc <= radius * radius))
    steps = targets.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = steps.select(F.col("row").alias("tr"), F.col("col").alias("tc"), (F.lit(row) + F.round(dr * F.col("k") / F.col("n")).cast("int")).alias("row"), (F.lit(col) + F.round(dc * F.col("k") / F.col("n")).cast("int")).alias("col"), (F.col("k") == F.col("n")).alias("last"))
    met = at.join(near, ["row", "col"]).join(F.broadcast(eye))
    far = F.sqrt(F.pow(F.col("row") - row, 2) + F.pow(F.col("col") - col, 2))
    angle = (F.col("v") - F.col("eye")) / far
    return met.groupBy(F.col("tr").alias("row"), F.col("tc").alias("col")).agg((F.max(F.when(F.col("last"), angle)) >= F.coalesce(F.max(F.when(~F.col("last"), angle)), F.lit(-1e18))).alias("seen"))


def contour_segments(raster: DataFrame, interval: float, base: float = 0.0) -> DataFrame:
    """Marching squares: per 2 x 2 cell and level the segments x1, y1, x2, y2 (column, row); saddles by their mean."""
    q = neighbourhood(raster, [(0, 1), (1, 0), (1, 1)]).where("v is not null and f is not null and h is not null and i is not null")
    low, high = F.least("v", "f", "h", "i"), F.greatest("v", "f", "h", "i")
    level = lambda x: F.ceil((x - base) / interval)
    first, last = level(low), F.floor((high - base) / interval)
    q = q.where(last >= first).withColumn("level", F.explode(F.sequence(first, last))).withColumn("level", F.col("level") * interval + base)
    c = F.col
    cut = lambda a, b: (c("level") - a) / F.nullif(b - a, F.lit(0.0))
    up = lambda n: c(n) >= c("level")
    point = lambda ok, x, y: F.when(ok, F.struct(x.alias("x"), y.alias("y")))
    r, k = c("row").cast("double"), c("col").cast("double")
    edges = [
        point(up("v") != up("f"), k + cut(c("v"), c("f")), r), point(up("f") != up("i"), k + 1, r + cut(c("f"), c("i"))),
        point(up("h") != up("i"), k + cut(c("h"), c("i")), r + 1), point(up("v") != up("h"), k, r + cut(c("v"), c("h"))),
    ]
    hits = F.filter(F.array(*edges), lambda p: p.isNotNull())
    mean_up = (c("v") + c("f") + c("h") + c("i")) / 4 >= c("level")
    pair = lambda m, n: F.struct(F.get(hits, F.lit(m)).alias("p"), F.get(hits, F.lit(n)).alias("q"))
    saddle = F.when(mean_up == up("v"), F.array(pair(0, 1), pair(2, 3))).otherwise(F.array(pair(0, 3), pair(1, 2)))
    pairs = F.when(F.size(hits) == 2, F.array(pair(0, 1))).when(F.size(hits) == 4, saddle)
    return q.select("level", F.explode(pairs).alias("s")).select("level", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def profile(path: DataFrame, distance: Column) -> DataFrame:
    """Length, gain, loss, least and greatest height of a path (seq, v): one path is short, so one ordered pass."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("seq")
    rows = path.withColumn("step", distance).withColumn("rise", F.col("v") - F.lag("v").over(w))
    return rows.groupBy("path").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.coalesce(F.sum(F.greatest("rise", F.lit(0.0))), F.lit(0.0)).alias("gain"), F.coalesce(F.sum(F.greatest(-F.col("rise"), F.lit(0.0))), F.lit(0.0)).alias("loss"), F.min("v").alias("low"), F.max("v").alias("high"))


def terrain_rgb(height: Column) -> list[Column]:
    """The three bytes of a height in tenths of metres above -10,000; missing is 0 m."""
    n = F.greatest(F.least(F.round((F.coalesce(height, F.lit(0.0)) + 10_000) / 0.1), F.lit(16_777_215.0)), F.lit(0.0)).cast("long")
    return [F.shiftright(n, 16).bitwiseAND(F.lit(255)), F.shiftright(n, 8).bitwiseAND(F.lit(255)), n.bitwiseAND(F.lit(255))]


def zigzag(delta: Column) -> Column:
    return F.when(delta >= 0, 2 * delta).otherwise(-2 * delta - 1)


def tms_tiles(z: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """The geographic TMS tiles (two at level 0, y northwards) that a box touches, as an array of x, y."""
    span = 180 / F.pow(F.lit(2.0), z)
    wide, high = F.pow(F.lit(2.0), z + 1).cast("int"), F.pow(F.lit(2.0), z).cast("int")
    hold = lambda v, n: F.greatest(F.least(v.cast("int"), n), F.lit(0))
    x0, x1 = hold(F.floor((west + 180) / span), wide - 1), hold(F.ceil((east + 180) / span), wide)
    y0, y1 = hold(F.floor((south + 90) / span), high - 1), hold(F.ceil((north + 90) / span), high)
    xs = F.sequence(x0, F.greatest(x1 - 1, x0))
    return F.flatten(F.transform(xs, lambda x: F.transform(F.sequence(y0, F.greatest(y1 - 1, y0)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def to_mercator(raster: DataFrame, west: float, north: float, size: float, metres: float) -> DataFrame:
    """A raster in degrees (corner west and north, cells of ``size``) over the same area in Web Mercator, cells of ``metres``:
    bilinear at their centres, those beyond the outer centres held to them. Row 0 is in the north. An empty raster stays so; the area
    ends at the latitudes where Web Mercator does, and one that lies wholly beyond them raises."""
    last = raster.agg(F.max("row"), F.max("col")).first()
    if last[0] is None:
        return raster.select("row", "col", "v")
    y = lambda lat: A * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    upper, lower = (max(-MERCATOR_LIMIT, min(MERCATOR_LIMIT, lat)) for lat in (north, north - (last[0] + 1) * size))
    if lower >= upper:
        raise ValueError(f"the raster covers no ground within {MERCATOR_LIMIT} degrees of latitude")
    x0, y1 = math.radians(west) * A, y(upper)
    width = math.ceil(math.radians((last[1] + 1) * size) * A / metres - 1e-9)
    height = math.ceil((y1 - y(lower)) / metres - 1e-9)
    cells = raster.sparkSession.range(height * width).withColumn("row", F.expr(f"id div {width}")).withColumn("col", F.expr(f"id % {width}"))
    lat, lon = from_mercator(x0 + (F.col("col") + 0.5) * metres, y1 - (F.col("row") + 0.5) * metres)
    hold = lambda v, most: F.greatest(F.least(v, F.lit(float(most))), F.lit(0.0))
    places = cells.select("id", hold((north - lat) / size - 0.5, last[0]).alias("fr"), hold((lon - west) / size - 0.5, last[1]).alias("fc"))
    return sampled(places, raster, ignore_weightless=True).select(F.expr(f"CAST(id div {width} AS INT)").alias("row"), F.expr(f"CAST(id % {width} AS INT)").alias("col"), "v")


def analysis(operation: str, source: DataFrame, west: float, north: float, size: float, metres: float, since: str = "", azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """An analysis layer in Web Mercator (row, col, v), lazily: ``ndvi`` of bands (row, col, band, day, v) from a day on is taken
    before the reprojection, ``slope`` and ``hillshade`` of heights (row, col, v) after it. Other names raise."""
    name = operation.lower()
    if name == "ndvi":
        return to_mercator(ndvi(source, since).select("row", "col", F.col("ndvi").alias("v")), west, north, size, metres)
    if name not in ("slope", "hillshade"):
        raise ValueError(f"no analysis {operation}")
    cells = gradient(neighbourhood(to_mercator(source, west, north, size, metres)), metres)
    dx, dy = F.col("dx"), F.col("dy")
    return cells.select("row", "col", (slope(dx, dy) if name == "slope" else hillshade(dx, dy, azimuth, altitude)).alias("v"))
