"""Tiles, levels and grids of terrain and imagery: column functions, and operators over long rasters (row, col, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest side of a window, samples of a tile's side, and sides of terrain grids below a zoom.
MAX_WINDOW, TILE_SAMPLES, GRID_SIDES, LAST_SIDE = 512, 64, ((6, 16), (10, 32), (14, 64)), 65


def _power(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def window(raster: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """A dense window of a raster, null outside it; empty and larger ones than 512 x 512 are refused."""
    if not (1 <= rows <= MAX_WINDOW and 1 <= cols <= MAX_WINDOW):
        raise ValueError(f"a window has 1 to {MAX_WINDOW} rows and columns")
    dense = raster.sparkSession.range(row, row + rows).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(col), F.lit(col + cols - 1))).alias("col"))
    own = raster.where(F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1))
    return dense.join(own, ["row", "col"], "left").select("row", "col", "v")


def subsampled(raster: DataFrame, step: int) -> DataFrame:
    """Every step-th cell of every step-th row."""
    kept = raster.where((F.col("row") % step == 0) & (F.col("col") % step == 0))
    return kept.select((F.col("row") / step).cast("int").alias("row"), (F.col("col") / step).cast("int").alias("col"), "v")


def merged(sources: list[DataFrame]) -> DataFrame:
    """Rasters laid over each other: of each cell the value of the first source that has one, in one grouping."""
    ranked = reduce(DataFrame.union, [s.select("row", "col", F.when(F.col("v").isNotNull(), F.struct(F.lit(k).alias("k"), "v")).alias("s")) for k, s in enumerate(sources)])
    return ranked.groupBy("row", "col").agg(F.min("s").alias("s")).select("row", "col", F.col("s.v").alias("v"))


def tile_grid(raster: DataFrame, side: int, step: int) -> DataFrame:
    """The heights of a terrain tile's grid of side x side samples, a sample every ``step`` cells; missing ones are 0."""
    grid = raster.sparkSession.range(side).select(F.col("id").cast("int").alias("row")).select("row", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("col"))
    return grid.join(subsampled(raster, step), ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def cell_squares(raster: DataFrame, west: float, north: float, size: float) -> DataFrame:
    """Cells with the west and south of their squares, row 0 in the north."""
    return raster.withColumns({"west": west + F.col("col") * size, "south": north - (F.col("row") + 1) * size})


def azimuth_key(azimuth: Column) -> Column:
    """An azimuth in whole tenths of a degree from 0 to 3599, as one of a cache's keys."""
    return F.pmod(F.round(azimuth * 10), F.lit(3600.0)).cast("long")


def snapped(low: Column, high: Column, size: float) -> tuple[Column, Column]:
    """The first cell and the number of cells of a grid that cover a stretch, snapped outwards."""
    first = F.floor(low / size)
    return first, F.ceil(high / size) - first


def overview_levels(pixels: Column, tile: int = 256) -> Column:
    """How many halvings bring a raster down to one tile."""
    return F.greatest(F.ceil(F.log2(pixels / tile)), F.lit(0))


def required_dems(south: Column, north: Column, west: Column, east: Column) -> Column:
    """The one-degree tiles under a box, as an array of lat, lon of their south-west corners."""
    lats, lons = F.sequence(F.floor(south), F.ceil(north) - 1), F.sequence(F.floor(west), F.ceil(east) - 1)
    return F.flatten(F.transform(lats, lambda a: F.transform(lons, lambda o: F.struct(a.alias("lat"), o.alias("lon")))))


def tile_name(lat: Column, lon: Column) -> Column:
    """The name of a one-degree tile, as N47E011."""
    part = lambda v, up, down, n: F.concat(F.when(v >= 0, up).otherwise(down), F.lpad(F.abs(v).cast("int").cast("string"), n, "0"))
    return F.concat(part(lat, "N", "S", 2), part(lon, "E", "W", 3))


def with_availability(tiles: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles and whether a file of their keys is there."""
    there = files.select(*keys).distinct().withColumn("there_", F.lit(True))
    return tiles.join(there, keys, "left").withColumn("available", F.coalesce("there_", F.lit(False))).drop("there_")


def orthometric(points: DataFrame, geoid: DataFrame) -> DataFrame:
    """Points with h, their z above the geoid's cell that holds them; beyond the geoid z itself."""
    keyed = points.withColumn("row", F.ceil("y").cast("int") - 1).withColumn("col", F.floor("x").cast("int"))
    return keyed.join(geoid.select("row", "col", "v"), ["row", "col"], "left").withColumn("h", F.col("z") + F.coalesce("v", F.lit(0.0))).drop("row", "col", "v")


def coarsest_level(finest: float, wanted: Column, levels: int) -> Column:
    """The highest overview level whose cells, twice as large a level, are as fine as wanted; null if none is."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda n: _power(n) * finest <= wanted))


def deepest_level(spacing: Column | float, levels: int = 24, samples: int = TILE_SAMPLES) -> Column:
    """The first geographic level whose samples lie as close as a spacing in degrees; null beyond the levels."""
    spacing = F.lit(spacing) if isinstance(spacing, float) else spacing
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda n: 180 / _power(n) / samples <= spacing))


def max_zoom(resolution: Column, tile: int = 256) -> Column:
    """The Web Mercator zoom whose pixels are as fine as a resolution in degrees."""
    return F.ceil(F.log2(360 / tile / resolution))


def grid_side(zoom: Column) -> Column:
    """Samples of a terrain tile's side by zoom."""
    out = None
    for below, side in GRID_SIDES:
        out = F.when(zoom < below, side) if out is None else out.when(zoom < below, side)
    return out.otherwise(LAST_SIDE)


def full_availability(spark: SparkSession, levels: int) -> DataFrame:
    """The last tile of every geographic level: z, last_x, last_y."""
    z = F.col("id")
    return spark.range(levels).select(z.cast("int").alias("z"), (_power(z + 1) - 1).cast("long").alias("last_x"), (_power(z) - 1).cast("long").alias("last_y"))


def availability(tiles: DataFrame, levels: int) -> DataFrame:
    """From the deepest tiles (x, y) the ranges of every level above: z (0 the deepest), x0, x1, y0, y1."""
    rows = tiles.select("x", "y").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    rows = rows.select("z", F.expr("shiftright(x, z)").alias("x"), F.expr("shiftright(y, z)").alias("y"))
    return rows.groupBy("z").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def outer_samples(low: Column, high: Column, cells: int) -> tuple[Column, Column]:
    """The centres of the outer cells of so many cells between two edges."""
    half = (high - low) / (2 * cells)
    return low + half, high - half


def level_scale(length: Column, level: Column) -> Column:
    """A length over the number of pixels that a level has of it."""
    return length / F.ceil(length / _power(level))


def path_bounds(rows: DataFrame, path: str, lat: str) -> DataFrame:
    """Per path the least and greatest latitude, and whether both are on the globe."""
    low, high = F.min(lat), F.max(lat)
    return rows.groupBy(path).agg(low.alias("low"), high.alias("high"), ((low >= -90) & (high <= 90)).alias("on_globe"))


def pyramid(raster: DataFrame, levels: int) -> DataFrame:
    """A raster's cells by tiles of a quadtree: z, x, y, cells with a value, mean; the last level has a cell a tile."""
    rows = raster.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = _power(levels - 1 - F.col("z"))
    return rows.groupBy("z", F.floor(F.col("col") / side).cast("int").alias("x"), F.floor(F.col("row") / side).cast("int").alias("y")).agg(F.count("v").alias("cells"), F.avg("v").alias("mean"))


def ramp(value: Column, low: float, high: float) -> Column:
    """A value's place between two ends as a byte; null is 0."""
    share = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(value.isNotNull(), (255 * share).cast("int")).otherwise(0)


def opacity(value: Column) -> Column:
    return F.when(value.isNull(), 0).otherwise(255)


def pixel_of(lat: Column, lon: Column, width: int, height: int) -> tuple[Column, Column]:
    """The pixel of a place on a plate-carr\u00e9e map of the globe."""
    return ((lon + 180) / 360 * width).cast("int"), ((90 - lat) / 180 * height).cast("int")


def tile_columns(west: Column, east: Column, zoom: int) -> tuple[Column, Column]:
    """The first and last tile column of a footprint at a zoom."""
    column = lambda lon: F.floor((lon + 180) / 360 * 2**zoom)
    return column(west), column(east)


def refused_without_coverage(sampled: DataFrame, value: str = "v") -> DataFrame:
    """Sampled places as they are; raises if one of them has no coverage."""
    if not sampled.where(F.col(value).isNull()).isEmpty():
        raise ValueError("a place has no elevation coverage")
    return sampled
