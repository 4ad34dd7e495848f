"""Raster and terrain queries (F rows, and K06, K10, K11, K16, K20)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarrystone.functions import geodesy as G
from quarrystone.operators.flood import filled as sinks_filled
from quarrystone.operators import raster as R
from quarrystone.operators import terrain as T
from quarrystone.plans.registry import query

_AT = {"a": (-1, -1), "b": (-1, 0), "c": (-1, 1), "d": (0, -1), "f": (0, 1), "g": (1, -1), "h": (1, 0), "i": (1, 1)}
_N = "SELECT z.row, z.col, z.v, " + ", ".join(f"{n}.v AS {n}" for n in _AT) + " FROM raster z " + " ".join(f"LEFT JOIN raster {n} ON {n}.row = z.row + {r} AND {n}.col = z.col + {c}" for n, (r, c) in _AT.items())
_GRAD = f"SELECT row, col, v, CASE WHEN v IS NOT NULL THEN ((c + 2 * f + i) - (a + 2 * d + g)) / 80 END AS dx, CASE WHEN v IS NOT NULL THEN ((a + 2 * b + c) - (g + 2 * h + i)) / 80 END AS dy FROM ({_N})"
_SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"
_ASPECT = "CASE WHEN dx <> 0 OR dy <> 0 THEN ((degrees(atan2(-dx, -dy)) + 360) % 360 + 360) % 360 END"


def _gradient(t):
    return R.gradient(R.neighbourhood(t.raster), 10.0)


_PLACES = "SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey % (SELECT greatest(10 * max(row) - 5, 10) FROM raster)) / 10.0::DOUBLE + 0.05 AS fr, (c_custkey * 7 % 380) / 10.0::DOUBLE + 0.03 AS fc FROM customer"


def _last_row(t) -> int:
    return t.raster.agg(F.max("row")).first()[0]


def _places(t):
    """Places between all rows of the raster."""
    return t.read("customer").selectExpr("c_custkey AS id", f"(c_custkey % {max(10 * _last_row(t) - 5, 10)}) / 10D + 0.05D AS fr", "(c_custkey * 7 % 380) / 10D + 0.03D AS fc")


def _bilinear(row: str, col: str, bad: str) -> str:
    corners = " UNION ALL ".join(f"SELECT id, floor(fr) + {r} AS row, floor(fc) + {c} AS col, ({'fr - floor(fr)' if r else '1 - (fr - floor(fr))'}) * ({'fc - floor(fc)' if c else '1 - (fc - floor(fc))'}) AS w FROM ({_PLACES})" for r in (0, 1) for c in (0, 1))
    return f"SELECT id, CASE WHEN count(*) FILTER ({bad}) = 0 THEN round(sum(coalesce(r.v, 0) * w), 6) END AS v FROM (SELECT id, w, {row} AS row, {col} AS col FROM ({corners})) k LEFT JOIN raster r ON r.row = k.row AND r.col = k.col GROUP BY 1"


@query("f01_bilinear", _bilinear("row", "col", "r.v IS NULL"))
def bilinear(t):
    return R.sampled(_places(t), t.raster).withColumn("v", F.round("v", 6))


@query("f02_bilinear_clamped", _bilinear("greatest(least(row, (SELECT max(row) // 2 FROM raster)), 0)", "greatest(least(col, 30), 0)", "r.v IS NULL"))
def clamped(t):
    return R.sampled(_places(t), t.raster, (_last_row(t) // 2, 30)).withColumn("v", F.round("v", 6))


@query("f03_heightmap_sample", _bilinear("greatest(least(row, (SELECT max(row) FROM raster)), 0)", "greatest(least(col, 39), 0)", "r.v IS NULL"))
def heightmap(t):
    return R.sampled(_places(t), t.raster, (_last_row(t), 39)).withColumn("v", F.round("v", 6))


@query("f04_weightless_corners", _bilinear("row", "col", "r.v IS NULL AND w > 0"))
def weightless(t):
    return R.sampled(_places(t), t.raster, ignore_weightless=True).withColumn("v", F.round("v", 6))


@query("f05_subsample", "SELECT CAST(r.row // 4 AS INT) AS row, CAST(r.col // 4 AS INT) AS col, round(v, 6) AS v FROM raster r WHERE row % 4 = 0 AND col % 4 = 0")
def subsample(t):
    return T.subsampled(t.raster, 4).withColumn("v", F.round("v", 6))


@query("f06_source_priority", "SELECT row, col, round(coalesce(CASE WHEN col < 20 THEN v END, CASE WHEN row > 3 THEN v + 1 END), 6) AS v FROM raster")
def priority(t):
    none = t.raster.withColumn("v", F.lit(None).cast("double"))
    return T.merged([t.raster.where("col < 20"), t.raster.where("row > 3").withColumn("v", F.col("v") + 1), none]).withColumn("v", F.round("v", 6))


@query("f08_profile", "SELECT path, round(coalesce(sum(step), 0), 4) AS length, round(coalesce(sum(greatest(rise, 0)), 0), 4) AS gain, round(coalesce(sum(greatest(-rise, 0)), 0), 4) AS loss, round(min(v), 4) AS low, round(max(v), 4) AS high FROM (SELECT CAST(col AS BIGINT) AS path, v, v - lag(v) OVER (PARTITION BY col ORDER BY row) AS rise, CASE WHEN lag(row) OVER (PARTITION BY col ORDER BY row) IS NOT NULL THEN 2 * 6371 * asin(sqrt(pow(sin(radians((row - lag(row) OVER (PARTITION BY col ORDER BY row)) * 0.01::DOUBLE) / 2), 2))) END AS step FROM raster WHERE v IS NOT NULL) GROUP BY 1")
def profile(t):
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("seq")
    rows = t.raster.where("v is not null").select(F.col("col").cast("long").alias("path"), F.col("row").alias("seq"), "v")
    lat = F.col("seq") * 0.01
    out = R.profile(rows, G.haversine_km(F.lag(lat).over(w), F.lit(0.0), lat, F.lit(0.0)))
    return out.select("path", *[F.round(c, 4).alias(c) for c in ("length", "gain", "loss", "low", "high")])


@query("f10_cell_metres", "SELECT n_nationkey, round(0.01::DOUBLE * 111320 * cos(radians(n_nationkey * 2)), 6) AS east, round(0.01::DOUBLE * 111320, 6) AS north FROM nation")
def metres(t):
    return t.read("nation").select("n_nationkey", F.round(0.01 * G.DEGREE_M * F.cos(F.radians(F.col("n_nationkey") * 2)), 6).alias("east"), F.round(F.lit(0.01 * G.DEGREE_M), 6).alias("north"))


@query("f11_slope", f"SELECT row, col, round({_SLOPE}, 6) AS slope FROM ({_GRAD})")
def slope(t):
    return _gradient(t).select("row", "col", F.round(R.slope(F.col("dx"), F.col("dy")), 6).alias("slope"))


@query("f12_aspect", f"SELECT row, col, round({_ASPECT}, 4) AS aspect FROM ({_GRAD})")
def aspect(t):
    return _gradient(t).select("row", "col", F.round(R.aspect(F.col("dx"), F.col("dy")), 4).alias("aspect"))


@query("f13_hillshade", f"SELECT row, col, round(CASE WHEN dx IS NULL OR dy IS NULL THEN 0 ELSE greatest(0, 255 * (cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - CASE WHEN dx <> 0 OR dy <> 0 THEN atan2(-dx, -dy) ELSE 0 END))) END, 4) AS shade FROM ({_GRAD})")
def hillshade(t):
    return _gradient(t).select("row", "col", F.round(R.hillshade(F.col("dx"), F.col("dy")), 4).alias("shade"))


@query("f14_contours")
def contours(t):
    return R.contour_segments(t.raster, 20.0)


_DROP = ", ".join(f"(v - {n}) / {math.sqrt(2) if r and c else 1.0!r}::DOUBLE AS d{n}" for n, (r, c) in _AT.items())
_BEST = "greatest(" + ", ".join(f"coalesce(d{n}, -1e18)" for n in _AT) + ")"
_TO = lambda k, base: "CASE " + " ".join(f"WHEN d{n} = best THEN {base} + {s[k]}" for n, s in _AT.items()) + " END"
_D8 = f"SELECT row, col, v, CASE WHEN best > 0 THEN {_TO(0, 'row')} END AS to_row, CASE WHEN best > 0 THEN {_TO(1, 'col')} END AS to_col FROM (SELECT *, {_BEST} AS best FROM (SELECT *, {_DROP} FROM ({_N}) WHERE v IS NOT NULL))"


@query("f15_flow_directions", f"SELECT row, col, to_row, to_col FROM ({_D8})")
def directions(t):
    return R.flow_directions(t.raster).select("row", "col", "to_row", "to_col")


@query("f15_fill_sinks")
def fill(t):
    """The raster as a whole; its sinks reach over the borders of tiles."""
    return sinks_filled(t.raster, 64)


_WALK = f"WITH RECURSIVE d AS ({_D8}), w AS (SELECT row, col, row AS r, col AS c, 0 AS k FROM d UNION ALL SELECT w.row, w.col, d.to_row, d.to_col, k + 1 FROM w JOIN d ON d.row = w.r AND d.col = w.c WHERE d.to_row IS NOT NULL) "


@query("f16_accumulation", _WALK + "SELECT r AS row, c AS col, count(*) AS cells FROM w JOIN d ON d.row = w.r AND d.col = w.c GROUP BY 1, 2")
def accumulation(t):
    return R.accumulation(R.flow_directions(t.raster))


@query("f17_watersheds", _WALK + "SELECT row, col, arg_max(r, k) AS outlet_row, arg_max(c, k) AS outlet_col FROM w GROUP BY 1, 2")
def watersheds(t):
    return R.watersheds(R.flow_directions(t.raster))


@query("f18_flood", "SELECT count(*) AS cells, count(*) * 900.0::DOUBLE AS area FROM raster WHERE v < 110")
def flood(t):
    return R.flooded(t.raster, 110.0, 900.0)


@query("f19_cell_squares", "SELECT row, col, round(10 + col / 2, 6) AS west, round(50 - (row + 1) / 2, 6) AS south FROM raster WHERE v < 110")
def squares(t):
    return T.cell_squares(t.raster.where("v < 110"), 10.0, 50.0, 0.5).select("row", "col", F.round("west", 6).alias("west"), F.round("south", 6).alias("south"))


@query("f20_viewshed")
def viewshed(t):
    return R.visible(t.raster, 2, 20, 10.0, 12)


_DECL = 23.45 * math.sin(math.radians(360 / 365 * (284 + 172)))
_ALT = math.radians(max(90 - abs(40 - _DECL), 0))


@query("f21_irradiance", f"SELECT row, col, round(1000 * greatest({math.sin(_ALT)!r}::DOUBLE * cos(radians(s)) + {math.cos(_ALT)!r}::DOUBLE * sin(radians(s)) * cos(radians(180 - coalesce(a, 180))), 0), 3) AS watts FROM (SELECT row, col, {_SLOPE} AS s, {_ASPECT} AS a FROM ({_GRAD}) WHERE dx IS NOT NULL AND dy IS NOT NULL)")
def irradiance(t):
    g = _gradient(t).where("dx is not null and dy is not null")
    return g.select("row", "col", F.round(R.irradiance(R.slope(F.col("dx"), F.col("dy")), R.aspect(F.col("dx"), F.col("dy")), 40.0, 172), 3).alias("watts"))


@query("f22_ndvi", "SELECT row, col, round(CASE WHEN b1 + b0 - 2000 <> 0 THEN (b1 - b0) / (b1 + b0 - 2000) END, 6) AS ndvi FROM (SELECT row, col, median(v) FILTER (band = 0) AS b0, median(v) FILTER (band = 1) AS b1 FROM bands WHERE day >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)")
def ndvi(t):
    return R.ndvi(t.bands, "1998-01-01").withColumn("ndvi", F.round("ndvi", 6))


@query("f24_engine_key", "SELECT c_custkey, CAST(((round(c_acctbal * 10) % 3600) + 3600) % 3600 AS BIGINT) AS azimuth FROM customer")
def engine_key(t):
    return t.read("customer").select("c_custkey", T.azimuth_key(F.col("c_acctbal")).alias("azimuth"))


@query("f25_export_grid", "SELECT point_id, CAST(floor(x / 0.3::DOUBLE) AS BIGINT) AS col0, CAST(ceil((x + 2) / 0.3::DOUBLE) AS BIGINT) - CAST(floor(x / 0.3::DOUBLE) AS BIGINT) AS cols FROM points")
def export_grid(t):
    first, cells = T.snapped(F.col("x"), F.col("x") + 2, 0.3)
    return t.points.select("point_id", first.alias("col0"), cells.alias("cols"))


@query("f26_overview_levels", "SELECT p_partkey, CAST(greatest(ceil(log2(p_retailprice * 10 / 256)), 0) AS BIGINT) AS levels FROM part")
def overviews(t):
    return t.read("part").select("p_partkey", T.overview_levels(F.col("p_retailprice") * 10).alias("levels"))


def _ring_sql(source: str) -> str:
    near = [("b", -1, 0), ("d", 0, -1), ("f", 0, 1), ("h", 1, 0)]
    joins = " ".join(f"LEFT JOIN {source} {n} ON {n}.row = z.row + {r} AND {n}.col = z.col + {c}" for n, r, c in near)
    total, known = " + ".join(f"coalesce({n}.v, 0)" for n, *_ in near), " + ".join(f"CAST({n}.v IS NOT NULL AS INT)" for n, *_ in near)
    return f"SELECT z.row, z.col, coalesce(z.v, CASE WHEN {known} > 0 THEN ({total}) / ({known}) END) AS v FROM {source} z {joins}"


@query("f28_fill_voids", f"WITH r1 AS ({_ring_sql('raster')}), r2 AS ({_ring_sql('r1')}) SELECT row, col, round(v, 6) AS v FROM r2")
def voids(t):
    return R.filled_rings(t.raster, 2).withColumn("v", F.round("v", 6))


@query("f29_tile_mesh", "SELECT i, j, round(coalesce(v, 0), 6) AS v FROM (SELECT CAST(a AS INT) AS i, CAST(b AS INT) AS j FROM range(9) t(a), range(9) u(b)) LEFT JOIN raster ON row = i * 4 AND col = j * 4")
def tile_mesh(t):
    return T.tile_grid(t.raster, 9, 4).select(F.col("row").alias("i"), F.col("col").alias("j"), F.round("v", 6).alias("v"))


_BOXES = "SELECT c_custkey AS id, -170 + (c_custkey % 330) AS w, -80 + (c_custkey % 150) AS s, 2 + c_custkey % 7 AS size FROM customer"


def _boxes(t):
    return t.read("customer").selectExpr("c_custkey AS id", "CAST(-170 + c_custkey % 330 AS DOUBLE) AS w", "CAST(-80 + c_custkey % 150 AS DOUBLE) AS s", "CAST(2 + c_custkey % 7 AS DOUBLE) AS size")


@query("f30_tms_tiles", f"SELECT id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM ({_BOXES}), LATERAL (SELECT unnest(range(CAST(floor((w + 180) / 11.25::DOUBLE) AS BIGINT), CAST(ceil((w + size + 180) / 11.25::DOUBLE) AS BIGINT))) AS x), LATERAL (SELECT unnest(range(CAST(floor((s + 90) / 11.25::DOUBLE) AS BIGINT), CAST(ceil((s + size + 90) / 11.25::DOUBLE) AS BIGINT))) AS y)")
def tms(t):
    tiles = R.tms_tiles(F.lit(4), F.col("w"), F.col("s"), F.col("w") + F.col("size"), F.col("s") + F.col("size"))
    return _boxes(t).select("id", F.explode(tiles).alias("t")).select("id", "t.x", "t.y")


@query("f31_mercator_bounds", "SELECT c_custkey AS id, round(x / 64 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64)))), 6) AS south, round(degrees(atan(sinh(pi() * (1 - 2 * y / 64)))), 6) AS north FROM (SELECT c_custkey, CAST(c_custkey % 64 AS DOUBLE) AS x, CAST(c_custkey % 61 AS DOUBLE) AS y FROM customer)")
def mercator_bounds(t):
    w, s, _, n = G.tile_bounds_mercator(F.lit(6), (F.col("c_custkey") % 64).cast("double"), (F.col("c_custkey") % 61).cast("double"))
    return t.read("customer").select(F.col("c_custkey").alias("id"), F.round(w, 6).alias("west"), F.round(s, 6).alias("south"), F.round(n, 6).alias("north"))


@query("f32_mercator_unit", f"SELECT id, round((w + 180) / 360::DOUBLE, 9) AS mx, round((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2, 9) AS my FROM ({_BOXES})")
def mercator_unit(t):
    x, y = G.mercator_unit(F.col("s"), F.col("w"))
    return _boxes(t).select("id", F.round(x, 9).alias("mx"), F.round(y, 9).alias("my"))


@query("f33_required_dems", f"SELECT id, CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon FROM (SELECT id, w + 0.5 AS w, s + 0.5 AS s, size FROM ({_BOXES})), LATERAL (SELECT unnest(range(CAST(floor(s) AS BIGINT), CAST(ceil(s + size) AS BIGINT))) AS lat), LATERAL (SELECT unnest(range(CAST(floor(w) AS BIGINT), CAST(ceil(w + size) AS BIGINT))) AS lon)")
def dems(t):
    b = _boxes(t).selectExpr("id", "w + 0.5 AS w", "s + 0.5 AS s", "size")
    tiles = T.required_dems(F.col("s"), F.col("s") + F.col("size"), F.col("w"), F.col("w") + F.col("size"))
    return b.select("id", F.explode(tiles).alias("t")).select("id", "t.lat", "t.lon")


@query("f34_tile_names", f"SELECT id, CASE WHEN s >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(s) AS VARCHAR), 2, '0') || CASE WHEN w >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(w) AS VARCHAR), 3, '0') AS name FROM ({_BOXES})")
def tile_names(t):
    return _boxes(t).select("id", T.tile_name(F.col("s"), F.col("w")).alias("name"))


@query("f35_dem_coverage", f"SELECT b.id, f.n_nationkey IS NOT NULL AS available FROM ({_BOXES}) b LEFT JOIN nation f ON f.n_nationkey = b.s")
def coverage(t):
    files = t.read("nation").select(F.col("n_nationkey").cast("double").alias("s"))
    return T.with_availability(_boxes(t), files, ["s"]).select("id", "available")


@query("f36_orthometric", "SELECT point_id, round(z + coalesce(g.v, 0), 6) AS h FROM points p LEFT JOIN raster g ON g.row = CAST(ceil(y) AS INT) - 1 AND g.col = CAST(floor(x) AS INT)")
def orthometric(t):
    return T.orthometric(t.points, t.raster).select("point_id", F.round("h", 6).alias("h"))


@query("f37_overview_choice", "SELECT p_partkey, CAST(max(l) AS INT) AS level FROM part, range(8) t(l) WHERE pow(2, l) * 0.5 <= greatest(p_size, 1) GROUP BY 1")
def overview_choice(t):
    return t.read("part").select("p_partkey", T.coarsest_level(0.5, F.greatest("p_size", F.lit(1)), 8).alias("level"))


@query("f38_grid_size", "SELECT CAST(z AS INT) AS z, CASE WHEN z < 6 THEN 16 WHEN z < 10 THEN 32 WHEN z < 14 THEN 64 ELSE 65 END AS size FROM range(20) t(z)")
def grid_size(t):
    z = F.col("id").cast("int")
    return t.spark.range(20).select(z.alias("z"), T.grid_side(z).alias("size"))


@query("f39_availability", "SELECT CAST(z AS INT) AS z, CAST(pow(2, z + 1) - 1 AS BIGINT) AS last_x, CAST(pow(2, z) - 1 AS BIGINT) AS last_y FROM range(12) t(z)")
def availability(t):
    return T.full_availability(t.spark, 12)


@query("f40_stretch", "SELECT row, col, CAST(round(255 * least(greatest((v - lo) / (hi - lo), 0), 1)) AS INT) AS channel FROM raster, (SELECT min(v) AS lo, max(v) AS hi FROM raster) WHERE v IS NOT NULL")
def stretch(t):
    ends = t.raster.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return t.raster.where("v is not null").join(F.broadcast(ends)).select("row", "col", F.round(255 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).cast("int").alias("channel"))


@query("f42_max_zoom", "SELECT p_partkey, CAST(ceil(log2(360 / 256.0::DOUBLE / (p_retailprice / 1e6))) AS BIGINT) AS zoom FROM part")
def max_zoom(t):
    return t.read("part").select("p_partkey", T.max_zoom(F.col("p_retailprice") / 1e6).alias("zoom"))


@query("f43_bundle_levels", "SELECT z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT CAST(l AS INT) AS z, CAST(floor(x) AS BIGINT) >> CAST(l AS INT) AS x, CAST(floor(y) AS BIGINT) >> CAST(l AS INT) AS y FROM points, range(5) t(l)) GROUP BY 1")
def bundle(t):
    return T.availability(t.points.select(F.floor("x").alias("x"), F.floor("y").alias("y")), 5)


@query("f44_deepest_level", "SELECT p_partkey, CAST(min(l) AS INT) AS level FROM part, range(24) t(l) WHERE 180 / pow(2, l) / 64 <= p_retailprice / 1e5 GROUP BY 1")
def deepest(t):
    return t.read("part").select("p_partkey", T.deepest_level(F.col("p_retailprice") / 1e5).alias("level"))


@query("f45_outer_samples", f"SELECT id, round(w + size / 200.0::DOUBLE, 6) AS west, round(w + size - size / 200.0::DOUBLE, 6) AS east FROM ({_BOXES})")
def outer_samples(t):
    west, east = T.outer_samples(F.col("w"), F.col("w") + F.col("size"), 100)
    return _boxes(t).select("id", F.round(west, 6).alias("west"), F.round(east, 6).alias("east"))


@query("f46_mercator_extent", f"SELECT id, round(min(radians(lon) * 6378137), 3) AS x0, round(max(6378137 * ln(tan(pi() / 4 + radians(lat) / 2))), 3) AS y1 FROM (SELECT id, w + size * k / 32.0::DOUBLE AS lon, s + size AS lat FROM ({_BOXES}), range(33) t(k) UNION ALL SELECT id, w, s + size * k / 32.0::DOUBLE FROM ({_BOXES}), range(33) t(k)) GROUP BY 1")
def extent(t):
    k = F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k")
    b = _boxes(t).select("*", k)
    f = F.col("size") * F.col("k") / 32
    ring = b.select("id", (F.col("w") + f).alias("lon"), (F.col("s") + F.col("size")).alias("lat")).union(b.select("id", "w", F.col("s") + f))
    x, y = G.mercator(F.col("lat"), F.col("lon"))
    return ring.groupBy("id").agg(F.round(F.min(x), 3).alias("x0"), F.round(F.max(y), 3).alias("y1"))


@query("f48_path_bounds", "SELECT c_nationkey, round(min(c_acctbal), 6) AS low, round(max(c_acctbal), 6) AS high, min(c_acctbal) >= -90 AND max(c_acctbal) <= 90 AS on_globe FROM customer GROUP BY 1")
def path_bounds(t):
    return T.path_bounds(t.read("customer"), "c_nationkey", "c_acctbal").withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("k06_zigzag", "SELECT point_id, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS code FROM (SELECT point_id, q - lag(q, 1, 0) OVER (PARTITION BY cls ORDER BY point_id) AS d FROM (SELECT point_id, cls, CAST(trunc(x / 100 * 32767) AS BIGINT) AS q FROM points))")
def zigzag(t):
    from pyspark.sql import Window

    q = t.points.select("point_id", "cls", (F.col("x") / 100 * 32767).cast("long").alias("q"))
    d = F.col("q") - F.lag("q", 1, 0).over(Window.partitionBy("cls").orderBy("point_id"))
    return q.withColumn("d", d).select("point_id", R.zigzag(F.col("d")).alias("code"))


@query("k10_terrain_rgb", "SELECT row, col, (n >> 16) & 255 AS r, (n >> 8) & 255 AS g, n & 255 AS b FROM (SELECT row, col, CAST(least(greatest(round((coalesce(v, 0) + 10000) / 0.1::DOUBLE), 0), 16777215) AS BIGINT) AS n FROM raster)")
def rgb(t):
    r, g, b = R.terrain_rgb(F.col("v"))
    return t.raster.select("row", "col", r.alias("r"), g.alias("g"), b.alias("b"))


@query("k11_raster_colours", "SELECT row, col, coalesce(CAST(trunc(255 * least(greatest((v - 90) / 60, 0), 1)) AS INT), 0) AS r, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS a FROM raster")
def raster_colours(t):
    return t.raster.select("row", "col", T.ramp(F.col("v"), 90.0, 150.0).alias("r"), T.opacity(F.col("v")).alias("a"))


@query("k16_static_map_pixels", f"SELECT id, CAST(trunc((w + 180) / 360.0::DOUBLE * 512) AS INT) AS px, CAST(trunc((90 - s) / 180.0::DOUBLE * 256) AS INT) AS py FROM ({_BOXES})")
def pixels(t):
    x, y = T.pixel_of(F.col("s"), F.col("w"), 512, 256)
    return _boxes(t).select("id", x.alias("px"), y.alias("py"))


@query("k20_tile_limits", f"SELECT id, CAST(floor((w + 180) / 360.0::DOUBLE * 64) AS BIGINT) AS min_col, CAST(floor((w + size + 180) / 360.0::DOUBLE * 64) AS BIGINT) AS max_col FROM ({_BOXES})")
def limits(t):
    first, last = T.tile_columns(F.col("w"), F.col("w") + F.col("size"), 6)
    return _boxes(t).select("id", first.alias("min_col"), last.alias("max_col"))


_GRIDSQL = "SELECT CAST(a AS BIGINT) * 16 + b AS id, 3 + a * 2.5::DOUBLE AS fr, 2 + b * 2.2::DOUBLE AS fc FROM range(16) t(a), range(16) u(b)"


@query("f09_dem_over_bbox", "SELECT id, CASE WHEN count(*) FILTER (r.v IS NULL) = 0 THEN round(sum(coalesce(r.v, 0) * w), 6) END AS v FROM (" + " UNION ALL ".join(f"SELECT id, floor(fr) + {r} AS row, floor(fc) + {c} AS col, ({'fr - floor(fr)' if r else '1 - (fr - floor(fr))'}) * ({'fc - floor(fc)' if c else '1 - (fc - floor(fc))'}) AS w FROM ({_GRIDSQL})" for r in (0, 1) for c in (0, 1)) + ") k LEFT JOIN raster r ON r.row = k.row AND r.col = k.col GROUP BY 1")
def dem_over_bbox(t):
    grid = t.spark.range(256).selectExpr("id", "3 + (id div 16) * 2.5D AS fr", "2 + (id % 16) * 2.2D AS fc")
    return R.sampled(grid, t.raster).withColumn("v", F.round("v", 6))


@query("f27_reproject")
def reproject(t):
    cells = t.spark.range(400).selectExpr("id", "CAST(id div 20 AS DOUBLE) AS r", "CAST(id % 20 AS DOUBLE) AS c")
    lat, lon = G.from_mercator(F.col("c") * 200_000, F.col("r") * 200_000)
    return R.sampled(cells.select("id", F.abs(lat).alias("fr"), F.abs(lon).alias("fc")), t.raster, ignore_weightless=True).withColumn("v", F.round("v", 6))


@query("f41_level_for", "SELECT p_partkey, CAST(coalesce(max(l), 0) AS INT) AS level FROM part LEFT JOIN range(6) t(l) ON pow(2, l) <= p_size / 4.0::DOUBLE GROUP BY 1")
def level_for(t):
    return t.read("part").select("p_partkey", F.coalesce(T.coarsest_level(1.0, F.col("p_size") / 4, 6), F.lit(0)).alias("level"))


@query("f47_level_scales", "SELECT p_partkey, CAST(l AS INT) AS level, round(p_retailprice / ceil(p_retailprice / pow(2, l)), 6) AS scale FROM part, range(4) t(l)")
def level_scales(t):
    rows = t.read("part").select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    return rows.select("p_partkey", "level", F.round(T.level_scale(F.col("p_retailprice"), F.col("level")), 6).alias("scale"))


@query("k08_terrain_pyramid", "SELECT CAST(z AS INT) AS z, CAST(col // CAST(pow(2, 5 - z) AS INT) AS INT) AS x, CAST(row // CAST(pow(2, 5 - z) AS INT) AS INT) AS y, count(v) AS cells, round(avg(v), 6) AS mean FROM raster, range(6) t(z) GROUP BY 1, 2, 3")
def pyramid(t):
    return T.pyramid(t.raster, 6).withColumn("mean", F.round("mean", 6))


@query("k09_dem_bundle_level", "SELECT CAST(min(l) AS INT) AS deepest FROM range(24) t(l) WHERE 180 / pow(2, l) / 64 <= 0.01")
def bundle_level(t):
    return t.spark.range(1).select(T.deepest_level(0.01).alias("deepest"))
