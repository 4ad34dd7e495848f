"""Queries over folders of files: they are written to the shared folder, found and read again by their extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import change as D
from quarrystone.operators import classify as Y
from quarrystone.operators import elements as E
from quarrystone.operators import geometry as V
from quarrystone.operators import raster as R
from quarrystone.operators import sinks as K
from quarrystone.operators import terrain as T
from quarrystone.operators.lineage import shared_folder
from quarrystone.plans.classify import _CLASS, _codes
from quarrystone.plans.elements import _STATS, _flat
from quarrystone.plans.files import _geotiffs, _tiles
from quarrystone.plans.geostat import _BOX, _OVER, _pairs
from quarrystone.plans.registry import query
from quarrystone.plans.tiling import _DEPTH, _MAX, _TREE
from quarrystone.sources import formats, plugin
from quarrystone.sources import readers as S

_SUMS = "count(*) AS n, round(sum(x), 2) AS sx, round(sum(y), 2) AS sy, round(sum(z), 2) AS sz"


def _sums(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.sum(a), 2).alias(f"s{a}") for a in "xyz"])


def _extension(path="path"):
    return F.regexp_extract(path, "[.]([a-z0-9]+)$", 1)


@query("s01_read_point_cloud", f"SELECT kind, CAST(cls AS INT) AS cls, {_SUMS} FROM points, (VALUES ('las'), ('ply')) k(kind) GROUP BY 1, 2")
def point_cloud(t):
    own = K.bounded(t.points, "cls")
    folder = K.put(K.las_files(own, "file").union(K.ply_files(own, "file")), shared_folder(t.spark))
    rows = S.read_point_cloud(t.spark, folder).withColumn("kind", _extension())
    return _sums(rows.withColumn("cls", F.regexp_extract("path", "([0-9]+)-[0-9]+[.]", 1).cast("int")), "kind", "cls")


_SPLATS = "SELECT p_partkey AS n, p_brand AS scene, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 100 AS DOUBLE) AS y, CAST(p_partkey % 7 AS DOUBLE) AS z, CAST(p_size % 5 AS DOUBLE) AS opacity FROM part"


@query("s05_read_splats", f"SELECT scene, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(opacity) AS so FROM ({_SPLATS}) GROUP BY 1")
def splats(t):
    p = t.read("part").selectExpr("p_partkey AS n", "p_brand AS scene", "CAST(p_size AS DOUBLE) AS x", "CAST(p_partkey % 100 AS DOUBLE) AS y", "CAST(p_partkey % 7 AS DOUBLE) AS z", "CAST(p_size % 5 AS DOUBLE) AS opacity")
    p = p.withColumns({c: F.lit(0.5) for c in formats.SPLAT if c not in ("x", "y", "z", "opacity")})
    rows = S.read_splats(t.spark, K.put(K.splat_files(p, "scene"), shared_folder(t.spark)), 1 << 30)
    scene = F.url_decode(F.regexp_extract("path", "([^/]+)[.]ply$", 1)).alias("scene")
    return rows.groupBy(scene).agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{b}") for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("opacity", "o"))])


@query("s06_read_heightmap", "SELECT kind, CAST(row // 40 AS INT) AS tile, CAST(row % 40 AS INT) AS row, col, round(v) AS v FROM raster, (VALUES ('hgt'), ('dt1'), ('tif')) k(kind) WHERE v IS NOT NULL")
def heightmap(t):
    own = K.hgt_files(_tiles(t), "tile").union(K.dted_files(_tiles(t), "tile")).union(_geotiffs(t))
    rows = S.read_heightmap(t.spark, K.put(own, shared_folder(t.spark)))
    return rows.where("v is not null").select(_extension().alias("kind"), F.regexp_extract("path", "([0-9]+)[.]", 1).cast("int").alias("tile"), "row", "col", F.round("v").alias("v"))


#: The raster, in quarters of a metre (exact in a file's floats), in tiles of 40 rows as whole grids, and their voids filled
#: from the four cells beside.
_DEM = """WITH grid AS (SELECT tile, r.i AS row, c.i AS col FROM (SELECT row // 40 AS tile, max(row % 40) AS rows, max(col) AS cols FROM raster GROUP BY 1), range(40) r(i), range(40) c(i) WHERE r.i <= rows AND c.i <= cols),
cells AS (SELECT g.tile, g.row, g.col, floor(r.v * 4) / 4 AS v FROM grid g LEFT JOIN raster r ON r.row = g.tile * 40 + g.row AND r.col = g.col)
SELECT round(50 - (a.tile * 40 + a.row + 0.5) * 0.5, 6) AS lat, round(10 + (a.col + 0.5) * 0.5, 6) AS lon, round(coalesce(any_value(a.v), avg(b.v)), 4) AS v
FROM cells a LEFT JOIN cells b ON b.tile = a.tile AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY a.tile, a.row, a.col"""


@query("s11_read_dem_wgs84", _DEM)
def dem_wgs84(t):
    quarters = t.raster.withColumn("v", F.floor(F.col("v") * 4) / 4).withColumn("tile", F.expr("CAST(row div 40 AS INT)"))
    folder = K.put(K.geotiff_files(quarters, "tile", 10.0, 50.0, 0.5, 4326), shared_folder(t.spark))
    rows = S.read_dem_wgs84(t.spark, folder, rings=1)
    return rows.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("v", 4).alias("v"))


@query("s12_read_mesh", "SELECT kind, mesh_id, count(*) AS n, round(sum(ux + vx + wx), 1) AS sx, round(sum(uz + vz + wz), 1) AS sz FROM triangles, (VALUES ('glb'), ('obj')) k(kind) GROUP BY 1, 2")
def mesh(t):
    text = K.obj_parts(t.triangles).select("path", F.encode("text", "UTF-8").alias("content"))
    rows = S.read_mesh(t.spark, K.put(K.glb_files(t.triangles).union(text), shared_folder(t.spark)))
    name = F.url_decode(F.regexp_extract("path", "([^/]+?)(-[0-9]+)?[.][a-z]+$", 1)).alias("mesh_id")
    return rows.groupBy(_extension().alias("kind"), name).agg(F.count("*").alias("n"), *[F.round(F.sum(sum((F.col(c + a) for c in "vw"), F.col("u" + a))), 1).alias("s" + a) for a in "xz"])


@query("s35_format_plugins", f"SELECT CAST(cls AS INT) AS cls, {_SUMS}, CAST(sum(intensity) AS BIGINT) AS si FROM points GROUP BY 1")
def plugins(t):
    plugin.register(t.spark)
    folder = shared_folder(t.spark)
    rows = t.points.select(F.lit("").alias("path"), "x", "y", "z", F.col("cls").cast("int").alias("cls"), "intensity")
    rows.write.format("las_points").mode("append").save(folder)
    return t.spark.read.format("las_points").load(folder).groupBy("cls").agg(F.count("*").alias("n"), *[F.round(F.sum(a), 2).alias(f"s{a}") for a in "xyz"], F.sum("intensity").alias("si"))


@query("k17_insert_properties", "SELECT element_row, count(*) AS n, count(DISTINCT key) AS keys, round(coalesce(sum(value_number), 0), 4) AS total FROM properties GROUP BY 1")
def insert_properties(t):
    folder = shared_folder(t.spark)
    K.insert_properties(t.properties, folder)
    return t.spark.read.parquet(folder).groupBy("element_row").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.round(F.coalesce(F.sum("value_number"), F.lit(0.0)), 4).alias("total"))


@query("a26_aggregation_keys", f"SELECT k.i AS ordinal, k.key, {_STATS} FROM (VALUES (0, 'Mixed.Value'), (1, 'Acct.Balance')) k(i, key) LEFT JOIN properties p ON p.key = k.key GROUP BY 1, 2")
def aggregation_keys(t):
    return _flat(E.aggregated(t.elements, t.properties, '["Mixed.Value", "Acct.Balance"]'))


@query("c05_tile_point_cloud", _TREE + f"SELECT node, CAST(CASE WHEN is_leaf THEN n ELSE ceil(n / CAST(greatest(least(n // {_MAX}, 64), 8) AS DOUBLE)) END AS BIGINT) AS n, CAST(1 AS BIGINT) AS documents FROM nodes")
def point_cloud_tiles(t):
    folder = shared_folder(t.spark)
    K.tile_point_cloud(t.points, folder, _MAX, _DEPTH).write.format("noop").mode("overwrite").save()
    named = t.spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", "([^/]+)[.](pnts|json)$", 1)
    node = F.when(name.isin("root", "tileset"), "").otherwise(name).alias("node")
    points = S.pnts(named.where("path like '%.pnts'").select("path", "content")).groupBy(node).agg(F.count("*").alias("n"))
    documents = named.where("path like '%.json'").groupBy(node).agg(F.count("*").alias("documents"))
    return points.join(documents, "node", "full")


@query("d04_snapshots", "SELECT epoch, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, CAST(floor(z / 5) AS BIGINT) AS cz, count(*) AS n, round(sum(z), 6) AS sum_z FROM (SELECT 'old' AS epoch, * FROM cells_old UNION ALL SELECT 'new', * FROM cells_new) GROUP BY 1, 2, 3, 4")
def snapshots(t):
    folder = shared_folder(t.spark)
    for epoch, points in (("old", t.cells_old), ("new", t.cells_new)):
        D.saved_snapshot(points, folder, epoch, 5.0)
    old, new = (D.loaded_snapshot(t.spark, folder, e).withColumn("epoch", F.lit(e)) for e in ("old", "new"))
    # heights have six decimals, so have their sums: no rounding hangs on the order of adding
    return old.unionByName(new).select("epoch", "cx", "cy", "cz", "n", F.round(F.col("mean_z") * F.col("n"), 6).alias("sum_z"))


@query("e06_classify_ml", f"SELECT p_partkey, code, 0.7::DOUBLE AS confidence FROM ({_CLASS})")
def classify_ml(t):
    return Y.modelled(_codes(t), ["p_partkey"])


@query("f07_covered_points", "SELECT CAST(row AS BIGINT) * 40 + col AS id, round(v, 6) AS v FROM raster WHERE v IS NOT NULL")
def covered_points(t):
    places = t.raster.where("v is not null").selectExpr("CAST(row AS BIGINT) * 40 + col AS id", "CAST(row AS DOUBLE) AS fr", "CAST(col AS DOUBLE) AS fc")
    return T.refused_without_coverage(R.sampled(places, t.raster, ignore_weightless=True).withColumn("v", F.round("v", 6)))


for _name in ("ndvi", "slope", "hillshade"):
    query(f"f23_analysis_{_name}")(lambda t, op=_name: R.analysis(op.upper(), t.bands if op == "ndvi" else t.raster, 10.0, 50.0, 0.01, 1500.0, since="1998-01-01").withColumn("v", F.round("v", 4)))


_RUN = " UNION ALL ".join(f"SELECT '{op}' AS operation, id, rings AS n, round(CAST({area} AS DOUBLE), 4) AS area FROM ({_OVER})" for op, area in (("union", "2 * own - common"), ("intersection", "common"), ("difference", "own - common")))
_HULL = f"SELECT 'convex_hull', id, CAST(4 AS BIGINT), CAST(w * h AS DOUBLE) FROM ({_BOX}) UNION ALL SELECT 'centroid', id, CAST(1 AS BIGINT), CAST(0 AS DOUBLE) FROM ({_BOX})"


@query("g11_geometry_operations", f"{_RUN} UNION ALL {_HULL}")
def geometry_operations(t):
    out = None
    for name in ("Union", "INTERSECTION", "difference", "Convex_Hull", "centroid"):
        rows = V.processed(_pairs(t), name)
        out = rows if out is None else out.union(rows)
    return out.withColumn("area", F.round("area", 4))
