"""Source and sink queries (S and K rows): files made from the tables, read back and compared with them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quarrystone.operators import catalog as I
from quarrystone.operators import sinks as K
from quarrystone.operators import terrain as T
from quarrystone.operators import tiling as C
from quarrystone.plans.registry import query
from quarrystone.sources import formats
from quarrystone.sources import readers as S

_SUMS = "count(*) AS n, round(sum(x), 2) AS sx, round(sum(y), 2) AS sy, round(sum(z), 2) AS sz"


def _sums(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.sum(a), 2).alias(f"s{a}") for a in "xyz"])


@query("s02_las", f"SELECT CAST(cls AS VARCHAR) AS path, cls, {_SUMS}, CAST(sum(intensity) AS BIGINT) AS si FROM points GROUP BY 1, 2")
def las(t):
    rows = S.las(K.las_files(K.bounded(t.points, "cls"), "file")).withColumn("path", F.substring_index("path", "-", 1))
    return rows.groupBy("path", "cls").agg(F.count("*").alias("n"), *[F.round(F.sum(a), 2).alias(f"s{a}") for a in "xyz"], F.sum("intensity").alias("si"))


@query("s04_ply", f"SELECT CAST(cls AS VARCHAR) AS path, {_SUMS} FROM points GROUP BY 1")
def ply(t):
    return _sums(S.ply(K.ply_files(K.bounded(t.points, "cls"), "file")).withColumn("path", F.substring_index("path", "-", 1)), "path")


#: The raster in tiles of 40 rows; cells beyond it are voids of its last file.
_TILED = "SELECT CAST(row // 40 AS INT) AS tile, CAST(row % 40 AS INT) AS row, col, round(v) AS v FROM raster WHERE v IS NOT NULL"


def _tiles(t):
    return t.raster.select(F.expr("CAST(row div 40 AS INT)").alias("tile"), (F.col("row") % 40).alias("row"), "col", "v")


def _heights(rows):
    return rows.where("v is not null").select(F.regexp_extract("path", "([0-9]+)[.]", 1).cast("int").alias("tile"), "row", "col", "v")


@query("s08_hgt", _TILED)
def hgt(t):
    return _heights(S.hgt(K.hgt_files(_tiles(t), "tile")))


@query("s09_dted", _TILED)
def dted(t):
    return _heights(S.dted(K.dted_files(_tiles(t), "tile")))


_TRI = "SELECT mesh_id || '{}' AS path, count(*) AS n, round(sum(ux + vx + wx), 1) AS sx, round(sum(uz + vz + wz), 1) AS sz FROM triangles GROUP BY 1"


def _tri(df):
    return df.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum(F.col("ux") + F.col("vx") + F.col("wx")), 1).alias("sx"), F.round(F.sum(F.col("uz") + F.col("vz") + F.col("wz")), 1).alias("sz"))


@query("s13_obj", _TRI.format(".obj"))
def obj(t):
    return _tri(S.obj_triangles(K.obj_parts(t.triangles)).withColumn("path", F.regexp_replace("path", "-[0-9]+[.]obj$", ".obj")))


@query("s14_glb", _TRI.format(".glb"))
def glb(t):
    return _tri(S.glb(K.glb_files(t.triangles)))


@query("s17_dxf", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(n_nationkey AS DOUBLE) AS x0, CAST(n_nationkey + 2 AS DOUBLE) AS x2, 1.5::DOUBLE AS z3 FROM nation")
def dxf(t):
    corner = lambda k, x, y, z: f"'{10 + k}\\n', {x}, '\\n{20 + k}\\n', {y}, '\\n{30 + k}\\n', {z}, '\\n'"
    text = "concat('0\\nSECTION\\n2\\nENTITIES\\n0\\n3DFACE\\n8\\nwall\\n', " + ", ".join(corner(k, f"n_nationkey + {k}", k, "1.5D") for k in range(4)) + ", '0\\nENDSEC\\n0\\nEOF\\n')"
    files = t.read("nation").selectExpr("CAST(n_nationkey AS STRING) AS path", f"{text} AS text")
    return S.dxf_faces(files).select("path", "x0", "x2", "z3")


@query("s19_cityjson", "SELECT CAST(n_nationkey AS VARCHAR) AS path, 'b' AS object, 0 AS surface, 10 + n_nationkey * 0.5::DOUBLE AS x1, CAST(3 AS BIGINT) AS n FROM nation")
def cityjson(t):
    text = """concat('{"transform":{"scale":[0.5,0.5,0.5],"translate":[10,0,0]},"vertices":[[0,0,0],[', n_nationkey, ',0,0],[0,4,0]],"CityObjects":{"b":{"type":"Building","geometry":[{"type":"MultiSurface","boundaries":[[[0,1,2]]]}]}}}')"""
    files = t.read("nation").selectExpr("CAST(n_nationkey AS STRING) AS path", f"{text} AS text")
    return S.cityjson_surfaces(files).select("path", "object", "surface", F.col("ring")[1]["x"].alias("x1"), F.size("ring").cast("long").alias("n"))


_IFC = """concat('#1=IFCBUILDINGSTOREY(''S', n_nationkey, ''',$,''Level''); #2=IFCWALL(''W', n_nationkey, ''',$,''Wall, (north)'',$);
#3=IFCRELCONTAINEDINSPATIALSTRUCTURE(''R'',$,$,$,(#2),#1); #4=IFCPROPERTYSINGLEVALUE(''Length'',$,IFCREAL(', n_nationkey, '.5),$);
#5=IFCPROPERTYSET(''P'',$,''Qto'',$,(#4)); #6=IFCRELDEFINESBYPROPERTIES(''D'',$,$,$,(#2),#5);')"""


def _ifc(t):
    return S.step_entities(t.read("nation").selectExpr("CAST(n_nationkey AS STRING) AS path", f"{_IFC} AS text"))


@query("s21_ifc_elements", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(2 AS BIGINT) AS express_id, 'W' || n_nationkey AS global_id, 'Wall, (north)' AS name, CAST(1 AS BIGINT) AS parent_express_id FROM nation")
def ifc(t):
    return S.ifc_elements(_ifc(t), ["IFCWALL"]).select("path", "express_id", "global_id", "name", "parent_express_id")


@query("s21_ifc_properties", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(2 AS BIGINT) AS express_id, 'Qto.Length' AS key, n_nationkey + 0.5::DOUBLE AS value_number FROM nation")
def ifc_properties(t):
    return S.ifc_properties(_ifc(t)).select("path", "express_id", "key", "value_number")


@query("s24_topojson", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(3 AS BIGINT) AS n, CAST(20 + n_nationkey AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS x2 FROM nation")
def topojson(t):
    text = """concat('{"transform":{"scale":[1,1],"translate":[0,0]},"arcs":[[[0,0],[10,0]],[[10,0],[', 10 + n_nationkey, ',5]]],"objects":{"a":{"type":"LineString","arcs":[-2,-1]}}}')"""
    files = t.read("nation").selectExpr("CAST(n_nationkey AS STRING) AS path", f"{text} AS text")
    c = F.col("coordinates")
    return S.topojson_lines(files).select("path", F.size(c).cast("long").alias("n"), c[0]["x"].alias("x0"), c[2]["x"].alias("x2"))


@query("s25_window", "SELECT CAST(a AS INT) AS row, CAST(b AS INT) AS col, round(v, 6) AS v FROM range(45, 55) t(a), range(30, 45) u(b) LEFT JOIN raster r ON r.row = a AND r.col = b")
def window(t):
    return T.window(t.raster, 45, 30, 10, 15).withColumn("v", F.round("v", 6))


@query("s26_datasets", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1")
def datasets(t):
    return I.dataset_statistics(t.read("part"), "p_brand", "p_size")


@query("s27_overpass", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(7 AS BIGINT) AS way, CAST(4 AS BIGINT) AS n, CAST(n_nationkey AS DOUBLE) AS x0 FROM nation WHERE n_nationkey % 3 <> 0")
def overpass(t):
    text = """concat('{"elements":[{"type":"node","id":1,"lat":0,"lon":', n_nationkey, '},{"type":"node","id":2,"lat":1,"lon":0},{"type":"node","id":3,"lat":1,"lon":1},{"type":"way","id":7,"nodes":[1,2,3,', CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END, '],"tags":{"building":"yes"}}]}')"""
    files = t.read("nation").selectExpr("CAST(n_nationkey AS STRING) AS path", f"{text} AS text")
    return S.overpass_buildings(files).select("path", "way", F.size("ring").cast("long").alias("n"), F.col("ring")[0]["x"].alias("x0"))


@query("s28_stac_search", "SELECT point_id FROM points WHERE x BETWEEN 10 AND 60 AND y BETWEEN 5 AND 70 AND observed >= TIMESTAMP '1997-01-01' AND cls IN (2, 5) ORDER BY point_id LIMIT 10")
def stac(t):
    items = t.points.select(F.col("point_id").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("observed").alias("datetime"), F.col("cls").cast("string").alias("collection"))
    return I.search_items(items, (10, 5, 60, 70), ("1997-01-01", None), ["2", "5"]).select(F.col("id").alias("point_id"))


@query("s29_get_tile", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 8 = 3 AND event_id % 8 = 5")
def get_tile(t):
    tiles = t.read("events").selectExpr("event_id", "event_type AS source", "3 AS z", "user_id % 8 AS x", "event_id % 8 AS y")
    return I.get_tile(tiles, "view", 3, 3, 5).select("event_id")


@query("s30_tile_store", "SELECT count(*) AS n, CAST(sum(length(k)) AS BIGINT) AS bytes FROM (SELECT replace('3/' || user_id || '/../' || event_id, '..', '') AS k FROM events) WHERE starts_with(k, '3/1')")
def tile_store(t):
    blobs = t.read("events").select(F.concat(F.lit("3/"), "user_id", F.lit("/../"), "event_id").alias("key"))
    return I.listed(I.stored(blobs), "3/1").agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("bytes"))


@query("s33_open_data", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def open_data(t):
    return I.catalogue(t.read("nation").select("n_name", F.col("n_regionkey").alias("category")), 2).select("n_name")


def _tree(t):
    return C.octree(t.points, 500, 4, 0.0)


@query("k01_point_tiles", f"SELECT count(*) AS n, {_SUMS.split(', ', 1)[1].replace(', 2)', ', 1)')} FROM points")
def point_tiles(t):
    def run(batches):
        for b in batches:
            for content in b["content"]:
                xyz, _ = formats.read_pnts(bytes(content))
                yield pd.DataFrame(xyz, columns=["x", "y", "z"])

    rows = K.point_tiles(_tree(t)).mapInPandas(run, "x double, y double, z double")
    return rows.agg(F.count("*").alias("n"), *[F.round(F.sum(a), 1).alias(f"s{a}") for a in "xyz"])


@query("k05_subtrees")
def subtrees(t):
    return C.implicit_cells(t.points, 5).groupBy("level").agg(K.subtree_json().alias("json"))


@query("k07_quantized_mesh", "SELECT CAST(sum(h * w) AS BIGINT) AS n, round(sum(sv), -2) AS sv FROM (SELECT max(row % 40) + 1 AS h, max(col) + 1 AS w, sum(coalesce(v, 0)) AS sv FROM raster GROUP BY row // 40)")
def quantized(t):
    def run(batches):
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame({"v": formats.read_quantized_mesh(bytes(content))["height"]})

    return K.quantized_tiles(_tiles(t), "tile").mapInPandas(run, "v double").agg(F.count("*").alias("n"), F.round(F.sum("v"), -2).alias("sv"))


@query("k12_export_obj", "SELECT mesh_id || '.obj' AS path, CAST(4 * count(*) AS BIGINT) AS lines FROM triangles GROUP BY 1")
def export_obj(t):
    path = F.regexp_replace("path", "-[0-9]+[.]obj$", ".obj").alias("path")
    return K.obj_parts(t.triangles).groupBy(path).agg(F.sum(F.size(F.split("text", "\n")).cast("long")).alias("lines"))


@query("k13_las_scale", "SELECT cls, round(greatest(max(x) - min(x), 1) / 2e9 * 1e9, 6) AS scale, min(x) AS low FROM points GROUP BY 1")
def las_scale(t):
    return t.points.groupBy("cls").agg(F.round(K.las_scale(F.min("x"), F.max("x")) * 1e9, 6).alias("scale"), F.min("x").alias("low"))


def _texts(t, text: str):
    return t.read("nation").selectExpr("CAST(n_nationkey AS STRING) AS path", f"{text} AS text")


@query("s10_usgs_dem", "SELECT CAST(n_nationkey AS VARCHAR) AS path, 1 AS profile, CAST(i AS INT) AS place, CASE WHEN i < 2 THEN CAST(n_nationkey + i AS DOUBLE) END AS v FROM nation, range(3) t(i)")
def usgs(t):
    block = "concat(lpad('1', 6), lpad('1', 6), lpad('3', 6), lpad('1', 6), repeat(' ', 120), lpad(CAST(n_nationkey AS STRING), 6), lpad(CAST(n_nationkey + 1 AS STRING), 6), '-32767')"
    return S.usgs_dem(_texts(t, f"rpad(concat(repeat(' ', 1024), {block}), 2048)"))


@query("s16_collada", "SELECT CAST(n_nationkey AS VARCHAR) AS path, 'p' AS source, CAST(n_nationkey + 6 AS DOUBLE) AS total FROM nation")
def collada(t):
    rows = S.collada_meshes(_texts(t, """concat('<source><float_array id="p" count="4">', n_nationkey, ' 1 2 3</float_array></source>')"""))
    return rows.select("path", "source", F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("s18_citygml", "SELECT CAST(n_nationkey AS VARCHAR) AS path, 0 AS ring, CAST(4 AS BIGINT) AS n, CAST(n_nationkey AS DOUBLE) AS x1 FROM nation")
def citygml(t):
    rows = S.citygml_rings(_texts(t, "concat('<bldg:Building><gml:exterior><gml:LinearRing><gml:posList>0 0 0 ', n_nationkey, ' 0 0 1 1 0 0 0 0</gml:posList></gml:LinearRing></gml:exterior></bldg:Building>')"))
    return rows.select("path", "ring", F.size("places").cast("long").alias("n"), F.col("places")[1]["x"].alias("x1"))


@query("s32_crs", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CASE WHEN n_nationkey % 2 = 0 THEN CAST(32600 + n_nationkey AS INT) END AS epsg FROM nation")
def crs(t):
    return S.detected_crs(_texts(t, """CASE WHEN n_nationkey % 2 = 0 THEN concat('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","', 32600 + n_nationkey, '"]]') ELSE 'LOCAL_CS["z"]' END"""))


@query("s34_world_files", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(0.5 AS DOUBLE) AS size_x, CAST(n_nationkey AS DOUBLE) AS x FROM nation")
def world(t):
    return S.world_files(_texts(t, "concat('0.5\\n0\\n0\\n-0.5\\n', n_nationkey, '\\n50\\n')")).select("path", "size_x", "x")


@query("k02_tileset")
def tileset_document(t):
    low, high = C.bounds(t.points)
    return K.tileset_files(C.node_table(_tree(t)).select("node", "is_leaf"), low, high).select("path", F.decode("content", "UTF-8").alias("text"))


def _geotiffs(t):
    return K.geotiff_files(t.raster.withColumn("tile", F.expr("CAST(row div 40 AS INT)")), "tile", 10.0, 50.0, 0.5, 4326)


@query("s07_geotiff", "SELECT CAST(row // 40 AS INT) AS tile, CAST(row % 40 AS INT) AS row, col, round(v, 2) AS v FROM raster WHERE v IS NOT NULL")
def read_geotiff(t):
    return _heights(S.tiff(_geotiffs(t))).withColumn("v", F.round("v", 2))


@query("s07_geotiff_place", "SELECT CAST(row // 40 AS INT) AS tile, 4326 AS epsg, round(min(10 + col * 0.5), 6) AS west, round(max(50 - row * 0.5), 6) AS north FROM raster GROUP BY 1")
def geotiff_place(t):
    own = _geotiffs(t)
    rows = S.file_crs(own).join(S.georeferences(own), "path")
    return rows.select(F.regexp_extract("path", "([0-9]+)[.]", 1).cast("int").alias("tile"), "epsg", F.round("west", 6).alias("west"), F.round("north", 6).alias("north"))


@query("k15_dxf_lines", "SELECT p_brand || '.dxf' AS path, CAST(12 * count(*) + 9 AS BIGINT) AS lines FROM part GROUP BY 1")
def dxf_lines(t):
    lines = t.read("part").selectExpr("p_brand AS layer", "CAST(p_size AS DOUBLE) AS x1", "CAST(p_partkey AS DOUBLE) AS y1", "p_size + 1D AS x2", "p_partkey + 2D AS y2")
    return K.dxf_text(lines).select("path", F.size(F.split("text", "\n")).cast("long").alias("lines"))
