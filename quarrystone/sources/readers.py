"""Readers: files as DataFrames. Binary files come from Spark's own ``binaryFile`` source, one row a file, and are decoded
in tasks; text formats are read as lines or JSON and taken apart by columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.sources import formats, geotiff

POINTS = "path string, n long, x double, y double, z double, r int, g int, b int, cls int, intensity int"
RASTER = "path string, row int, col int, v double"
#: Points or cells that a task holds before it hands them on.
CHUNK = 200_000


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _decoded(df: DataFrame, decode: Callable[[bytes], dict[str, np.ndarray]], schema: str) -> DataFrame:
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                columns = decode(bytes(content))
                n = len(next(iter(columns.values())))
                for at in range(0, n, CHUNK):
                    yield pd.DataFrame({"path": path, **{c: v[at : at + CHUNK] for c, v in columns.items()}})[names]

    return df.select("path", "content").mapInPandas(run, schema)


def _numbered(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"n": np.arange(len(next(iter(columns.values()))), dtype=np.int64), **columns}


def las(df: DataFrame) -> DataFrame:
    return _decoded(df, lambda data: _numbered(formats.read_las(data)), POINTS)


def ply(df: DataFrame) -> DataFrame:
    def decode(data: bytes) -> dict[str, np.ndarray]:
        v = formats.read_ply(data)
        get = lambda *names: next((v[n] for n in names if n in v.dtype.names), np.zeros(len(v)))
        out = {a: get(a).astype(float) for a in "xyz"}
        out |= {c: get(n, c).astype(np.int32) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"), ("cls", "classification"), ("intensity", "intensity"))}
        return _numbered(out)

    return _decoded(df, decode, POINTS)


def _raster(read: Callable[[bytes], np.ndarray]) -> Callable[[bytes], dict[str, np.ndarray]]:
    def decode(data: bytes) -> dict[str, np.ndarray]:
        v = read(data)
        row, col = (x.ravel().astype(np.int32) for x in np.indices(v.shape))
        return {"row": row, "col": col, "v": v.ravel()}

    return decode


def _void(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def hgt(df: DataFrame) -> DataFrame:
    return _void(_decoded(df, _raster(formats.read_hgt), RASTER))


def dted(df: DataFrame) -> DataFrame:
    return _void(_decoded(df, _raster(formats.read_dted), RASTER))


def glb(df: DataFrame) -> DataFrame:
    """Triangles: path, mesh, tri, and the corners' coordinates."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        parts = []
        for k, (p, i) in enumerate(formats.read_glb(data)):
            t = i[: len(i) // 3 * 3].reshape(-1, 3)
            parts.append(np.column_stack([np.full(len(t), k), np.arange(len(t)), p[t].reshape(len(t), 9)]))
        v = np.concatenate(parts) if parts else np.zeros((0, 11))
        return {"mesh": v[:, 0].astype(np.int32), "tri": v[:, 1].astype(np.int64), **{c + a: v[:, 2 + 3 * j + k] for j, c in enumerate("uvw") for k, a in enumerate("xyz")}}

    return _decoded(df, decode, "path string, mesh int, tri long, " + ", ".join(f"{c}{a} double" for c in "uvw" for a in "xyz"))


def tiff(df: DataFrame) -> DataFrame:
    return _void(_decoded(df, _raster(geotiff.read), RASTER))


_CORNERS = [c + a for c in "uvw" for a in "xyz"]
TRIANGLES = "path string, mesh string, tri long, " + ", ".join(f"{c} double" for c in _CORNERS)


def _text(df: DataFrame) -> DataFrame:
    return df.select("path", F.col("content").cast("string").alias("text"))


def _fans(rings: DataFrame, mesh: Column, ring: Column, number: Column) -> DataFrame:
    """Rings of x, y, z (a closing corner may repeat the first) as triangles about their first corner."""
    own = rings.select("path", mesh.cast("string").alias("mesh"), number.cast("long").alias("n"), ring.alias("r"))
    own = own.withColumn("r", F.when(F.get("r", F.lit(0)) == F.element_at("r", -1), F.slice("r", 1, F.size("r") - 1)).otherwise(F.col("r"))).where(F.size("r") >= 3)
    rows = own.select("path", "mesh", "n", "r", F.explode(F.sequence(F.lit(1), F.size("r") - 2)).alias("k"))
    corner = lambda j: F.get("r", F.lit(0) if j == 0 else F.col("k") + (j - 1))
    return rows.select("path", "mesh", (F.col("n") * 65_536 + F.col("k")).alias("tri"), *[corner(j)[a].alias(c + a) for j, c in enumerate("uvw") for a in "xyz"])


def _glb_mesh(df: DataFrame) -> DataFrame:
    return glb(df).select("path", F.col("mesh").cast("string").alias("mesh"), "tri", *_CORNERS)


def _obj_mesh(df: DataFrame) -> DataFrame:
    return obj_triangles(_text(df)).select("path", F.lit("0").alias("mesh"), (F.col("at").cast("long") * 65_536 + F.col("k")).alias("tri"), *_CORNERS)


def _dxf_mesh(df: DataFrame) -> DataFrame:
    corners = F.array(*[F.struct(*[F.col(f"{a}{j}").alias(a) for a in "xyz"]) for j in range(4)])
    # a face whose last two corners are one is a triangle
    ring = F.when(F.get(corners, F.lit(2)) == F.get(corners, F.lit(3)), F.slice(corners, 1, 3)).otherwise(corners)
    return _fans(dxf_faces(_text(df)), F.lit("0"), ring, F.col("face"))


def _gml_mesh(df: DataFrame) -> DataFrame:
    return _fans(citygml_rings(_text(df)), F.lit("0"), F.col("places"), F.col("ring"))


def _cityjson_mesh(df: DataFrame) -> DataFrame:
    return _fans(cityjson_surfaces(_text(df)), F.col("object"), F.col("ring"), F.col("surface"))


def _usgs_heights(df: DataFrame) -> DataFrame:
    rows = usgs_dem(_text(df))
    return rows.select("path", F.col("place").cast("int").alias("row"), (F.col("profile") - 1).cast("int").alias("col"), "v")


_POINT_READERS = {"las": las, "ply": ply}
_HEIGHT_READERS = {"hgt": hgt, "dt0": dted, "dt1": dted, "dt2": dted, "tif": tiff, "tiff": tiff, "dem": _usgs_heights}
_MESH_READERS = {"glb": _glb_mesh, "obj": _obj_mesh, "dxf": _dxf_mesh, "gml": _gml_mesh, "xml": _gml_mesh, "json": _cityjson_mesh}


def _by_extension(spark: SparkSession, path: str, readers: dict, max_bytes: int | None = None) -> DataFrame:
    """Each reader's rows of the files with its extension, which alone it reads; other files, and too large ones, raise."""
    every = spark.read.format("binaryFile").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    # names and lengths alone are scanned here: one row an extension
    for x, one, large in every.groupBy(extension).agg(F.min("path"), F.min(F.when(F.col("length") > max_bytes, F.col("path")))).collect():
        if x not in readers:
            raise ValueError(f"unsupported format: {one}")
        if large:
            raise ValueError(f"a file has more than {max_bytes} bytes: {large}")
    out = None
    for name, read in readers.items():
        own = "*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)
        rows = read(spark.read.format("binaryFile").option("pathGlobFilter", own).load(path).select("path", "content"))
        out = rows if out is None else out.union(rows)
    return out


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Points of LAS and PLY files, by extension; others raise."""
    return _by_extension(spark, path, _POINT_READERS)


def read_heightmap(spark: SparkSession, path: str) -> DataFrame:
    """Rasters of SRTM, DTED, GeoTIFF and USGS DEM files, by extension; others raise."""
    return _by_extension(spark, path, _HEIGHT_READERS)


def read_mesh(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Triangles of GLB, OBJ, DXF, CityGML and CityJSON files, by extension: path, mesh, tri and the corners u, v, w; other
    formats, and files of more bytes than allowed, raise."""
    return _by_extension(spark, path, _MESH_READERS, max_bytes)


def pnts(df: DataFrame) -> DataFrame:
    """Points of .pnts tiles: path, n, place and colour."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        xyz, rgb = formats.read_pnts(data)
        return _numbered({a: xyz[:, k] for k, a in enumerate("xyz")} | {c: rgb[:, k].astype(np.int32) for k, c in enumerate("rgb")})

    return _decoded(df, decode, "path string, n long, x double, y double, z double, r int, g int, b int")


def read_splats(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Gaussian splats of PLY files, values as stored: path, n, the columns of ``formats.SPLAT``, and ``rest`` (the higher
    coefficients; empty without). Files that aren't splats raise in their task, files of more bytes than allowed at once."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        v = formats.read_splats(data)
        rest = pd.Series(list(v[:, len(formats.SPLAT) :]), dtype=object)
        return _numbered({n: v[:, k] for k, n in enumerate(formats.SPLAT)} | {"rest": rest})

    schema = "path string, n long, " + ", ".join(f"{n} double" for n in formats.SPLAT) + ", rest array<double>"
    return _by_extension(spark, path, {"ply": lambda df: _decoded(df, decode, schema)}, max_bytes)


def file_crs(files: DataFrame) -> DataFrame:
    """EPSG codes of binary files (path, content): of LAS files by their GeoKey record, of GeoTIFFs by their keys; else null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [geotiff.las_epsg(c) if c[:4] == b"LASF" else geotiff.epsg(c) if c[:2] in (b"II", b"MM") else None for c in map(bytes, batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "epsg": pd.array(codes, dtype="Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, epsg int")


def georeferences(files: DataFrame) -> DataFrame:
    """Of GeoTIFFs (path, content): west, north, and the sizes of a cell; null without a reference."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [geotiff.transform(bytes(c)) or (None,) * 4 for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], **{n: pd.Series([r[k] for r in rows], dtype="float64") for k, n in enumerate(("west", "north", "size_x", "size_y"))}})

    return files.select("path", "content").mapInPandas(run, "path string, west double, north double, size_x double, size_y double")


def read_dem_wgs84(spark: SparkSession, path: str, rings: int = 8, max_samples: int = 100_000_000) -> DataFrame:
    """GeoTIFF terrain in geographic coordinates: path, lat, lon (cell centres), v, with voids filled ring by ring.

    Files without a reference, in another system than EPSG 4326, and of more samples than allowed are refused.
    """
    from quarrystone.operators.raster import filled_rings

    found = files(spark, path)
    bad = file_crs(found).join(georeferences(found), "path").where("epsg is null or epsg <> 4326 or west is null").select("path").limit(1).collect()
    if bad:
        raise ValueError(f"terrain needs a reference in EPSG 4326: {bad[0][0]}")
    cells = tiff(found)
    large = cells.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > max_samples).select("path").limit(1).collect()
    if large:
        raise ValueError(f"a raster has more than {max_samples} samples: {large[0][0]}")
    # rasters side by side, a gap between them, so that one filling serves all files
    names = cells.groupBy("path").agg((F.max("row") + rings + 2).alias("rows"))
    from pyspark.sql import Window

    offsets = names.withColumn("first", F.coalesce(F.sum("rows").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = cells.join(offsets.select("path", "first"), "path").withColumn("row", (F.col("row") + F.col("first")).cast("int"))
    filled = filled_rings(placed.select("row", "col", "v"), rings)
    own = placed.select("path", "first", "row", "col").join(filled, ["row", "col"]).join(georeferences(found), "path")
    return own.select("path", (F.col("north") - (F.col("row") - F.col("first") + 0.5) * F.col("size_y")).alias("lat"), (F.col("west") + (F.col("col") + 0.5) * F.col("size_x")).alias("lon"), "v")


def _numbers(line: Column) -> Column:
    return F.transform(F.filter(F.split(line, r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def obj_triangles(files: DataFrame) -> DataFrame:
    """OBJ texts (path, text): triangles with corners; faces of more corners become fans; negative indices count back."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    from pyspark.sql import Window

    # vertices up to each line: a vertex's number, and what negative indices of a face count back from
    corner, running = F.col("line").startswith("v "), Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.where(corner | F.col("line").startswith("f ")).withColumn("number", F.sum(corner.cast("int")).over(running).cast("int"))
    v = lines.where(corner).select("path", "number", _numbers(F.substring("line", 3, 1_000_000)).alias("p"))
    faces = lines.where(~corner).select("path", "at", "number", F.filter(F.split(F.substring("line", 3, 1_000_000), r"\s+"), lambda x: x != "").alias("c"))
    corners = faces.select("path", "at", "number", F.transform("c", lambda x: F.split(x, "/")[0].cast("int")).alias("c"))
    fans = corners.select("path", "at", "number", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda k: F.array(F.col("c")[0], F.get("c", k), F.get("c", k + 1)))).alias("k", "t"))
    fans = fans.withColumn("t", F.transform("t", lambda i: F.when(i < 0, F.col("number") + i + 1).otherwise(i))).drop("number")
    rows = fans.select("path", "at", "k", F.posexplode("t").alias("j", "number")).join(v.select("path", "number", "p"), ["path", "number"])
    pick = lambda j, a: F.max(F.when(F.col("j") == j, F.col("p")[a]))
    return rows.groupBy("path", "at", "k").agg(*[pick(j, a).alias(c + n) for j, c in enumerate("uvw") for a, n in enumerate("xyz")])


def dxf_faces(files: DataFrame) -> DataFrame:
    """3DFACE entities of DXF texts (path, text): path, face, the four corners. Pairs of lines are code and value."""
    pairs = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    code = pairs.where("at % 2 = 0").select("path", (F.col("at") / 2).cast("int").alias("n"), F.trim("line").try_cast("int").alias("code"))
    value = pairs.where("at % 2 = 1").select("path", (F.col("at") / 2).cast("int").alias("n"), F.trim("line").alias("value"))
    rows = code.join(value, ["path", "n"])
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumn("face", F.sum((F.col("code") == 0).cast("int")).over(w)).withColumn("kind", F.last(F.when(F.col("code") == 0, F.col("value")), True).over(w))
    own = rows.where("kind = '3DFACE' and code between 10 and 33")
    pick = lambda c: F.max(F.when(F.col("code") == c, F.col("value").try_cast("double")))
    return own.groupBy("path", "face").agg(*[pick(10 * (k + 1) + j).alias(f"{a}{j}") for j in range(4) for k, a in enumerate("xyz")])


#: Metres per drawing unit of $INSUNITS.
DXF_UNITS = {0: 1.0, 1: 0.0254, 2: 0.3048, 3: 1609.344, 4: 0.001, 5: 0.01, 6: 1.0, 7: 1000.0, 10: 0.9144, 14: 0.1}


def cityjson_surfaces(files: DataFrame) -> DataFrame:
    """Exterior rings of MultiSurface geometries in CityJSON texts (path, text): object, surface, ring of x, y, z."""
    shape = "transform struct<scale:array<double>,translate:array<double>>, vertices array<array<double>>, CityObjects map<string, struct<type:string,geometry:array<struct<type:string,boundaries:array<array<array<int>>>>>>>"
    doc = files.select("path", F.from_json("text", shape).alias("d")).select("path", "d.*")
    objects = doc.select("path", "transform", "vertices", F.explode("CityObjects").alias("object", "o")).select("*", F.explode("o.geometry").alias("g"))
    faces = objects.where("g.type = 'MultiSurface'").select("path", "object", "transform", "vertices", F.posexplode("g.boundaries").alias("surface", "rings"))
    at = lambda i, k: F.get(F.get("vertices", i), F.lit(k)) * F.coalesce(F.col("transform.scale")[k], F.lit(1.0)) + F.coalesce(F.col("transform.translate")[k], F.lit(0.0))
    return faces.select("path", "object", "surface", F.transform(F.col("rings")[0], lambda i: F.struct(*[at(i, k).alias(a) for k, a in enumerate("xyz")])).alias("ring"))


def topojson_lines(files: DataFrame) -> DataFrame:
    """TopoJSON texts (path, text) to lines: arcs are running sums of steps, reversed for ~index, joined without the
    shared ends. Columns: path, name, coordinates."""
    shape = "transform struct<scale:array<double>,translate:array<double>>, arcs array<array<array<double>>>, objects map<string, struct<type:string,arcs:array<int>>>"
    doc = files.select("path", F.from_json("text", shape).alias("d")).select("path", "d.*")
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        x, y = s["x"] + p[0], s["y"] + p[1]
        place = F.struct((x * F.col("transform.scale")[0] + F.col("transform.translate")[0]).alias("x"), (y * F.col("transform.scale")[1] + F.col("transform.translate")[1]).alias("y"))
        return F.struct(x.alias("x"), y.alias("y"), F.concat(s["out"], F.array(place)).alias("out"))

    decoded = doc.withColumn("lines", F.transform("arcs", lambda arc: F.aggregate(arc, start, step, lambda s: s["out"])))
    rows = decoded.select("path", "lines", F.explode("objects").alias("name", "o")).where("o.type = 'LineString'")
    arc = lambda i: F.when(i < 0, F.reverse(F.get("lines", -i - 1))).otherwise(F.get("lines", i))
    parts = F.transform("o.arcs", lambda i, k: F.when(k == 0, arc(i)).otherwise(F.slice(arc(i), 2, 1_000_000)))
    return rows.select("path", "name", F.flatten(parts).alias("coordinates"))


def overpass_buildings(files: DataFrame) -> DataFrame:
    """Closed ways of Overpass JSON texts (path, text) with their ring: way, tags, ring (lon, lat), from a node table."""
    shape = "elements array<struct<type:string,id:long,lat:double,lon:double,nodes:array<long>,tags:map<string,string>>>"
    items = files.select("path", F.explode(F.from_json("text", shape)["elements"]).alias("e")).select("path", "e.*")
    nodes = items.where("type = 'node' and lat is not null and lon is not null").select("path", F.col("id").alias("node"), "lat", "lon")
    ways = items.where("type = 'way' and size(nodes) >= 4 and nodes[0] = nodes[size(nodes) - 1]").select("path", F.col("id").alias("way"), "tags", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node"))
    met = ways.join(nodes, ["path", "node"]).groupBy("path", "way", "n").agg(F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("r"))
    return met.where(F.size("r") == F.col("n")).select("path", "way", "tags", F.transform("r", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("ring"))


def step_entities(files: DataFrame) -> DataFrame:
    """Entities of STEP texts (path, text), as of IFC files: id, type, args (the text between the outer brackets)."""
    rows = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)#[0-9]+\s*=\s*[A-Z0-9_]+\s*\((?:[^';]|'[^']*')*\)\s*;"), F.lit(0))).alias("e"))
    part = lambda k: F.regexp_extract("e", r"(?s)#([0-9]+)\s*=\s*([A-Z0-9_]+)\s*\((.*)\)\s*;", k)
    return rows.select("path", part(1).cast("long").alias("id"), part(2).alias("type"), part(3).alias("args"))


def step_arguments(args: Column) -> Column:
    """Top-level arguments: commas inside brackets and quotes don't part them."""
    return F.transform(F.regexp_extract_all(args, F.lit(r"\s*((?:'[^']*'|\((?:[^()']|'[^']*'|\((?:[^()']|'[^']*')*\))*\)|[^,()'])+)"), F.lit(1)), lambda x: F.trim(x))


def ifc_elements(entities: DataFrame, kinds: list[str]) -> DataFrame:
    """Elements of some IFC types: express_id, global_id, class, name, parent_express_id, from containment and aggregation."""
    a = entities.withColumn("a", step_arguments(F.col("args")))
    text = lambda k: F.nullif(F.regexp_replace(F.get("a", F.lit(k)), "^'|'$", ""), F.lit("$"))
    own = a.where(F.col("type").isin(kinds)).select("path", F.col("id").alias("express_id"), text(0).alias("global_id"), F.col("type").alias("class"), text(2).alias("name"))
    ref = lambda x: F.regexp_extract(x, "#([0-9]+)", 1).cast("long")
    refs = lambda x: F.transform(F.regexp_extract_all(x, F.lit("#([0-9]+)"), F.lit(1)), lambda r: r.cast("long"))
    whole = a.where("type = 'IFCRELAGGREGATES'").select("path", ref(F.get("a", F.lit(4))).alias("parent_express_id"), F.explode(refs(F.get("a", F.lit(5)))).alias("express_id"))
    held = a.where("type = 'IFCRELCONTAINEDINSPATIALSTRUCTURE'").select("path", ref(F.get("a", F.lit(5))).alias("parent_express_id"), F.explode(refs(F.get("a", F.lit(4)))).alias("express_id"))
    return own.join(whole.union(held), ["path", "express_id"], "left")


def ifc_properties(entities: DataFrame) -> DataFrame:
    """Properties of elements by their property sets: express_id, key (Set.Name), value_text, value_number, value_boolean."""
    a = entities.withColumn("a", step_arguments(F.col("args")))
    plain = lambda x: F.regexp_replace(x, "^'|'$", "")
    refs = lambda x: F.transform(F.regexp_extract_all(x, F.lit("#([0-9]+)"), F.lit(1)), lambda r: r.cast("long"))
    single = a.where("type = 'IFCPROPERTYSINGLEVALUE'").select("path", F.col("id").alias("prop"), plain(F.get("a", F.lit(0))).alias("name"), F.get("a", F.lit(2)).alias("raw"))
    sets = a.where("type = 'IFCPROPERTYSET'").select("path", F.col("id").alias("pset"), plain(F.get("a", F.lit(2))).alias("set"), F.explode(refs(F.get("a", F.lit(4)))).alias("prop"))
    links = a.where("type = 'IFCRELDEFINESBYPROPERTIES'").select("path", refs(F.get("a", F.lit(4))).alias("elements"), F.get(refs(F.get("a", F.lit(5))), F.lit(0)).alias("pset"))
    links = links.select("path", "pset", F.explode("elements").alias("express_id"))
    rows = links.join(sets, ["path", "pset"]).join(single, ["path", "prop"])
    inner = F.regexp_extract("raw", r"^[A-Z0-9]+\((.*)\)$", 1)
    number = inner.try_cast("double")
    flag = F.when(inner.isin(".T.", ".F."), inner == ".T.")
    value = F.when(number.isNull() & flag.isNull(), plain(inner))
    return rows.select("path", "express_id", F.concat_ws(".", "set", "name").alias("key"), value.alias("value_text"), number.alias("value_number"), flag.alias("value_boolean"))


def citygml_rings(files: DataFrame) -> DataFrame:
    """Exterior rings of CityGML texts (path, text) by their position lists: path, ring number, array of x, y, z."""
    lists = F.regexp_extract_all("text", F.lit(r"<gml:exterior>(?s).*?<gml:posList[^>]*>([^<]*)</gml:posList>"), F.lit(1))
    rows = files.select("path", F.posexplode(lists).alias("ring", "list")).withColumn("v", _numbers("list"))
    place = lambda k: F.struct(*[F.get("v", 3 * k + j).alias(a) for j, a in enumerate("xyz")])
    return rows.select("path", "ring", F.transform(F.sequence(F.lit(0), (F.size("v") / 3).cast("int") - 1), place).alias("places"))


def collada_meshes(files: DataFrame) -> DataFrame:
    """Position arrays of COLLADA texts (path, text): path, source id, array of numbers."""
    found = F.regexp_extract_all("text", F.lit(r'<float_array id="([^"]*)"[^>]*>([^<]*)</float_array>'), F.lit(0))
    rows = files.select("path", F.explode(found).alias("a"))
    return rows.select("path", F.regexp_extract("a", 'id="([^"]*)"', 1).alias("source"), _numbers(F.regexp_extract("a", r">([^<]*)<", 1)).alias("numbers"))


def detected_crs(files: DataFrame) -> DataFrame:
    """EPSG codes of WKT texts (path, text), as of .prj files: the outermost authority; null if there is none."""
    codes = F.regexp_extract_all("text", F.lit(r'(?:AUTHORITY\["EPSG",\s*"?|ID\["EPSG",\s*)([0-9]+)'), F.lit(1))
    return files.select("path", F.when(F.size(codes) > 0, F.element_at(codes, -1).cast("int")).alias("epsg"))


def world_files(files: DataFrame) -> DataFrame:
    """World files (path, text): pixel sizes, rotations and the centre of the first pixel; texts without six numbers are null."""
    v = _numbers(F.col("text"))
    names = ("size_x", "rotation_y", "rotation_x", "size_y", "x", "y")
    return files.select("path", *[F.when(F.size(v) == 6, F.get(v, F.lit(k))).alias(n) for k, n in enumerate(names)])


def usgs_dem(files: DataFrame) -> DataFrame:
    """USGS DEM texts (path, text): profiles of B records as path, profile, place, v; -32767 is null.

    An A record has 1024 characters; every B record starts at a multiple of that with its row and column numbers and the
    count of heights, which follow from character 144 in fields of six: 146 in its first block, then 170 in each block that it
    goes on in. Blocks that hold no such header, and aren't a continuation, are left out; heights beyond the end are null.
    """
    at = lambda k, a: F.trim(F.substring("text", k * 1024 + a, F.lit(6))).try_cast("int")
    more = lambda n: F.ceil(F.greatest(n - 146, F.lit(0)) / 170).cast("int")
    # headers are read from block to block, as a count says how many blocks are heights alone
    header = F.struct(F.lit(0).alias("k"), F.lit(0).alias("profile"), F.lit(0).alias("n"))
    start = F.struct(F.lit(1).alias("next"), F.filter(F.array(header), lambda _: F.lit(False)).alias("found"))

    def step(state, k):
        profile, n = at(k, 7), at(k, 13)
        there = (k >= state["next"]) & profile.isNotNull() & (F.coalesce(n, F.lit(0)) >= 1)
        got = F.array_append(state["found"], F.struct(k.alias("k"), F.coalesce(profile, F.lit(0)).alias("profile"), F.coalesce(n, F.lit(0)).alias("n")))
        return F.struct(F.when(there, k + 1 + more(F.coalesce(n, F.lit(0)))).otherwise(F.greatest(state["next"], k + 1)).alias("next"), F.when(there, got).otherwise(state["found"]).alias("found"))

    blocks = F.ceil(F.length("text") / 1024).cast("int") - 1
    whole = files.where(blocks > 0).withColumn("r", F.explode(F.aggregate(F.sequence(F.lit(1), blocks), start, step)["found"]))
    rows = whole.select("path", "r.profile", "r.n", F.substring("text", F.col("r.k") * 1024 + 1, (more(F.col("r.n")) + 1) * 1024).alias("b"))
    later = lambda i: F.floor((i - 146) / 170).cast("int") * 1024 + 1025 + (i - 146) % 170 * 6
    heights = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.trim(F.substring("b", F.when(i < 146, 145 + 6 * i).otherwise(later(i)), F.lit(6))).try_cast("double"))
    out = rows.select("path", "profile", F.posexplode(heights).alias("place", "v"))
    return out.withColumn("v", F.when(F.col("v") != -32767, F.col("v")))
