"""Worked examples and invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import catalog, change, elements, geometry, geostat, metadata, raster, search, sinks, spatial, tiling
from quarrystone.plans.inputs import Tables
from quarrystone.sources import formats, geotiff, readers

SF = "/root/testdata/sf0.001"
SIX = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 5.0, 5.0, 5.0), (5, 10.0, 10.0, 10.0)]
XYZ = "point_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame(SIX, XYZ)


def test_spatial_examples(six):
    hits = spatial.radius_search(six, (0, 0, 0), 1.5).orderBy("distance").collect()
    assert len(hits) == 4 and hits[0]["distance"] == 0
    assert [r["point_id"] for r in spatial.nearest(six, (0, 0, 0), 2, 1.0).collect()] == [0, 1]
    assert spatial.in_box(six, (-0.5, -0.5, -0.5), (1.5, 1.5, 0.5)).count() == 4
    assert spatial.clip(six, [(0.5, -0.5), (1.5, -0.5), (1.5, 1.5), (0.5, 1.5)]).count() == 2
    assert spatial.clip(six, [(0, 0), (1, 1)]).count() == 0
    assert spatial.volume(six.limit(3)).first()["volume"] == 0


def test_batch_joins_use_cells(six):
    plan = spatial.neighbours(six, six, 1.5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["center_id"], r["point_id"]) for r in spatial.neighbours(six, six, 1.5).collect()}
    assert len(got) == 18 and (0, 3) in got
    near = {r["center_id"]: r["point_id"] for r in spatial.nearest_each(six, six, 1, 1.0).collect()}
    assert near == {0: 1, 1: 0, 2: 0, 3: 1, 4: 3, 5: 4}


@pytest.mark.parametrize(
    "bad",
    ['{"$nor":[{"A.B":1}]}', '{"A.B":{"$regex":"x"}}', '{"@label":{"$regex":"x"}}', '{"@owner":"x"}', '{"@label":{"$gt":1}}', '{"A.B":{"$gt":"3"}}', '{"A.B":{"$like":3}}', '{"A.B":{"$in":"x"}}', '{"A.B":{"$in":[null]}}', '{"A.B":[1]}', '{"A.B":{}}', '{"A.B":{"C":1}}', '{"$and":[]}', '{"$and":[1]}', '{"@label":3}', '{"@label":null}', "[]", "not json"],
)
def test_refused_filters(spark, bad):
    t = Tables(spark, SF)
    with pytest.raises(elements.FilterError):
        elements.filtered(t.elements, t.properties, bad)


def test_filter_limits(spark):
    nested = {"A.B": 1}
    for _ in range(elements.MAX_DEPTH):
        nested = {"$and": [nested]}
    elements.parsed(nested)
    with pytest.raises(elements.FilterError, match="nesting"):
        elements.parsed({"$and": [nested]})
    with pytest.raises(elements.FilterError, match="clauses"):
        elements.parsed({f"K{n}": 1 for n in range(elements.MAX_CLAUSES + 1)})


def test_aggregate_example(spark):
    e = spark.createDataFrame([(1, 1, "a", "Wall", None, None, None), (2, 2, "b", "Wall", None, None, None)], "element_row long, express_id long, global_id string, class string, name string, parent_express_id long, storey string")
    p = spark.createDataFrame([(1, 0, "Length", None, 4000.0, None, "mm"), (2, 0, "Length", None, 2500.0, None, "mm")], "element_row long, property_row int, key string, value_text string, value_number double, value_boolean boolean, units string")
    got = {r["key"]: r for r in elements.aggregated(e, p, "Length,FireRating").collect()}
    assert tuple(got["Length"])[2:] == (2, 2500.0, 4000.0, 3250.0, 6500.0, ["mm"])
    assert tuple(got["FireRating"])[2:] == (0, None, None, None, 0.0, [])


def test_search_ranks_rare_words_first(spark):
    docs = spark.createDataFrame([(1, "wall door wall"), (2, "door"), (3, "wall"), (4, "wall window"), (5, "floor")], "id long, text string")
    got = [r["id"] for r in search.search(docs, "id", ["text"], "window wall").orderBy(F.desc("score")).collect()]
    assert got[0] == 4 and set(got) == {1, 3, 4}
    with pytest.raises(elements.FilterError):
        search.search(docs, "id", ["text"], "-wall")


def test_epochs(spark):
    grid = spark.createDataFrame([(k, float(k % 10), float(k // 10), 1.0) for k in range(100)], XYZ)
    assert change.epoch_changes(grid, grid, 1.0).where("reported").count() == 0
    lifted = grid.limit(50).withColumn("z", F.lit(5.0))
    got = change.epoch_changes(grid.limit(0), lifted, 1.0, 0.1, 0.05).where("reported")
    assert {r["kind"] for r in got.collect()} == {"Addition"} and got.count() == 50


def test_octree_invariants(spark):
    n = 20_000
    points = spark.range(n).select(F.col("id").alias("point_id"), *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1000.0).alias(a) for k, a in enumerate("xyz")])
    tree = tiling.octree(points, 500)
    sizes = tree.groupBy("path").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 500 and sizes[1] == n
    stats = tiling.tree_stats(tiling.node_table(tree), 500).first()
    assert n <= stats["total_points"] < 2 * n and stats["nodes"] == stats["leaves"] + stats["internal"]
    same = points.select("point_id", *[F.lit(1.0).alias(a) for a in "xyz"])
    assert tiling.octree(same, 500).select("path").distinct().count() == 1


def test_geostatistics(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 1.0, 0.0, 12.0), (3, 0.0, 1.0, 11.0), (4, 1.0, 1.0, 13.0), (5, 0.5, 0.5, 11.5)], "id long, x double, y double, value double")
    assert geostat.idw(s.limit(1).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), s).first()["value"] == 10
    k = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 2.0, 0.0, 14.0), (3, 0.0, 2.0, 16.0), (4, 2.0, 2.0, 22.0), (5, 1.0, 0.7, 15.0)], "id long, x double, y double, value double")
    for method in ("ordinary", "simple", "universal"):
        at = geostat.kriging(k.select("x", "y", F.col("value").alias("known")), k, 0.0, 10.0, 5.0, method)
        assert all(abs(r["value"] - r["known"]) < 1e-6 and r["variance"] < 1e-6 for r in at.collect())
    place = spark.createDataFrame([(0.6, 1.4)], "x double, y double")
    values = {round(geostat.kriging(place, k, 0.5, 10.0, 5.0, m).first()["value"], 6) for m in ("ordinary", "simple", "universal")}
    assert len(values) == 3
    plane = k.withColumn("value", 3 + 2 * F.col("x") - F.col("y"))
    assert abs(geostat.kriging(place, plane, 0.5, 10.0, 5.0, "universal").first()["value"] - (3 + 1.2 - 1.4)) < 1e-6
    with pytest.raises(ValueError):
        geostat.kriging(place, k.union(k.limit(1)), 0.5, 10.0, 5.0)


def test_terrain_invariants(spark):
    heights = [(r, c, float((r - 10) ** 2 + (c - 10) ** 2)) for r in range(21) for c in range(21)]
    bowl = spark.createDataFrame(heights, "row int, col int, v double")
    areas = [raster.flooded(bowl, level, 1.0).first()["cells"] for level in (0.0, 10.0, 50.0)]
    assert areas[0] == 0 and areas[0] < areas[1] < areas[2]
    d = raster.flow_directions(bowl)
    down = d.join(bowl.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("v").alias("below")), ["to_row", "to_col"])
    assert down.where("below >= v").count() == 0
    assert raster.watersheds(d).select("outlet_row", "outlet_col").distinct().collect() == [(10, 10)]
    assert raster.accumulation(d).where("row = 10 and col = 10").first()["cells"] == 441
    wall = spark.createDataFrame([(0, c, 100.0 if c == 5 else 0.0) for c in range(11)], "row int, col int, v double")
    seen = {r["col"]: r["seen"] for r in raster.visible(wall, 0, 0, 1.0, 10).collect()}
    assert seen[5] and not seen[6] and not seen[10] and seen[1]
    filled = raster.sinks_filled(bowl.withColumn("raster", F.lit(1).cast("long")))
    assert filled.agg(F.min("v")).first()[0] == 100.0


def test_geometry():
    a, b = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float), np.array([(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)], float)
    hole = geometry.overlay(a, b, "difference")
    assert len(hole) == 2 and abs(sum(geometry._signed(r[:-1]) for r in hole) - 3) < 1e-6
    far = b + 10
    assert len(geometry.overlay(a, far, "union")) == 2 and geometry.overlay(a, far, "intersection") == []
    assert len(geometry.simplified(np.array([(0, 0), (1, 0.01), (2, 0)], float), 0.1)) == 2
    with pytest.raises(ValueError):
        geometry.hull(np.array([(0, 0), (1, 1), (2, 2)], float))
    assert abs(geometry._signed(geometry.hull(np.array([(0, 0), (1, 1), (2, 0), (1, 0.2)], float))) - 1) < 1e-9


def test_metadata_refuses_meaningless_pairs(spark):
    b = Tables(spark, SF).building
    with pytest.raises(ValueError):
        metadata.filtered(b, "yearBuilt", "<", 3)
    assert metadata.stats(b.limit(0), "height").count() == 0


def test_section_chains(spark):
    square = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0), (5, 5, 6, 5)]
    df = spark.createDataFrame([("m", k, *map(float, s)) for k, s in enumerate(square)], "mesh_id string, tri_id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["closed"], round(abs(r["area"]), 6)) for r in tiling.section_rings(df).collect())
    assert got == [(False, 0.0), (True, 1.0)]


def test_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz = rng.normal(0, 100, (50, 3))
    las = formats.read_las(formats.write_las(xyz, np.arange(50), np.full(50, 2), np.full((50, 3), 7)))
    assert np.allclose(np.column_stack([las[a] for a in "xyz"]), xyz, atol=1e-5) and (las["r"] == 7).all()
    v = np.array([[1.0, -5.0], [np.nan, 7.0]])
    assert np.array_equal(formats.read_hgt(formats.write_hgt(v)), v, equal_nan=True)
    assert np.array_equal(formats.read_dted(formats.write_dted(v)), v, equal_nan=True)
    ascii_ply = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    assert formats.read_ply(ascii_ply)["y"].tolist() == [2, 5] and not formats.is_splat_ply(ascii_ply)
    t = np.array([[0, 1, 2], [2, 1, 3]])
    mesh = formats.read_quantized_mesh(formats.write_quantized_mesh(np.array([0, 1, 0, 1.0]), np.array([0, 0, 1, 1.0]), np.array([0, 5, 10, 20.0]), t, np.zeros(3), 1.0))
    assert mesh["triangles"].tolist() == t.tolist() and np.allclose(mesh["height"], [0, 5, 10, 20], atol=1e-3)
    points = Tables(spark, SF).points.where("cls = 2")
    saved = sinks.save(sinks.las_files(points, "cls"), f"file://{tmp_path}/las")
    assert saved.first()["bytes"] > 0
    assert readers.read_point_cloud(spark, f"file://{tmp_path}/las").count() == points.count()
    with pytest.raises(ValueError):
        (tmp_path / "las" / "x.e57").write_bytes(b"1")
        readers.read_point_cloud(spark, f"file://{tmp_path}/las")


def test_tileset_json():
    tree = json.loads(sinks.tileset_json([("", False), ("0", True), ("7", True)], [0, 0, 0], [2, 2, 2]))
    kids = tree["root"]["children"]
    assert [k["content"]["uri"] for k in kids] == ["0.pnts", "7.pnts"] and kids[1]["boundingVolume"]["box"][:3] == [1.5, 1.5, 1.5]
    assert tree["geometricError"] == pytest.approx(3**0.5) and kids[0]["geometricError"] == 0


def test_cron(spark):
    at = F.lit("2024-01-01 08:25:00").cast("timestamp")  # a Monday
    row = spark.range(1).select(*[catalog.cron_matches(e, at).alias(str(k)) for k, e in enumerate(("25 8 * * *", "*/5 * * * 1", "26 8 * * *", "25 8 1 1 0", "25 8 2 * 3"))]).first()
    assert list(row) == [True, True, False, True, False]


@pytest.mark.parametrize(
    "bad",
    ["", "   ", "-wall", "a | -b", "-(a b)", "a + -b | -c", "+", "a +", "| a", "(a", "a)", '"open', "***", '"..."', "a\x00b", "x" * 1025, " ".join(f"w{k}" for k in range(65)), "(" * 17 + "a" + ")" * 17],
)
def test_refused_searches(bad):
    with pytest.raises(elements.FilterError):
        search.parsed(bad)


def test_searches(spark):
    assert search.rendered(search.parsed("door window")) == '("door" OR "window")'
    assert search.rendered(search.parsed('fire + "door leaf" + -win*')) == '(("fire" AND "door leaf") NOT "win" *)'
    assert search.rendered(search.parsed(r'a\"b | \-c + (d e)')) == '("a""b" OR ("-c" AND ("d" OR "e")))'
    assert search.rendered(search.parsed("(" * 16 + "a" + ")" * 16)) == '"a"'
    rows = [(1, "Fire door, oak", None), (2, "Oak window. Fire-door leaf", "x"), (3, None, None), (4, "FIRÉ doors", "fire"), (5, "door fire", "")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    find = lambda q: {r["id"] for r in search.search(df, "id", ["a", "b"], q).collect()}
    assert find("fire + door") == {1, 2, 5} and find('"fire door"') == {1, 2} and find("fire-door") == {1, 2}
    assert find("fire + door*") == {1, 2, 4, 5} and find("oak + -window") == {1} and find("leaf | zzz") == {2}
    scores = {r["id"]: r["score"] for r in search.search(df, "id", ["a", "b"], "fire + door").collect()}
    assert scores[5] > scores[1] > scores[2] > 0


def test_neighbours_by_brute_force(spark):
    """Nearest neighbours, outliers and densities of all points of a small cloud."""
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 3, (150, 3)), [[60, 60, 60]], np.zeros((3, 3))])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], XYZ)
    d = np.sqrt(((xyz[:, None] - xyz[None, :]) ** 2).sum(-1))
    got = {(r["center_id"], r["rank"]): r["point_id"] for r in spatial.nearest_each(df, df, 4, 1.0).collect()}
    for i in range(len(xyz)):
        order = sorted((round(d[i, j], 12), j) for j in range(len(xyz)) if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in order]


def test_variogram_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(rng.uniform(-30, 30)), float(rng.uniform(-30, 30)), float(rng.normal())) for k in range(700)]
    got = {r["bin"]: (r["semivariance"], r["pairs"]) for r in geostat.variogram(spark.createDataFrame(rows, "id long, x double, y double, value double"), 2.5, 4).collect()}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            k = int(np.hypot(a[1] - b[1], a[2] - b[2]) / 2.5)
            if k < 4:
                want.setdefault(k, []).append((a[3] - b[3]) ** 2 / 2)
    assert got.keys() == want.keys() and all(got[k][1] == len(v) and abs(got[k][0] - np.mean(v)) < 1e-9 for k, v in want.items())


def test_kriging_by_linear_algebra(spark):
    """Ordinary and simple kriging against systems solved here."""
    rng = np.random.default_rng(7)
    xy, v = rng.uniform(0, 10, (12, 2)), rng.normal(5, 1, 12)
    df = spark.createDataFrame([(k, float(x), float(y), float(z)) for k, ((x, y), z) in enumerate(zip(xy, v))], "id long, x double, y double, value double")
    gamma = lambda h: np.where(h == 0, 0.0, np.where(h >= 6, 10.0, 1 + 9 * (1.5 * h / 6 - 0.5 * (h / 6) ** 3)))
    places = geostat.grid(spark, 0.0, 0.0, 10.0, 10.0, 2.5)
    got = {(r["row"], r["col"]): r for r in geostat.kriging(places, df, 1.0, 10.0, 6.0).collect()}
    h = np.sqrt(((xy[:, None] - xy[None, :]) ** 2).sum(-1))
    system = np.ones((13, 13))
    system[:12, :12], system[12, 12] = gamma(h), 0
    for (row, col), r in got.items():
        place = np.array([(col + 0.5) * 2.5, (row + 0.5) * 2.5])
        right = np.append(gamma(np.sqrt(((xy - place) ** 2).sum(1))), 1)
        weights = np.linalg.solve(system, right)
        assert abs(r["value"] - weights[:12] @ v) < 1e-6
    assert len(got) == 16


def test_flow_by_walking(spark):
    """Accumulation and outlets of a random terrain, cell by cell."""
    rng = np.random.default_rng(8)
    v = rng.uniform(0, 100, (12, 15))
    d = raster.flow_directions(spark.createDataFrame([(r, c, float(v[r, c])) for r in range(12) for c in range(15) if (r, c) != (5, 5)], "row int, col int, v double"))
    way = {(r["row"], r["col"]): (r["to_row"], r["to_col"]) for r in d.collect()}
    counts, ends = {k: 0 for k in way}, {}
    for k in way:
        at = k
        while at in way:
            counts[at], ends[k] = counts[at] + 1, at
            if way[at][0] is None:
                break
            at = way[at]
    assert {(r["row"], r["col"]): r["cells"] for r in raster.accumulation(d).collect()} == counts
    assert {(r["row"], r["col"]): (r["outlet_row"], r["outlet_col"]) for r in raster.watersheds(d).collect()} == ends
    circle = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0)], "row int, col int, to_row int, to_col int")
    with pytest.raises(ValueError):
        raster.accumulation(circle, 6)


def test_step_arguments_keep_their_digits(spark):
    args = ",".join(["#0", "'1 a'", " #2 ", "(#3,'x,y')", "$", "#5", "6.", "#7#7", "'8'", ".T."])
    got = spark.createDataFrame([(args,)], "args string").select(readers.step_arguments(F.col("args")).alias("a")).first()["a"]
    assert got == ["#0", "'1 a'", "#2", "(#3,'x,y')", "$", "#5", "6.", "#7#7", "'8'", ".T."]


def test_geotiff_and_dispatch(spark, tmp_path):
    v = np.arange(30, dtype=float).reshape(5, 6)
    v[2, 3] = np.nan
    data = geotiff.write(v, 10.0, 50.0, 0.25, 4326)
    assert np.array_equal(geotiff.read(data), v, equal_nan=True) and geotiff.epsg(data) == 4326 and geotiff.transform(data) == (10.0, 50.0, 0.25, 0.25)
    with pytest.raises(ValueError):
        geotiff.read(b"II+\0")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.tif").write_bytes(data)
    (tmp_path / "a" / "y.hgt").write_bytes(formats.write_hgt(np.ones((3, 3))))
    cells = readers.read_heightmap(spark, f"file://{tmp_path}/a")
    assert cells.where("path like '%tif' and v is not null").count() == 29 and cells.where("path like '%hgt'").count() == 9
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.tif").write_bytes(data)
    (tmp_path / "w" / "z.tif").write_bytes(geotiff.write(np.full((2, 2), 7.0), 0.0, 1.0, 0.5, 4326))
    dem = {(round(r["lat"], 4), round(r["lon"], 4)): r["v"] for r in readers.read_dem_wgs84(spark, f"file://{tmp_path}/w").collect()}
    assert len(dem) == 34 and dem[49.375, 10.875] == pytest.approx(np.mean([9, 14, 16, 21])) and dem[0.75, 0.25] == 7
    (tmp_path / "w" / "u.tif").write_bytes(geotiff.write(v, 10.0, 50.0, 0.25, 32633))
    with pytest.raises(ValueError, match="4326"):
        readers.read_dem_wgs84(spark, f"file://{tmp_path}/w")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n")
    (tmp_path / "m" / "b.glb").write_bytes(formats.write_glb(np.eye(3), np.array([0, 1, 2])))
    (tmp_path / "m" / "c.dxf").write_text("0\n3DFACE\n" + "".join(f"{10 * k + 10 + j}\n{c}\n" for j, p in enumerate([(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 0)]) for k, c in enumerate(p)) + "0\nEOF\n")
    (tmp_path / "m" / "d.gml").write_text("<gml:exterior><gml:posList>0 0 0 2 0 0 2 2 0 0 2 0 0 0 0</gml:posList></gml:exterior>")
    mesh = readers.read_mesh(spark, f"file://{tmp_path}/m")
    assert {r["path"][-5:]: r["count"] for r in mesh.groupBy("path").count().collect()} == {"a.obj": 2, "b.glb": 1, "c.dxf": 1, "d.gml": 2}
    with pytest.raises(ValueError, match="bytes"):
        readers.read_mesh(spark, f"file://{tmp_path}/m", 10)


def test_point_cloud_to_tileset(spark, tmp_path):
    points = Tables(spark, SF).points
    files = {r["path"]: r["bytes"] for r in sinks.tile_point_cloud(points, f"file://{tmp_path}/t", 200, 5).collect()}
    leaves = tiling.octree(points, 200, 5)
    nodes = {r["node"]: r["is_leaf"] for r in tiling.node_table(leaves).collect()}
    assert set(files) == {f"{n or 'root'}.pnts" for n in nodes} | {f"{n}.json" if n else "tileset.json" for n in nodes}
    seen, held, todo = set(), 0, ["tileset.json"]
    whole = json.loads(sinks.tileset_json(sorted(nodes.items()), *tiling.bounds(points)))
    boxes = {}

    def walk(node):
        boxes[node["content"]["uri"]] = node["boundingVolume"]["box"], node["geometricError"]
        for c in node.get("children", []):
            walk(c)

    walk(whole["root"])
    while todo:
        at = todo.pop()
        root = json.loads((tmp_path / "t" / at).read_text())["root"]
        uri = root["content"]["uri"]
        assert np.allclose(root["boundingVolume"]["box"], boxes[uri][0]) and root["geometricError"] == pytest.approx(boxes[uri][1])
        seen.add(uri)
        name = "" if uri == "root.pnts" else uri[:-5]
        if nodes[name]:
            held += len(formats.read_pnts((tmp_path / "t" / uri).read_bytes())[0])
        todo += [c["content"]["uri"] for c in root.get("children", [])]
    assert held == points.count() and len(seen) == len(nodes)


def test_edits_and_snapshots(spark, tmp_path):
    t = Tables(spark, SF)
    e, p = elements.applied_edit(t.elements, t.properties, {"kind": "set_property", "global_id": "C1", "key": "New.Key", "value": 2.5})
    assert e.count() == t.elements.count() and p.where("key = 'New.Key' and value_number = 2.5 and element_row = 3000001").count() == 1
    e, p = elements.applied_edit(e, p, {"kind": "remove_property", "global_id": "C1", "key": "New.Key"})
    assert p.count() == t.properties.count()
    e, p = elements.applied_edit(e, p, {"kind": "delete", "global_id": "C1"})
    assert e.where("global_id = 'C1'").count() == 0 and p.where("element_row = 3000001").count() == 0
    for bad in ({"kind": "explode", "global_id": "C2"}, {"kind": "delete"}, {"kind": "delete", "global_id": "nobody"}, {"kind": "insert_proxy", "global_id": "C2", "class": "x", "name": "y"}):
        with pytest.raises(elements.FilterError):
            elements.applied_edit(e, p, bad)
    folder = f"file://{tmp_path}/snapshots"
    for epoch, rows in (("a", t.points.where("cls = 2")), ("b", t.points), ("a", t.points.where("cls = 6"))):
        change.saved_snapshot(rows, folder, epoch, 5.0)
    assert change.loaded_snapshot(spark, folder, "a").agg(F.sum("n")).first()[0] == t.points.where("cls = 6").count()
    assert change.loaded_snapshot(spark, folder, "b").agg(F.sum("n")).first()[0] == t.points.count()


def test_replays_hold_state_across_batches(spark):
    """A key with many rows is replayed in batches; the result is that of one pass."""
    rows = spark.range(5000).selectExpr("id % 2 AS key", "id AS event_id", "timestamp_seconds(id div 40) AS ts")
    got = {(r["key"], r["event_id"]): r["allowed"] for r in catalog.token_bucket(rows, 10, 900).collect()}
    want = {}
    for key in (0, 1):
        level, last, first, used = 10, None, None, 0
        for i in range(key, 5000, 2):
            at = i // 40
            level = 10 if last is None else min(10, level + (at - last) * 10)
            last = at
            ok = level >= 1
            if ok and (first is None or at - first >= 86_400):
                first, used = at, 0
            ok = ok and used < 900
            level, used = level - ok, used + ok
            want[key, i] = bool(ok)
    assert got == want
