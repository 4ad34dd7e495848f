"""Sizes and inputs at which queries failed: joins that would gather a table at the driver, places past a pole, deep leaves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import geodesy
from quarrystone.operators import classify, instances, inverted, mesh_tree, raster, section, spatial, splat_tree
from quarrystone.operators import tiling as C


@pytest.fixture
def eager(spark):
    """A session that broadcasts whatever it may."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    yield spark
    spark.conf.set(key, before)


def points(spark, n=60):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(k, *map(float, rng.uniform(0, 6, 3))) for k in range(n)], "point_id long, x double, y double, z double")


def broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def test_radius_searches_gather_no_table(eager):
    p = points(eager)
    assert not broadcasts(spatial.neighbours(p, p, 3.0))


def test_nearest_each_gathers_no_table(eager):
    p = points(eager)
    near = spatial.nearest_each(p, p, 5, 0.5)
    assert not broadcasts(near)
    assert near.count() == 60 * 5


def test_features_gather_no_table(eager):
    p = points(eager)
    shapes = classify.features(p, p, 3.0)
    assert not broadcasts(shapes)
    assert not broadcasts(classify.classified(p, shapes, 1.0))


def test_instances_and_sections_gather_no_table(eager, monkeypatch):
    kept = []

    def noted(df):
        kept.append(df)
        return df.checkpoint()

    for module in (instances, section):
        monkeypatch.setattr(module, "settled", noted)
    boxes = eager.createDataFrame([(k, 0, float(k), 0.0, 0.0, 2.0, 2.0, 2.0, False) for k in range(3)], "mesh_id long, box int, x double, y double, z double, dx double, dy double, dz double, inward boolean")
    triangles = section.box_triangles(boxes)
    found = section.polygons(section.cut(triangles, (0.0, 0.0, 1.0), 1.0))
    corners = F.array(*[F.struct(*[F.col(p + a).alias(a) for a in "xyz"]) for p in "uvw"])
    soup = triangles.select("mesh_id", "tri_id", F.posexplode(corners).alias("k", "p")).select("mesh_id", (F.col("tri_id") * 3 + F.col("k")).alias("n"), "p.x", "p.y", "p.z")
    copies = instances.repeated_geometry(soup)
    assert {(r["mesh_id"], r["first"]) for r in copies.collect()} == {(0, 0), (1, 0), (2, 0)}
    assert [r["area"] for r in found.collect()] == [4.0] * 3
    assert len(kept) > 5
    assert not [df.columns for df in [*kept, found, copies] if broadcasts(df)]


def test_mesh_tree_gathers_no_table(eager):
    rng = np.random.default_rng(6)
    rows = eager.createDataFrame([(k, "m", *map(float, rng.uniform(0, 9, 9))) for k in range(50)], "tri_id long, material string, " + ", ".join(f"{p}{a} double" for p in "uvw" for a in "xyz"))
    tree = mesh_tree.mesh_tree(rows, 100)
    assert not broadcasts(tree)
    assert tree.count() == 50


def test_places_past_the_pole_come_back(spark):
    degrees = [(90.0, 10.0), (89.5, 10.0), (230.0, -50.0), (475.5, 50.9), (270.0, 3.0), (-90.0, 7.0), (2975.0, 0.1), (12.0, 30.0)]
    df = spark.createDataFrame(degrees, "lat0 double, lon0 double").withColumn("h0", F.lit(40.5))
    x, y, z = geodesy.transform(4326, 4978, F.col("lat0"), F.col("lon0"), F.col("h0"))
    lat, lon, h = geodesy.transform(4978, 4326, F.col("x"), F.col("y"), F.col("z"))
    there = df.select("lat0", "lon0", x.alias("x"), y.alias("y"), z.alias("z")).select("lat0", "lon0", lat.alias("lat"), lon.alias("lon"), h.alias("h"))
    got = there.select(*geodesy.unwrapped(*[F.col(c) for c in ("lat", "lon", "lat0", "lon0")]), "h").collect()
    assert np.allclose([r[:2] for r in got], degrees, atol=1e-7)
    assert np.allclose([r[2] for r in got], 40.5, atol=1e-3)


def test_codes_of_cells_beyond_twelve_bits(spark, tmp_path):
    from quarrystone.plans.catalog import QUERIES

    orders = "1L AS o_orderkey, 90000L AS o_custkey, 'F' AS o_orderstatus, 20000D AS o_totalprice, timestamp'1998-01-01' AS o_orderdate"
    spark.sql(f"SELECT {orders}").write.parquet(f"{tmp_path}/orders.parquet")
    (row,) = QUERIES["c06_morton"](spark, str(tmp_path)).collect()
    low = lambda v: sum(((v >> k) & 1) << (3 * k) for k in range(12))
    assert row.asDict() == {"point_id": 1, "code": low(0) | low(6000) << 1 | low(2) << 2, "x": 0, "y": 6000, "z": 2}


def test_leaves_of_a_bounded_tree_hold_all(spark):
    rows = [(k, 0.0 if k else 9.0, 0.0, 0.0, 0.5 + k / 100) for k in range(12)]
    cloud = spark.createDataFrame(rows, "id long, x double, y double, z double, opacity double")
    tree = splat_tree.splat_tree(cloud, F.col("opacity"), 5, max_depth=2).collect()
    assert sorted(r["id"] for r in tree if r["leaf"]) == list(range(12))
    assert sorted(r["id"] for r in tree if r["node"] == "") == [7, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        splat_tree.splat_tree(cloud, F.col("opacity"), 5)
    assert C.MAX_DEPTH > 2


def test_rasters_past_the_pole_end_where_mercator_does(spark):
    size, metres = 2.0, 200_000.0
    plane = spark.range(120 * 3).selectExpr("CAST(id div 3 AS INT) AS row", "CAST(id % 3 AS INT) AS col", "CAST(id div 3 AS DOUBLE) AS v")
    got = raster.to_mercator(plane, 10.0, 50.0, size, metres).toPandas()
    y = lambda lat: geodesy.A * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    assert got["row"].max() + 1 == math.ceil((y(50.0) - y(-geodesy.MERCATOR_LIMIT)) / metres)
    lat = np.degrees(np.arctan(np.sinh((y(50.0) - (got["row"] + 0.5) * metres) / geodesy.A)))
    assert np.allclose(got["v"], np.maximum((50.0 - lat) / size - 0.5, 0))
    with pytest.raises(ValueError):
        raster.to_mercator(plane, 10.0, -86.0, size, metres).count()


def test_postings_shuffle_texts_and_no_tokens(spark):
    rng = np.random.default_rng(8)
    words = ["aa", "bb", "c3", "Dd", "\u00e9e", "ff"]
    texts = [" ".join(rng.choice(words, int(n))) + "." for n in rng.integers(0, 40, 700)]
    rows = [(k, t if k % 9 else None, "aa  bb" if k % 5 else None) for k, t in enumerate(texts)]
    found = inverted.postings(spark.createDataFrame(rows, "id long, text string, title string").repartition(3), "id", ["text", "title"])
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["term"], r["block"]): r for r in found.collect()}
    assert len(got) == found.count()
    want = {}
    for k, *columns in rows:
        split = [[w for w in (c or "").replace(".", " ").lower().replace("\u00e9", "e").split()] for c in columns]
        for n, ws in enumerate(split):
            for at, w in enumerate(ws):
                entry = want.setdefault((w, k // inverted.BLOCK), {}).setdefault(k, (sum(map(len, split)), []))
                entry[1].append(at + n * inverted._COLUMN)
    # folding may keep accents; compare on what it gives
    fold = lambda w: w.replace("\u00e9", "e")
    assert {(fold(t), b) for t, b in got} == set(want)
    for (t, b), r in got.items():
        assert [(e["row"], e["hits"], e["length"], e["places"]) for e in r["entries"]] == [(k, len(p), n, p) for k, (n, p) in sorted(want[fold(t), b].items())]
        assert (r["docs"], r["most_hits"], r["least_length"]) == (len(r["entries"]), max(e["hits"] for e in r["entries"]), min(e["length"] for e in r["entries"]))


def test_large_rooms_are_dealt_to_tasks(spark, tmp_path):
    from quarrystone.plans.catalog import QUERIES

    events = "SELECT id AS event_id, 'click' AS event_type, id % 300 AS user_id, CASE WHEN id < 600 THEN 5D ELSE 50D END AS value, timestamp'2024-01-01' AS ts, '' AS props FROM range(1500)"
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        found = QUERIES["i15_fan_out"](spark, str(tmp_path))
        assert found.select(F.spark_partition_id()).distinct().count() > 1
        assert found.count() == found.distinct().count() == 9 * 299
    finally:
        spark.conf.unset(key)


def test_searches_broadcast_no_vectors(eager):
    from quarrystone.llm import topk

    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8))
    rows = eager.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(1024 * x).astype(int)
    for parts in ((16, 256), (1, 1)):
        found = topk.top_k(rows, parts=parts)
        assert not broadcasts(found)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
        for k in range(0, 900, 100):
            best = sorted((-int(q[k] @ q[j]), j) for j in range(900) if j != k)[:10]
            assert [got[k, n + 1] for n in range(10)] == [(j, -s) for s, j in best]


def test_every_window_gives_a_gradient(monkeypatch):
    import pyarrow as pa

    from quarrystone.llm.recurrent import END, Model

    texts = pa.array([" ".join(np.random.default_rng(k).choice(["a", "b", "c"], 400)) for k in range(40)])
    model = Model(["a", "b", "c", END], [6000, 5000, 5000, 40], 16040, 4)
    learnt, learn = [], Model._learn
    monkeypatch.setattr(Model, "_learn", lambda self, prev, goal, sizes, h: (learnt.append(len(goal)), learn(self, prev, goal, sizes, h)))
    assert model.train(texts) == sum(learnt) == 40 * 401


def test_obj_meshes_go_to_texts_of_bounded_size(spark):
    from quarrystone.operators import sinks as K
    from quarrystone.sources import readers as S

    rows = [(m, k, *[float(k + j) for j in range(9)]) for m, n in (("a-7", 90), ("b", 5)) for k in range(n)]
    triangles = spark.createDataFrame(rows, "mesh_id string, tri_id long, ux double, uy double, uz double, vx double, vy double, vz double, wx double, wy double, wz double")
    texts = K.obj_parts(triangles, 20)
    sizes = {r["path"]: r["text"].count("f ") for r in texts.collect()}
    assert len(sizes) > 5 and max(sizes.values()) < 60 and sum(sizes.values()) == 95
    got = S.obj_triangles(texts).selectExpr("regexp_replace(path, '-[0-9]+[.]obj$', '') AS mesh_id", "ux", "wz")
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[2], r[10]) for r in rows)


def test_obj_faces_count_back_without_a_list_of_the_mesh(spark):
    from quarrystone.sources import readers as S

    text = "v 0 0 0\nv 1 0 0\nv 2 0 0\nf -3 -2 -1\nv 3 0 0\nf 1 -2 -1"
    found = S.obj_triangles(spark.createDataFrame([("m", text), ("none", "f -1 -2 -3")], "path string, text string"))
    assert sorted((r["ux"], r["vx"], r["wx"]) for r in found.collect()) == [(0, 1, 2), (0, 2, 3)]
    # a face carried the places of all vertices
    assert "collect_list" not in found._jdf.queryExecution().toString()
