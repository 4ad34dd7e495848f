"""Dispatch, plug-ins, model fallback, analysis layers and geometry operations against small examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import classify, geometry, raster, sinks, tiling
from quarrystone.sources import formats, plugin, readers


def test_splats_are_told_by_any_property():
    data = formats.write_splats(np.arange(28, dtype=float).reshape(2, 14))
    assert formats.is_splat_ply(data) and formats.read_splats(data)[1].tolist() == list(range(14, 28))
    assert not formats.is_splat_ply(formats.write_ply({"x": np.zeros(1)}))
    with pytest.raises(ValueError, match="not finite"):
        formats.read_splats(formats.write_splats(np.full((1, 14), np.nan)))
    with pytest.raises(ValueError, match="properties"):
        formats.read_splats(formats.write_ply({"x": np.zeros(1)}))


def test_dispatch_refuses(spark, tmp_path):
    (tmp_path / "a.PLY").write_bytes(formats.write_ply({a: np.array([1.0, 2.0]) for a in "xyz"}))
    assert readers.read_point_cloud(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="bytes"):
        readers.read_splats(spark, str(tmp_path), 10)
    (tmp_path / "b.e57").write_bytes(b"x")
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_point_cloud(spark, str(tmp_path))


def test_plugin_overwrites_and_skips_hidden_files(spark, tmp_path):
    plugin.register(spark)
    folder = str(tmp_path / "out")
    points = spark.range(100).selectExpr("'' AS path", "id / 10D AS x", "1D AS y", "2D AS z", "CAST(id % 3 AS INT) AS cls", "7 AS intensity")
    for mode, n in (("append", 100), ("append", 200), ("overwrite", 100)):
        points.write.format("las_points").mode(mode).save(folder)
        (tmp_path / "out" / ".left.las").write_bytes(b"a failed attempt")
        got = spark.read.format("las_points").load(folder)
        assert got.count() == n
    assert abs(got.agg(F.sum("x")).first()[0] - 495) < 1e-6 and got.where("cls = 1").count() == 33
    points.limit(0).write.format("las_points").mode("overwrite").save(folder)
    assert spark.read.format("las_points").load(folder).count() == 0


def test_models_stand_back_for_the_built_in_classes(spark):
    points = spark.createDataFrame([(1, 0.5, 2), (2, 0.1, 6)], "point_id long, h double, code int")

    def fails(features):
        raise OSError("no service")

    for model in (None, fails, lambda f: ([1, 1, 1], [0.9])):
        assert sorted(map(tuple, classify.modelled(points, ["h"], model).collect())) == [(1, 0.5, 2, 0.7), (2, 0.1, 6, 0.7)]
    good = classify.modelled(points, ["h"], lambda f: ((f["h"] > 0.3).astype(int) + 4, f["h"]))
    assert sorted(map(tuple, good.collect())) == [(1, 0.5, 5, 0.5), (2, 0.1, 4, 0.1)]


def test_analysis_layers(spark):
    size, metres = 0.01, 1000.0
    plane = spark.range(400).selectExpr("CAST(id div 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", "50D * (id % 20) AS v")
    got = raster.analysis("Slope", plane, 10.0, 50.0, size, metres).toPandas()
    # eastward steps of 50 a cell: the same slope away from the edges
    want = math.degrees(math.atan(50 / (math.radians(size) * 6378137.0)))
    inner = got[got["col"].between(3, got["col"].max() - 3)]["v"].dropna()
    assert len(inner) > 50 and np.allclose(inner, want, rtol=1e-6)
    known = raster.to_mercator(plane, 10.0, 50.0, size, metres).toPandas()
    lon = 10 + np.degrees((known["col"] + 0.5) * metres / 6378137.0)
    assert len(known) == (known["row"].max() + 1) * (known["col"].max() + 1)
    assert np.allclose(known["v"], 50 * np.clip((lon - 10) / size - 0.5, 0, 19))
    # the index of the bands is taken before their places are mixed
    bands = spark.createDataFrame([(0, c, b, "2020-01-01", v) for c, pair in enumerate(((1500.0, 2500.0), (1100.0, 4100.0))) for b, v in enumerate(pair)], "row int, col int, band int, day string, v double")
    values = raster.analysis("ndvi", bands, 10.0, 50.0, size, 100.0, since="2019-01-01").toPandas()["v"].dropna()
    assert np.isclose(values.min(), 1000 / 2000) and np.isclose(values.max(), 3000 / 3200)
    with pytest.raises(ValueError):
        raster.analysis("curvature", plane, 10.0, 50.0, size, metres)
    assert raster.to_mercator(plane.limit(0), 10.0, 50.0, size, metres).count() == 0


def test_geometry_operations(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0001), (0.0, 1.0), (0.0, 0.0)]
    rows = spark.createDataFrame([(1, ring)], f"id long, a {geometry.RING}")
    simple = geometry.processed(rows, "SIMPLIFY", tolerance=0.01).first()
    assert (simple["operation"], simple["n"]) == ("simplify", 5) and abs(simple["area"] - 2) < 1e-6
    assert geometry.processed(rows, "convex_hull").first()["n"] == 5
    assert geometry.processed(rows, "buffer", distance_m=1000.0).first()["area"] > 2
    for bad in (("rotate", {}), ("buffer", {}), ("union", {})):
        with pytest.raises(ValueError):
            geometry.processed(rows, bad[0], **bad[1])


def test_properties_go_to_their_elements_partition(spark, tmp_path):
    rows = spark.createDataFrame([(k % 5, k, "a", None, float(k), None, None) for k in range(50)], "element_row long, property_row int, key string, value_text string, value_number double, value_boolean boolean, units string")
    for _ in range(2):
        sinks.insert_properties(rows, str(tmp_path / "p"), 8)
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.count() == 100 and got.groupBy("element_row").agg(F.count_distinct("bucket").alias("b")).agg(F.max("b")).first()[0] == 1


def test_points_are_thinned_alike_in_slices(spark):
    ids = [k * 9_973 - 400_000 for k in range(500)]
    points = spark.createDataFrame([(i, "1" if i % 3 else "2") for i in ids], "point_id long, path string")
    got = sorted(map(tuple, tiling.decimated(points, 20).select("path", "point_id").collect()))
    want = []
    for node in "12":
        own = sorted(i for i in ids if ("1" if i % 3 else "2") == node)
        want += [(node, i) for i in own[:: min(max(len(own) // 20, 8), 64)]]
    assert got == sorted(want)
