import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import splat_tree
from quarrystone.operators import tiling as C
from quarrystone.sources import formats

SCHEMA = "id long, " + ", ".join(f"{c} double" for c in formats.SPLAT)


def cloud(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, 14))
    values[:, 6] = rng.integers(1, 9, n) / 10
    return values, spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(values)], SCHEMA)


def built(df, most):
    return splat_tree.splat_tree(df, C.splat_score(F.col("opacity"), [F.col(f"scale_{k}") for k in range(3)]), most)


def rotated_reach(v):
    w, x, y, z = v[10:14] / np.linalg.norm(v[10:14])
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    return 3 * np.sqrt(((r * np.exp(v[7:10])) ** 2).sum(axis=1))


def test_nodes_show_the_largest_of_their_subtree(spark):
    values, df = cloud(spark, 900)
    rows = built(df, 60).collect()
    leaf = {r["id"]: r["node"] for r in rows if r["leaf"]}
    assert sorted(leaf) == list(range(900))
    area = np.log(values[:, 6]) + np.sort(values[:, 7:10], axis=1)[:, 1:].sum(axis=1)
    nodes = {n[:k] for n in leaf.values() for k in range(len(n) + 1)}
    for node in nodes:
        below = [k for k, n in leaf.items() if n.startswith(node)]
        largest = sorted(below, key=lambda k: (-area[k], k))[:60]
        assert sorted(r["id"] for r in rows if r["node"] == node) == sorted(below if node in leaf.values() else largest)
    boxes = {r["node"]: r for r in splat_tree.tiles(built(df, 60)).collect()}
    assert boxes.keys() == nodes
    for node, r in boxes.items():
        below = [k for k, n in leaf.items() if n.startswith(node)]
        reach = np.array([rotated_reach(values[k]) for k in below])
        assert np.allclose([r[f"low_{a}"] for a in "xyz"], (values[below, :3] - reach).min(axis=0))
        assert np.allclose([r[f"high_{a}"] for a in "xyz"], (values[below, :3] + reach).max(axis=0))


def test_files(spark, tmp_path):
    values, df = cloud(spark, 300)
    tree = built(df, 40)
    folder = tmp_path / uuid.uuid4().hex
    files = {r["path"]: r["bytes"] for r in splat_tree.write_splats(tree, f"file://{folder}").collect()}
    seen, todo = 0, ["root.json"]
    while todo:
        root = json.loads((folder / todo.pop()).read_text())["root"]
        shown = formats.read_splats((folder / root["content"]["uri"]).read_bytes())
        assert 0 < len(shown) <= 40
        seen += 0 if root.get("children") else len(shown)
        for child in root.get("children", []):
            assert child["geometricError"] < root["geometricError"]
            todo.append(child["content"]["uri"])
    assert seen == 300 and len(files) == 2 * len({r["node"] for r in tree.select("node").distinct().collect()})
    checked = C.validated(splat_tree.tileset(tree).select(F.col("text").alias("json")))
    assert checked.where(F.size("problems") > 0).count() == 0


def test_refused(spark):
    _, df = cloud(spark, 20)
    with pytest.raises(ValueError):
        built(df.where("false"), 5)
    with pytest.raises(ValueError):
        built(df.withColumn("opacity", F.lit(None).cast("double")), 5)
    with pytest.raises(ValueError):
        built(df.withColumns({a: F.lit(1.0) for a in "xyz"}), 5)
