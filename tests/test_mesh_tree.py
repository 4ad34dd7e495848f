import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import mesh_tree


def soup(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(n, 3)) * (9, 3, 1)
    rows = [(k, "ab"[k % 5 == 0], *map(float, at[k] + (0, 0, 0)), *map(float, at[k] + (0.1, 0, 0)), *map(float, at[k] + (0, 0.1, 0))) for k in range(n)]
    return spark.createDataFrame(rows, "tri_id long, material string, " + ", ".join(f"{p}{a} double" for p in "uvw" for a in "xyz"))


def split(rows, path, budget, out):
    """The same tree by hand for rows without equal centroids."""
    if len(rows) <= budget:
        out.update({i: path for i, _ in rows})
        return
    c = np.array([x for _, x in rows])
    low, high = c.min(axis=0), c.max(axis=0)
    axis = int(np.argmax(high - low))
    near = c[:, axis] < (low[axis] + high[axis]) / 2
    for digit, side in ((0, near), (1, ~near)):
        split([r for r, s in zip(rows, side) if s], path + str(digit), budget, out)


def test_equals_the_tree_by_hand(spark):
    triangles = soup(spark, 400)
    got = {(r["material"], r["tri_id"]): r["path"] for r in mesh_tree.mesh_tree(triangles, 30).collect()}
    rows = mesh_tree.centroids(triangles).collect()
    want = {}
    for m in "ab":
        out = {}
        split([(r["tri_id"], (r["cx"], r["cy"], r["cz"])) for r in rows if r["material"] == m], "", 30, out)
        want |= {(m, k): p for k, p in out.items()}
    assert got == want


def test_copies_of_one_place_are_split_by_count(spark, monkeypatch):
    monkeypatch.setattr(mesh_tree, "SLICE", 16)
    one = soup(spark, 1).drop("tri_id", "material").crossJoin(spark.range(100).select((F.col("id") * 3).alias("tri_id"), F.lit(None).cast("string").alias("material")))
    tiles = mesh_tree.mesh_tree(one, 7)
    sizes = [r["count"] for r in tiles.groupBy("path").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 7 and tiles.select("tri_id").distinct().count() == 100
    table = mesh_tree.tile_table(tiles)
    assert table.where("level = 0").first()["triangles"] == 100
    assert {r["triangles"] for r in table.where("not leaf").collect() if r["level"] == 1} == {50}


def test_nothing_and_bad_budgets(spark):
    assert mesh_tree.mesh_tree(soup(spark, 1).where("false"), 5).collect() == []
    with pytest.raises(ValueError):
        mesh_tree.mesh_tree(soup(spark, 1), 0)
