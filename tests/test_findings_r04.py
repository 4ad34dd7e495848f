"""Sizes at which queries failed by the driver's memory or by disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import instances, mesh_tree, spatial


def jobs_of(spark, name, run):
    """What a function gives, and how many Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def odd_soup(spark, n=900):
    """Triangles of three materials: spread ones, copies of one place, and ones with null, NaN and infinite corners."""
    odd = ["CAST(NULL AS DOUBLE)", "double('NaN')", "double('Infinity')", "id % 11D", "id % 5D", "1D"]
    corner = lambda k: f"CASE id % 3 WHEN 0 THEN xxhash64(id, {k}) % 1000 / 7D WHEN 1 THEN 3D ELSE CASE (id div 3 + {k}) % 6 {' '.join(f'WHEN {i} THEN {o}' for i, o in enumerate(odd))} END END"
    return spark.range(n).selectExpr("id AS tri_id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS material", *[f"{corner(a)} AS {p}{'xyz'[a]}" for p in "uvw" for a in range(3)])


def test_small_nodes_of_a_mesh_tree_take_one_task_and_few_jobs(spark, monkeypatch):
    paths = lambda: {(r["material"], r["tri_id"]): r["path"] for r in mesh_tree.mesh_tree(odd_soup(spark), 20).collect()}
    # before, a level of the tree took a dozen jobs with a plan each, all of which the driver kept
    tree, jobs = jobs_of(spark, "small nodes", paths)
    assert jobs < 12
    assert len(tree) == 900 and max(map(len, tree.values())) >= 5
    monkeypatch.setattr(mesh_tree, "WHOLE", 20)
    assert paths() == tree
    monkeypatch.setattr(mesh_tree, "WHOLE", 100)
    assert paths() == tree


def test_a_mesh_tree_ends_at_its_last_level_within_a_task(spark):
    with pytest.raises(ValueError):
        mesh_tree.mesh_tree(odd_soup(spark), 20, most_levels=4)
    assert mesh_tree.mesh_tree(odd_soup(spark).where(F.col("tri_id") < 60), 20, most_levels=2).count() == 60


def rooms(spark, folder, n=1500):
    """Events of one room: the first 600 join, by 300 users; the others are messages."""
    events = f"SELECT id AS event_id, 'click' AS event_type, id % 300 AS user_id, CASE WHEN id < 600 THEN 5D ELSE 50D END AS value, timestamp'2024-01-01' AS ts, '' AS props FROM range({n})"
    spark.sql(events).write.parquet(f"{folder}/events.parquet")


def test_every_message_is_fanned_out(spark, tmp_path):
    from quarrystone.plans.catalog import QUERIES, SQL

    rooms(spark, tmp_path)
    found = QUERIES["i15_fan_out"](spark, str(tmp_path))
    assert found.count() == found.distinct().count() == 900 * 299
    assert found.select("seq").distinct().count() == 900
    assert "%" not in SQL["i15_fan_out"].split("realtime m JOIN")[1]


def test_a_fan_out_shuffles_a_message_once(spark, tmp_path):
    from quarrystone.plans.catalog import QUERIES

    rooms(spark, tmp_path, 3600)
    found = QUERIES["i15_fan_out"](spark, str(tmp_path))
    made, written = run_and_shuffled(found)
    assert made == 3000 * 299
    # the messages, joins by connection, users, lists, and 300 members at most in a list of each share; before, 64 copies of every message
    assert 3000 < written < 3000 + 4 * 600 + 300 * 64


def run_and_shuffled(df):
    """How many rows a run of the plan gives, and how many it writes to shuffles."""
    run = df._jdf.queryExecution()
    made, written, todo = run.toRdd().count(), 0, [run.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            written += node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return made, written


def test_copies_of_one_form_are_held_against_no_head(spark, monkeypatch):
    rng = np.random.default_rng(3)
    shapes = [rng.integers(-9, 9, (6, 3)).astype(float) for _ in range(2)]
    turned = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float)
    rows = []
    for m in range(40):
        s = shapes[m % 2] @ (turned if m % 3 == 0 else np.eye(3)) + rng.integers(0, 500, 3)
        rows += [(m, k, *map(float, p)) for k, p in enumerate(s)]
    # copies that match nothing, not even themselves, as an n is repeated
    rows += [(m, k % 5, *map(float, p)) for m in (40, 41) for k, p in enumerate(shapes[1])]
    vertices = spark.createDataFrame(rows, "mesh_id long, n int, x double, y double, z double")
    held, matches = [], instances._matches

    def noted(pairs, v):
        held.append((pairs.count(), v.select("mesh_id").distinct().count()))
        return matches(pairs, v)

    monkeypatch.setattr(instances, "_matches", noted)
    found = lambda: {r["mesh_id"]: r for r in instances.repeated_geometry(vertices).collect()}
    got = found()
    assert {m: r["first"] for m, r in got.items()} == {**{m: m % 2 for m in range(40)}, 40: 40, 41: 41}
    # two shapes in two turns each; before, every mesh was held against its head
    assert sum(p for p, _ in held) <= 4 and max(v for _, v in held) <= 6
    # many forms are joined and not named; a form a mesh gives the same
    monkeypatch.setattr(instances, "MOST_NAMED", 1)
    form = instances._form
    monkeypatch.setattr(instances, "_form", lambda v, p0: F.struct(form(v, p0).alias("f"), F.min("mesh_id").alias("m")))
    assert found() == got


def test_nearest_points_are_searched_in_blocks_without_copies_of_centers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    # a dense heap with many equal distances, a thin cloud, and places far from all
    at = np.vstack([rng.integers(0, 9, (500, 3)) / 2, rng.uniform(-60, 60, (100, 3)), [[900, 0, 0], [902, 0, 0], [1e6, 0, 0]]])
    df = spark.createDataFrame([(int(k), *map(float, p)) for k, p in zip(rng.permutation(len(at)) * 7, at)], "point_id long, x double, y double, z double")
    df = df.union(spark.sql("SELECT -1L, CAST(NULL AS DOUBLE), 0D, 0D UNION ALL SELECT -2L, double('NaN'), 0D, 0D"))
    rows = {r["point_id"]: np.array(r[1:]) for r in df.collect() if r["point_id"] >= 0}
    want = {}
    for c, q in rows.items():
        near = sorted((float(np.sqrt((d := q - p) @ d)), i) for i, p in rows.items() if i != c)
        want |= {(c, n + 1): i for n, (d, i) in enumerate(near[:4]) if d <= 64}
    got = lambda: {(r["center_id"], r["rank"]): r["point_id"] for r in spatial.nearest_each(df, df, 4, 0.5, 128).collect()}
    monkeypatch.setattr(spatial, "MOST_PAIRS", 5000)
    # a block too full for a task goes to the join on cells
    monkeypatch.setattr(spatial, "MOST_POINTS", 300)
    assert got() == want
    monkeypatch.setattr(spatial, "MOST_POINTS", 1 << 18)
    # before, every center had a copy for each of 27 cells
    monkeypatch.setattr(spatial, "neighbours", None)
    assert got() == want


def test_materials_are_not_gathered_at_the_driver(spark):
    from quarrystone.plans import tiling
    from quarrystone.plans.inputs import Tables

    found = tiling._materials(Tables(spark, "/root/testdata/sf0.001"))
    # before, the whole part table was broadcast
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
