import numpy as np
from pyspark.sql import functions as F

from quarrystone.operators import instances

SCHEMA = "mesh_id long, n int, x double, y double, z double, colour string"


def table(spark, meshes, colours=None):
    rows = [(m, k, *map(float, p), (colours or {}).get(m, "grey")) for m, places in meshes.items() for k, p in enumerate(places)]
    return spark.createDataFrame(rows, SCHEMA)


def spun(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, ::-1]


def applied(q, p):
    """A place turned by a quaternion."""
    v, w = np.array([q["x"], q["y"], q["z"]]), q["w"]
    return p + 2 * np.cross(v, np.cross(v, p) + w * p)


def by_hand(meshes, colours):
    """One after the other against the firsts before it, rotations by least squares."""
    firsts, out = [], {}
    for m in sorted(meshes):
        p = meshes[m] - meshes[m].mean(axis=0)
        for f in firsts:
            q = meshes[f] - meshes[f].mean(axis=0)
            if len(q) != len(p) or colours.get(m) != colours.get(f):
                continue
            u, _, v = np.linalg.svd(q.T @ p)
            d = np.diag([1, 1, np.sign(np.linalg.det(u @ v))])
            if np.abs(q @ (u @ d @ v) - p).max() < 5e-4:
                out[m] = f
                break
        else:
            firsts.append(m)
            out[m] = m
    return out


def test_equals_one_after_the_other(spark):
    rng = np.random.default_rng(4)
    box = np.array([[x, y, z] for x in (0, 2) for y in (0, 1) for z in (0, 1)], float)
    shapes = [box, box * (1, 1, -1), rng.normal(size=(9, 3)), rng.normal(size=(9, 3)), np.roll(box, 3, axis=0)]
    meshes, colours = {}, {}
    for m in range(80):
        s = shapes[rng.integers(len(shapes))]
        meshes[m] = s @ spun(rng).T + rng.normal(size=3) * 500 + rng.normal(size=s.shape) * 1e-5
        colours[m] = "red" if m % 9 == 0 else "grey"
    got = {r["mesh_id"]: r for r in instances.repeated_geometry(table(spark, meshes, colours)).collect()}
    assert {m: r["first"] for m, r in got.items()} == by_hand(meshes, colours)
    for m, r in got.items():
        first = meshes[r["first"]]
        centre = (first.min(axis=0) + first.max(axis=0)) / 2
        placed = np.array([r["move"][a] for a in "xyz"]) + [applied(r["rotation"], p - centre) for p in first]
        assert np.abs(placed - meshes[m]).max() < 1.1e-3


def test_many_shapes_of_one_key(spark):
    # points of a circle's arc seen from the first: the mean distances agree, the shapes don't
    meshes = {}
    for m in range(60):
        a = 0.4 + 0.01 * (m % 20)
        meshes[m] = np.array([[0, 0, 0], [1, 0, 0], [np.cos(a), np.sin(a), 0], [np.cos(a), -np.sin(a), 0], [-1, 0, 0], [-np.cos(a), np.sin(a), 0], [-np.cos(a), -np.sin(a), 0]]) + m
    got = {r["mesh_id"]: r["first"] for r in instances.repeated_geometry(table(spark, meshes)).collect()}
    assert got == {m: m % 20 for m in meshes}


def test_half_turns_and_quarter_turns(spark):
    base = np.array([[0, 0, 0], [3, 0, 0], [0, 2, 0], [0, 0, 1]], float)
    turns = [np.eye(3), np.diag([1, -1, -1]), np.diag([-1, 1, -1]), np.diag([-1, -1, 1]), np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])]
    meshes = {m: base @ np.array(t, float).T for m, t in enumerate(turns)}
    got = {r["mesh_id"]: r["rotation"] for r in instances.repeated_geometry(table(spark, meshes)).collect()}
    for m, p in meshes.items():
        assert np.allclose([applied(got[m], x) for x in base], p)


def test_flat_null_and_empty(spark):
    meshes = {1: np.zeros((3, 3)), 2: np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0]]), 3: np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]])}
    rows = table(spark, meshes).union(spark.createDataFrame([(4, 0, None, 0.0, 0.0, "grey"), (None, 0, 0.0, 0.0, 0.0, "grey")], SCHEMA))
    assert {r["mesh_id"]: r["first"] for r in instances.repeated_geometry(rows).collect()} == {1: None, 2: None, 3: 3, 4: None}
    assert instances.repeated_geometry(rows.where("false")).count() == 0


def test_normals_refuse(spark):
    base = np.array([[0, 0, 0], [3, 0, 0], [0, 2, 0]], float)
    rows = table(spark, {0: base, 1: base + 5, 2: base + 9})
    up = F.when(F.col("mesh_id") == 2, -1.0).otherwise(1.0)
    got = instances.repeated_geometry(rows.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": up}))
    assert {r["mesh_id"]: r["first"] for r in got.collect()} == {0: 0, 1: 0, 2: 2}
