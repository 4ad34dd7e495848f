import math

import numpy as np
import pytest

from quarrystone.operators import section


def boxes(spark, meshes):
    rows = [(name, k, *map(float, r[:6]), r[6]) for name, own in meshes.items() for k, r in enumerate(own)]
    return section.box_triangles(spark.createDataFrame(rows, "mesh_id string, box int, x double, y double, z double, dx double, dy double, dz double, inward boolean"))


def polygons(spark, meshes, normal, offset):
    out = {name: {} for name in meshes}
    for r in section.polygons(section.cut(boxes(spark, meshes), normal, offset)).collect():
        out[r["mesh_id"]].setdefault(r["polygon"], []).append(round(r["area"], 6))
    return {name: sorted(sorted(areas) for areas in own.values()) for name, own in out.items()}


NESTED = [(-3, -3, -3, 6, 6, 6, False), (-2, -2, -2, 4, 4, 4, True), (-1, -1, -1, 2, 2, 2, False), (10, 0, 0, 1, 1, 1, False)]
WALL = [(-2, -0.15, 0, 4, 0.3, 2.5, False), (-0.6, -0.1, 0.5, 1.2, 0.2, 1.5, True)]


def test_holes_go_to_the_smallest_ring_around_them_and_solids_stay_their_own(spark):
    meshes = {
        "solid in a hole": NESTED, "solid in an outline": [(0, 0, 0, 4, 1, 2, False), (1, 0.25, 0, 1, 0.25, 2, False)],
        "two rings around a hole": [(-5, -5, -1, 10, 10, 2, False), *NESTED[:2]], "below the opening": WALL, "beyond the plane": [(0, 0, 5, 1, 1, 1, False)],
    }
    assert polygons(spark, meshes, (0, 0, 2), 0.25) == {
        "solid in a hole": [[-16.0, 36.0], [1.0], [4.0]], "solid in an outline": [[0.25], [4.0]], "two rings around a hole": [[-16.0, 36.0], [100.0]],
        "below the opening": [[1.2]], "beyond the plane": [],
    }
    assert polygons(spark, {"wall": WALL}, (0, 1, 0), 0.0) == {"wall": [[-1.8, 10.0]]}


@pytest.mark.parametrize("normal", [(1, 2, 3), (-1, 0.5, 0.2)])
def test_areas_on_slanted_planes_equal_a_raster_count(spark, normal):
    rows = [(0.0, 0.0, 0.0, 4.0, 3.0, 5.0, False), (0.5, 0.5, 1.0, 2.0, 1.5, 3.0, True), (1.0, 0.8, 1.6, 0.8, 0.7, 1.4, False)]
    n, e1, e2 = section.frame(normal)
    offset = sum(a * b for a, b in zip(n, (1.4, 1.15, 2.3)))
    assert np.allclose(np.cross(e1, e2), n) and abs(np.dot(e1, e2)) < 1e-12
    got = sum(a for p in polygons(spark, {'m': rows}, normal, offset)['m'] for a in p)
    step = 0.02
    s = np.arange(-9, 9, step)
    at = np.array(n) * offset + s[:, None, None] * np.array(e1) + s[None, :, None] * np.array(e2)
    inside = sum((-1 if r[6] else 1) * np.all((at > r[:3]) & (at < np.add(r[:3], r[3:6])), axis=2) for r in rows)
    assert abs(got - inside.sum() * step * step) < 0.05


def test_open_chains_are_no_polygons_and_bad_normals_are_refused(spark):
    solid = boxes(spark, {"m": [(0, 0, 0, 1, 1, 1, False)]})
    open_box = solid.where("tri_id not in (8, 9)")
    found = section.rings(section.ringed(section.cut(open_box, (0, 0, 1), 0.5))).collect()
    assert [(r["closed"], r["area"]) for r in found] == [(False, 0.0)]
    assert section.polygons(section.cut(open_box, (0, 0, 1), 0.5)).collect() == []
    for bad in ((0, 0, 0), (math.nan, 0, 1), (math.inf, 0, 0)):
        with pytest.raises(ValueError):
            section.frame(bad)
