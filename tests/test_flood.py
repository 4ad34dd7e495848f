import heapq

import numpy as np
import pandas as pd
import pytest

from quarrystone.operators import flood


def in_one_piece(v):
    """A priority flood of the raster as a whole."""
    h, w = v.shape
    out, done, heap = v.copy(), np.isnan(v), []
    for r in range(h):
        for c in range(w):
            around = [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
            if not np.isnan(v[r, c]) and any(not (0 <= x < h and 0 <= y < w) or np.isnan(v[x, y]) for x, y in around):
                heapq.heappush(heap, (v[r, c], r, c))
                done[r, c] = True
    while heap:
        level, r, c = heapq.heappop(heap)
        for x in range(max(0, r - 1), min(h, r + 2)):
            for y in range(max(0, c - 1), min(w, c + 2)):
                if not done[x, y]:
                    done[x, y] = True
                    out[x, y] = max(out[x, y], level)
                    heapq.heappush(heap, (out[x, y], x, y))
    return out


def frame(spark, v):
    rows = [(int(r), int(c), None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(v)]
    return spark.createDataFrame(rows, "row int, col int, v double")


def bowl():
    r, c = np.mgrid[0:21, 0:17]
    v = (r - 10.0) ** 2 + (c - 8.0) ** 2
    v[10, 8:] = 30.0 + np.arange(9)
    return v


@pytest.mark.parametrize("size", [5, 8, 64])
def test_equal_to_a_flood_in_one_piece(spark, size):
    rng = np.random.default_rng(size)
    v = rng.integers(0, 12, (23, 19)).astype(float)
    v[rng.random(v.shape) < 0.03] = np.nan
    for raster in (v, bowl()):
        got = flood.filled(frame(spark, raster), size).toPandas()
        want = in_one_piece(raster)
        out = np.full(raster.shape, np.nan)
        out[got["row"], got["col"]] = got["v"]
        assert len(got) == int((~np.isnan(raster)).sum())
        assert np.array_equal(out, want, equal_nan=True)


def test_heights_to_rim_on_random_graphs(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b), float(h)) for a, b, h in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 9, 150)) if a != b] + [(k, k + 1, 20.0) for k in range(60)]
    level = {0: -np.inf}
    for _ in range(61):
        for a, b, h in edges:
            for x, y in ((a, b), (b, a)):
                if y in level:
                    level[x] = min(level.get(x, np.inf), max(h, level[y]))
    got = dict(map(tuple, flood.heights_to_rim(spark.createDataFrame(edges, "a long, b long, h double")).collect()))
    assert got == {k: v for k, v in level.items() if k}


def test_nothing_and_voids_only(spark):
    none = spark.createDataFrame([(0, 0, None)], "row int, col int, v double")
    assert flood.filled(none).collect() == []
    one = spark.createDataFrame(pd.DataFrame({"row": [3], "col": [700], "v": [2.5]}))
    assert [tuple(r) for r in flood.filled(one).collect()] == [(3, 700, 2.5)]
