"""Vector geoprocessing on rings. A ring is an array of structs (x, y), closed or not; one geometry is one row.

Columns do what formulas can (areas, centroids, points in polygons). Hulls, simplification, buffers and overlays of one
row are small numpy kernels. Overlays hold for polygons in general position: an edge through a vertex is nudged by 1e-9.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.geodesy import A, DEGREE_M

RING = "array<struct<x:double,y:double>>"


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(ring, k).alias("p"), F.get(ring, (k + 1) % n).alias("q")))


def area(ring: Column) -> Column:
    """Signed: positive if the ring turns left."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda a, e: a + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2


def centroid(ring: Column) -> Column:
    """Weighted by area; null for rings without any."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a"))

    def add(s: Column, e: Column) -> Column:
        c = e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
        return F.struct((s["x"] + (e["p"]["x"] + e["q"]["x"]) * c).alias("x"), (s["y"] + (e["p"]["y"] + e["q"]["y"]) * c).alias("y"), (s["a"] + c).alias("a"))

    return F.aggregate(_edges(ring), zero, add, lambda s: F.struct(F.try_divide(s["x"], 3 * s["a"]).alias("x"), F.try_divide(s["y"], 3 * s["a"]).alias("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting."""
    crossings = F.filter(_edges(ring), lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < F.try_divide((e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]), e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    return F.size(crossings) % 2 == 1


def geodesic_area(ring: Column) -> Column:
    """Square metres of a ring in degrees, on the authalic sphere (an approximation to the ellipsoid)."""
    r = A * math.sqrt(0.5 * (1 + (1 - 0.00669437999014) / math.sqrt(0.00669437999014) * math.atanh(math.sqrt(0.00669437999014))))
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda a, e: a + F.radians(e["q"]["x"] - e["p"]["x"]) * (2 + F.sin(F.radians(e["p"]["y"])) + F.sin(F.radians(e["q"]["y"]))))) * r * r / 2


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, turning left, first point not repeated; collinear points have no hull."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        raise ValueError("a hull needs three points that aren't on a line")

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(half(p) + half(p[::-1]))
    if len(ring) < 3:
        raise ValueError("a hull needs three points that aren't on a line")
    return ring


def hulls(points: DataFrame, by: str) -> DataFrame:
    """Per group its hull: n vertices and area. Each partition's hulls first, so a hot group is small when it meets."""

    def part(batches):
        for b in batches:
            for key, rows in b.groupby(by):
                xy = rows[["x", "y"]].to_numpy(float)
                try:
                    xy = hull(xy)
                except ValueError:
                    xy = np.unique(xy, axis=0)[[0, -1]] if len(np.unique(xy, axis=0)) > 2 else np.unique(xy, axis=0)
                yield pd.DataFrame({by: key, "x": xy[:, 0], "y": xy[:, 1]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        xy = hull(rows[["x", "y"]].to_numpy(float))
        nxt = np.roll(xy, -1, axis=0)
        return pd.DataFrame({by: rows[by].iloc[:1], "n": [len(xy)], "area": [float((xy[:, 0] * nxt[:, 1] - nxt[:, 0] * xy[:, 1]).sum() / 2)]})

    kind = dict(points.dtypes)[by]
    few = points.select(by, "x", "y").mapInPandas(part, f"{by} {kind}, x double, y double")
    return few.groupBy(by).applyInPandas(whole, f"{by} {kind}, n long, area double")


def simplified(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker of a line."""
    keep, stack = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
    keep[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, rest = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        norm = math.hypot(*d)
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / norm if norm else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return xy[keep]


def simplified_ring(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring; one that would have less than four positions stays whole."""
    out = simplified(xy, tolerance)
    return xy if len(out) < 4 else out


def overlay(a: np.ndarray, b: np.ndarray, op: str) -> list[np.ndarray]:
    """Union, intersection or difference of two simple polygons: closed boundary rings, outer ones turning left.

    Edges are cut where they cross; the pieces on the proper side of the other polygon are joined end to end.
    """
    a, b = (p[:-1] if len(p) > 1 and np.allclose(p[0], p[-1]) else p for p in (np.asarray(a, float), np.asarray(b, float)))
    turn = lambda p: p if _signed(p) > 0 else p[::-1]
    a, b = turn(a), turn(b) + np.array([1.7e-9, 2.3e-9])
    pieces = [(p, q) for p, q in _cut(a, b) if _inside(b, (p + q) / 2) == (op == "intersection")]
    other = [(p, q) for p, q in _cut(b, a) if _inside(a, (p + q) / 2) == (op != "union")]
    pieces += [(q, p) for p, q in other] if op == "difference" else other
    at = lambda p: (round(p[0], 7), round(p[1], 7))
    nxt: dict = {}
    for p, q in pieces:
        nxt.setdefault(at(p), []).append(q)
    rings = []
    while nxt:
        start = next(iter(nxt))
        ring, here = [np.array(start)], start
        while here in nxt:
            q = nxt[here].pop()
            if not nxt[here]:
                del nxt[here]
            ring.append(q)
            here = at(q)
        if len(ring) > 3:
            rings.append(np.array(ring))
    return rings


def _signed(p: np.ndarray) -> float:
    n = np.roll(p, -1, axis=0)
    return float((p[:, 0] * n[:, 1] - n[:, 0] * p[:, 1]).sum() / 2)


def _inside(ring: np.ndarray, at: np.ndarray) -> bool:
    n = np.roll(ring, -1, axis=0)
    over = (ring[:, 1] > at[1]) != (n[:, 1] > at[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (n[:, 0] - ring[:, 0]) * (at[1] - ring[:, 1]) / (n[:, 1] - ring[:, 1]) + ring[:, 0]
    return bool((over & (at[0] < x)).sum() % 2)


def _cut(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    d = np.roll(b, -1, axis=0) - b
    for p, q in zip(a, np.roll(a, -1, axis=0)):
        e = q - p
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = e[0] * d[:, 1] - e[1] * d[:, 0]
            t = ((b[:, 0] - p[0]) * d[:, 1] - (b[:, 1] - p[1]) * d[:, 0]) / cross
            u = ((b[:, 0] - p[0]) * e[1] - (b[:, 1] - p[1]) * e[0]) / cross
        cuts = np.sort(t[(cross != 0) & (t > 1e-12) & (t < 1 - 1e-12) & (u >= 0) & (u <= 1)])
        ends = [p, *(p + s * e for s in cuts), q]
        out += list(zip(ends, ends[1:]))
    return out


def rings_overlaid(pairs: DataFrame, op: str) -> DataFrame:
    """Per row (id, a, b: rings) the overlay's rings count, and the sum of their signed areas."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a, b = (np.array([(p["x"], p["y"]) for p in ring]) for ring in (r.a, r.b))
                rings = overlay(a, b, op)
                rows.append((r.id, len(rings), sum(_signed(p[:-1]) for p in rings)))
            yield pd.DataFrame(rows, columns=["id", "rings", "area"])

    return pairs.select("id", "a", "b").mapInPandas(run, "id long, rings long, area double")


def buffered(ring: np.ndarray, metres: float, lat: float) -> np.ndarray:
    """A convex ring in degrees grown by metres: the hull of 32-gons about its vertices in a local frame."""
    if abs(lat) > 89:
        raise ValueError("no buffers within a degree of a pole")
    scale = np.array([DEGREE_M * math.cos(math.radians(lat)), DEGREE_M])
    angle = np.arange(32) * 2 * math.pi / 32
    round_ = metres * np.column_stack([np.cos(angle), np.sin(angle)])
    return hull(((ring * scale)[:, None, :] + round_[None]).reshape(-1, 2)) / scale


OPERATIONS = ("buffer", "union", "intersection", "difference", "convex_hull", "centroid", "simplify")


def processed(rows: DataFrame, operation: str, **options: float) -> DataFrame:
    """One of OPERATIONS, its name in any case, over rows (id, a: ring and, for overlays, b: ring): operation, id, n (rings of
    overlays, positions otherwise) and area (signed; 0 for centroids). Buffers take ``distance_m``, simplifications
    ``tolerance``; other names, a missing option and overlays without a second ring raise."""
    name = operation.lower()
    if name not in OPERATIONS:
        raise ValueError(f"no geometry operation {operation}")
    need = {"buffer": "distance_m", "simplify": "tolerance"}.get(name)
    if need and need not in options:
        raise ValueError(f"{name} needs {need}")
    label = F.lit(name).alias("operation")
    if name in ("union", "intersection", "difference"):
        if "b" not in rows.columns:
            raise ValueError(f"{name} needs a second geometry")
        return rings_overlaid(rows.select("id", "a", "b"), name).select(label, "id", F.col("rings").alias("n"), "area")
    if name == "centroid":
        return rows.select(label, "id", centroid(F.col("a")).isNotNull().cast("long").alias("n"), F.lit(0.0).alias("area"))

    def one(xy: np.ndarray) -> np.ndarray:
        if name == "buffer":
            return buffered(xy, options["distance_m"], float(xy[0, 1]))
        return hull(xy) if name == "convex_hull" else simplified_ring(xy, options["tolerance"])

    def run(batches):
        for batch in batches:
            out = [one(np.array([(p["x"], p["y"]) for p in ring])) for ring in batch["a"]]
            yield pd.DataFrame({"operation": name, "id": batch["id"], "n": [len(r) for r in out], "area": [_signed(r) if len(r) else 0.0 for r in out]})

    return rows.select("id", "a").mapInPandas(run, "operation string, id long, n long, area double")
