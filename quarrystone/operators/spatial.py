"""Point-cloud queries. Joins between points go through cell keys, never through nested loops."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quarrystone.operators.lineage import settled, spread, written

#: The shares of a bounding box that count as volume and surface.
VOLUME_SHARE, SURFACE_SHARE = 0.6, 0.8
#: Radii that a block's side has; the most points or centers of a block that one task searches, and the pairs that it holds at a time.
BLOCK, MOST_POINTS, MOST_PAIRS = 16, 1 << 18, 1 << 20


def cells(points: DataFrame, size: float, names: tuple[str, ...] = ("cx", "cy", "cz")) -> DataFrame:
    """Points with their grid cell."""
    return points.withColumns({n: F.floor(F.col(a) / size) for n, a in zip(names, "xyz")})


def squared_distance(a: list, b: list) -> Column:
    return sum((F.pow(p - q, 2) for p, q in zip(a[1:], b[1:])), F.pow(a[0] - b[0], 2))


def radius_search(points: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    """Points within a radius, inclusive, with their distance. The box in front lets Parquet skip row groups."""
    box = [F.col(a).between(c - radius, c + radius) for a, c in zip("xyz", center)]
    d2 = squared_distance([F.col(a) for a in "xyz"], [F.lit(float(c)) for c in center])
    return points.where(box[0] & box[1] & box[2]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).withColumn("distance", F.sqrt("d2")).drop("d2")


def neighbours(centers: DataFrame, points: DataFrame, radius: float, key: str = "point_id", places: bool = False) -> DataFrame:
    """Pairs (center_id, point_id, distance) within a radius, by an equi-join on cells of the radius's size; with ``places``
    also the point's x, y, z.

    Each center looks into 27 cells; both sides are shuffled, and a hot cell is split by adaptive execution as any skewed join is.
    """
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])).alias("s")
    left = centers.select(F.col(key).alias("center_id"), *[F.col(a).alias(f"q{a}") for a in "xyz"], step)
    left = left.select("center_id", "qx", "qy", "qz", *[(F.floor(F.col(f"q{a}") / radius) + F.col(f"s.{n}")).alias(f"c{a}") for a, n in zip("xyz", "ijk")])
    right = cells(points.select(key, "x", "y", "z"), radius)
    near = left.join(spread(right), ["cx", "cy", "cz"]).withColumn("d2", squared_distance([F.col("qx"), F.col("qy"), F.col("qz")], [F.col("x"), F.col("y"), F.col("z")]))
    return near.where(F.col("d2") <= radius * radius).select("center_id", F.col(key).alias("point_id"), F.sqrt("d2").alias("distance"), *(["x", "y", "z"] if places else []))


def nearest(points: DataFrame, center: tuple[float, float, float], k: int, cell: float) -> DataFrame:
    """The k nearest points of one place (fewer if the rest are beyond 1024 cells); ties by point_id."""
    d2 = squared_distance([F.col(a) for a in "xyz"], [F.lit(float(c)) for c in center])
    return points.withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= 1024 * cell).orderBy("distance", "point_id").limit(k)


def _pairs(q: np.ndarray, own: np.ndarray, p: np.ndarray, codes: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest places p (in order of their ids) of each center q within a radius: center, distance, place; nearest first."""
    cell_p, cell_q = np.floor(p / radius), np.floor(q / radius)
    low = np.minimum(cell_p.min(axis=0), cell_q.min(axis=0)) - 1
    cell_p, cell_q = (cell_p - low).astype(np.int64), (cell_q - low).astype(np.int64)
    ny, nz = (int(max(cell_p[:, a].max(), cell_q[:, a].max())) + 2 for a in (1, 2))
    key = (cell_p[:, 0] * ny + cell_p[:, 1]) * nz + cell_p[:, 2]
    order = np.argsort(key, kind="stable")
    key, p, codes = key[order], p[order], codes[order]
    columns = np.stack([((cell_q[:, 0] + i) * ny + cell_q[:, 1] + j) * nz + cell_q[:, 2] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=1)
    start = np.searchsorted(key, columns - 1, "left")
    sizes = np.searchsorted(key, columns + 1, "right") - start
    ends = np.cumsum(sizes.sum(axis=1))
    out, at = [], 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, "right")))
        n = sizes[at:to].ravel()
        center = at + np.repeat(np.arange(n.size) // 9, n)
        place = np.repeat(start[at:to].ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
        x, y, z = (q[center, a] - p[place, a] for a in range(3))
        d2 = x * x + y * y + z * z
        near = (d2 <= radius * radius) & (codes[place] != own[center])
        center, place, distance = center[near], order[place[near]], np.sqrt(d2[near])
        by = np.lexsort((place, distance, center))
        center, place, distance = center[by], place[by], distance[by]
        best = np.arange(len(center)) - np.searchsorted(center, center, "left") < k
        out.append((center[best], distance[best], place[best]))
        at = to
    return tuple(np.concatenate(c) for c in zip(*out))


def _block_search(k: int, radius: float):
    """The k nearest points within a radius of a block's centers. Where points are dense, smaller radii come first, and a center is done once
    its k-th point is nearer than the radius."""

    def search(centers: pa.Table, points: pa.Table) -> pa.Table:
        points = points.take(pc.sort_indices(points["point_id"]))
        ids = points["point_id"].combine_chunks()
        if len(centers) and len(points):
            known = ids.dictionary_encode()
            codes, own = known.indices.to_numpy(), pc.index_in(centers["center_id"], value_set=known.dictionary).fill_null(-1).to_numpy()
            p, q = (np.stack([t[f"{at}{a}"].to_numpy() for a in "xyz"], axis=1) for t, at in ((points, ""), (centers, "q")))
            cells_held = len(np.unique(np.floor(p / radius), axis=0))
            halvings = max(0, int(np.log2(27 * len(p) / cells_held / (8 * k)) / 3)) if 27 * len(p) > cells_held * 8 * k else 0
            open_, parts = np.arange(len(q)), []
            for n in range(halvings, -1, -1):
                within = radius / 2**n
                center, distance, place = _pairs(q[open_], own[open_], p, codes, k, within)
                full = np.ones(len(open_), bool)
                if n:
                    last = np.bincount(center, minlength=len(open_)) == k
                    far = np.zeros(len(open_))
                    far[center] = distance
                    full = last & (far < within)
                parts.append((open_[center[full[center]]], distance[full[center]], place[full[center]]))
                open_ = open_[~full]
                if not len(open_):
                    break
            center, distance, place = (np.concatenate(c) for c in zip(*parts))
        else:
            center, distance, place = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, center[1:] != center[:-1]]) if len(center) else np.zeros(0, np.int64)
        near = pa.StructArray.from_arrays([pa.array(distance), ids.take(pa.array(place))], ["distance", "point_id"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(center)], pa.int32()), near)
        return pa.table({"center_id": centers["center_id"].combine_chunks().take(pa.array(center[first])), "near": lists})

    return search


def _nearest_within(centers: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest points within a radius of each center that has any: center_id, near (distance, point_id; nearest first).

    A center goes to its block, of 16 radii a side, and a point also to the blocks that it is within a radius of, in all less than one and
    a half times; a task searches a block. Blocks of more than MOST_POINTS are left to a join on cells, which Spark can split.
    """
    side, reach = BLOCK * radius, radius * (1 + 1e-9)
    finite = reduce(Column.__and__, [F.abs(F.col(a)) < float("inf") for a in "xyz"]) & F.col("point_id").isNotNull()
    centers, points = centers.select("point_id", "x", "y", "z").where(finite), points.select("point_id", "x", "y", "z").where(finite)
    blocks = ["bx", "by", "bz"]
    asked = centers.select(F.col("point_id").alias("center_id"), *[F.col(a).alias(f"q{a}") for a in "xyz"], *[F.floor(F.col(a) / side).alias(b) for a, b in zip("xyz", blocks)])
    dealt = points
    for a, b in zip("xyz", blocks):
        dealt = dealt.withColumn(b, F.explode(F.sequence(F.floor((F.col(a) - reach) / side), F.floor((F.col(a) + reach) / side))))
    many = settled(reduce(DataFrame.union, [df.groupBy(*blocks).count().where(F.col("count") > MOST_POINTS).select(*blocks) for df in (asked, dealt)]).distinct())
    crowded = not many.isEmpty()
    if crowded:
        pressed = asked.join(spread(many), blocks, "left_semi").select(F.col("center_id").alias("point_id"), *[F.col(f"q{a}").alias(a) for a in "xyz"])
        asked, dealt = (df.join(spread(many), blocks, "left_anti") for df in (asked, dealt))
    id_type = points.schema["point_id"].dataType
    shape = StructType().add("center_id", id_type).add("near", ArrayType(StructType().add("distance", "double").add("point_id", id_type)))
    found = asked.groupBy(*blocks).cogroup(dealt.groupBy(*blocks)).applyInArrow(_block_search(k, radius), shape)
    if crowded:
        near = neighbours(pressed, points, radius).where("center_id <> point_id")
        rank = F.row_number().over(Window.partitionBy("center_id").orderBy("distance", "point_id"))
        best = near.withColumn("rank", rank).where(F.col("rank") <= k)
        found = found.union(best.groupBy("center_id").agg(F.array_sort(F.collect_list(F.struct("distance", "point_id"))).alias("near")))
    return found


def nearest_each(centers: DataFrame, points: DataFrame, k: int, cell: float, most: float = 1024) -> DataFrame:
    """The k nearest points of each center: center_id, point_id, distance, rank; a center is none of its own.

    Rings double: centers that have k points within the radius are done, the others go on with twice the radius.
    """
    found, left, radius = [], centers, 2 * cell
    while True:
        best = written(_nearest_within(left, points, k, radius))
        full = best.where(F.size("near") == k)
        last = radius >= most * cell
        found.append(best if last else full)
        if not last:
            left = written(left.join(spread(full.select(F.col("center_id").alias("point_id"))), "point_id", "left_anti"))
        if last or left.isEmpty():
            rows = reduce(DataFrame.union, found).select("center_id", F.posexplode("near").alias("at", "n"))
            return rows.select("center_id", "n.point_id", "n.distance", (F.col("at") + 1).alias("rank"))
        radius *= 2


def entity_links(links: DataFrame, entity: int | None = None, kind: str | None = None) -> DataFrame:
    """Links (id, entity_id, type, position) of an entity, of a type, or of both."""
    if entity is not None:
        links = links.where(F.col("entity_id") == entity)
    return links if kind is None else links.where(F.col("type") == kind)


def in_box(points: DataFrame, low: tuple, high: tuple) -> DataFrame:
    for a, lo, hi in zip("xyz", low, high):
        points = points.where(F.col(a).between(lo, hi))
    return points


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a ring of literals; less than three vertices hold nothing."""
    if len(ring) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if yi != yj:
            crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
            crossings = crossings + F.when(crosses, 1).otherwise(0)
    return crossings % 2 == 1


def clip(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points whose x, y lie in a ring; its bounding box is a filter that scans can use."""
    if len(ring) < 3:
        return points.where("false")
    xs, ys = zip(*ring)
    return points.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))).where(in_ring(F.col("x"), F.col("y"), ring))


def volume(points: DataFrame) -> DataFrame:
    """0.6 of the bounding box's volume and 0.8 of its surface; 0 for less than four points."""
    d = [F.max(a) - F.min(a) for a in "xyz"]
    few = F.count("*") < 4
    return points.agg(F.when(few, 0.0).otherwise(d[0] * d[1] * d[2] * VOLUME_SHARE).alias("volume"), F.when(few, 0.0).otherwise((d[0] * d[1] + d[1] * d[2] + d[0] * d[2]) * 2 * SURFACE_SHARE).alias("surface"))


def octant(x: Column, y: Column, z: Column, center: list) -> Column:
    """Octant of a place about a center: bits x = 1, y = 2, z = 4, set from the center on."""
    return sum((F.when(v >= c, 1 << k).otherwise(0) for k, (v, c) in enumerate(zip((x, y, z), center))), F.lit(0))


def tiles_box(low: list[Column], high: list[Column]) -> Column:
    """The 12 numbers of a bounding box volume: center and half axes."""
    mid = [(a + b) / 2 for a, b in zip(low, high)]
    half = [(b - a) / 2 for a, b in zip(low, high)]
    zero = F.lit(0.0)
    return F.array(*mid, half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])


