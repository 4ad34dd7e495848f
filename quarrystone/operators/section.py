"""Sections of closed meshes on any plane: oriented segments, rings, and polygons with their holes.

A triangle that crosses the plane gives one segment, directed so that the solid lies on its left; outer rings then turn
against the clock and holes with it. Segments meet at welded points; rings are found by doubling pointers along them, their areas
are sums over segments, and a hole goes to the smallest outer ring of its mesh that holds it, by counting the crossings of a
ray. Every step is a join or a grouping over segments: no group of a mesh is gathered, however large the mesh.

Triangles: mesh_id, tri_id, and corners ux, uy, uz, vx, ..., wz, seen from outside against the clock. Rings that touch at one welded
point count as one. Chains that don't close are no rings; they are marked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.lineage import settled, spread

BAND, WELD = 1e-4, 1e-4


def frame(normal: tuple[float, float, float]) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """The unit normal n and two unit vectors of its plane, e1 x e2 = n. A normal without direction raises."""
    length = math.sqrt(sum(x * x for x in normal))
    if not math.isfinite(length) or length < 1e-12:
        raise ValueError("a plane's normal needs a direction")
    n = tuple(x / length for x in normal)
    # the axis that the normal leans least to
    k = min(range(3), key=lambda i: abs(n[i]))
    axis = tuple(float(i == k) for i in range(3))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    e2 = cross(n, axis)
    size = math.sqrt(sum(x * x for x in e2))
    e2 = tuple(x / size for x in e2)
    return n, cross(e2, n), e2


def cut(triangles: DataFrame, normal: tuple[float, float, float], offset: float, band: float = BAND) -> DataFrame:
    """mesh_id, tri_id, x0, y0, x1, y1: segments of the plane (points p with n . p = offset, n the unit normal) in its own
    coordinates. Corners within ``band`` of the plane count as above it."""
    n, e1, e2 = frame(normal)
    along = lambda axis, corner: sum((F.col(corner + a) * F.lit(x) for a, x in zip("xyz", axis)), F.lit(0.0))
    named = {f"{p}{name}": along(axis, p) - (offset if name == "d" else 0.0) for p in "uvw" for name, axis in (("d", n), ("a", e1), ("b", e2))}
    # generators stand between the steps, so that the optimizer doesn't write one step's expressions into the next again and again
    rows = triangles.select("mesh_id", "tri_id", F.inline(F.array(F.struct(*[c.alias(k) for k, c in named.items()]))))
    above = lambda p: F.col(p + "d") > -band
    points = []
    for p, q in (("u", "v"), ("v", "w"), ("w", "u")):
        # from the corner below to the one above, so that neighbours compute the same point
        low = lambda x, p=p, q=q: F.when(above(p), F.col(q + x)).otherwise(F.col(p + x))
        high = lambda x, p=p, q=q: F.when(above(p), F.col(p + x)).otherwise(F.col(q + x))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -low("d") / F.nullif(high("d") - low("d"), F.lit(0.0))))
        points.append(F.when(above(p) != above(q), F.struct((low("a") + share * (high("a") - low("a"))).alias("x"), (low("b") + share * (high("b") - low("b"))).alias("y"))))
    hit = F.filter(F.array(*points), lambda x: x.isNotNull())
    # the face's normal along e1 and e2
    side = lambda s, t: (F.col("v" + s) - F.col("u" + s)) * (F.col("w" + t) - F.col("u" + t)) - (F.col("v" + t) - F.col("u" + t)) * (F.col("w" + s) - F.col("u" + s))
    found = rows.select("mesh_id", "tri_id", side("b", "d").alias("n1"), side("d", "a").alias("n2"), F.explode(F.array(hit)).alias("hit")).where(F.size("hit") == 2)
    first, second = F.get("hit", F.lit(0)), F.get("hit", F.lit(1))
    forward = -F.col("n2") * (second["x"] - first["x"]) + F.col("n1") * (second["y"] - first["y"]) >= 0
    start, end = F.when(forward, first).otherwise(second), F.when(forward, second).otherwise(first)
    ends = {"x0": start["x"], "y0": start["y"], "x1": end["x"], "y1": end["y"]}
    return found.select("mesh_id", "tri_id", F.inline(F.array(F.struct(*[c.alias(k) for k, c in ends.items()]))))


def _point(x: str, y: str, weld: float) -> Column:
    return F.xxhash64("mesh_id", F.round(F.col(x) / weld).cast("long"), F.round(F.col(y) / weld).cast("long"))


def ringed(segments: DataFrame, weld: float = WELD, most_rounds: int = 40) -> DataFrame:
    """The segments with ring (a point's number, the same along a chain); points closer than the weld distance are one, and segments
    between one point and itself go. Rounds grow with the logarithm of the longest chain."""
    ends = settled(segments.withColumns({"p": _point("x0", "y0", weld), "q": _point("x1", "y1", weld)}).where("p <> q"))
    points = ends.select(F.col("p").alias("at")).union(ends.select(F.col("q").alias("at"))).distinct()
    ahead = ends.groupBy(F.col("p").alias("at")).agg(F.min("q").alias("ahead"))
    behind = ends.groupBy(F.col("q").alias("at")).agg(F.min("p").alias("behind"))
    nodes = points.join(spread(ahead), "at", "left").join(spread(behind), "at", "left").select("at", F.coalesce("ahead", "at").alias("ahead"), F.coalesce("behind", "at").alias("behind"), F.col("at").alias("ring"))
    nodes = settled(nodes)
    for _ in range(most_rounds):
        to = lambda name: nodes.select(F.col("at").alias(name), F.col(name).alias(f"{name}_next"), F.col("ring").alias(f"{name}_ring"))  # noqa: B023, E731
        step = nodes.join(spread(to("ahead")), "ahead").join(spread(to("behind")), "behind")
        least = F.least("ring", "ahead_ring", "behind_ring")
        moved = settled(step.select("at", F.col("ahead_next").alias("ahead"), F.col("behind_next").alias("behind"), least.alias("ring"), (least != F.col("ring")).alias("moved")))
        nodes = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return ends.join(spread(nodes.select(F.col("at").alias("p"), "ring")), "p")
    raise ValueError(f"a chain has more than 2 ** {most_rounds} points")


def rings(ringed_segments: DataFrame) -> DataFrame:
    """mesh_id, ring, n_points, closed, area (positive: outer, negative: hole; 0 if open), x, y (a point of the ring)."""
    degree = ringed_segments.select("mesh_id", "ring", F.explode(F.array(F.struct(F.col("p").alias("at"), F.lit(1).alias("w")), F.struct(F.col("q").alias("at"), F.lit(-1).alias("w")))).alias("d"))
    even = degree.groupBy("mesh_id", "ring", "d.at").agg(F.sum("d.w").alias("w")).groupBy("mesh_id", "ring").agg(F.count("*").alias("n_points"), (F.sum(F.abs("w")) == 0).alias("closed"))
    area = F.sum(F.expr("(x0 * y1 - x1 * y0) / 2"))
    sums = ringed_segments.groupBy("mesh_id", "ring").agg(area.alias("area"), F.min(F.struct("x0", "y0")).alias("first"))
    joined = even.join(spread(sums), ["mesh_id", "ring"])
    return joined.select("mesh_id", "ring", "n_points", "closed", F.when(F.col("closed"), F.col("area")).otherwise(0.0).alias("area"), F.col("first.x0").alias("x"), F.col("first.y0").alias("y"))


def polygons(segments: DataFrame, weld: float = WELD) -> DataFrame:
    """The closed rings with polygon, the ring of its outline: a hole goes to the smallest larger outer ring around it, or stands alone
    if there is none; a solid inside a hole is a polygon of its own. Rings below the weld distance squared are no rings."""
    own = settled(ringed(segments, weld))
    found = settled(rings(own).where(F.col("closed") & (F.abs("area") > weld * weld)))
    outer = found.where("area > 0").select("mesh_id", "ring", "area")
    holes = found.where("area < 0").select("mesh_id", F.col("ring").alias("hole"), F.col("area").alias("hole_area"), "x", "y")
    # strips of the mean height of a mesh's segments; a segment stands in each that it reaches
    height = own.groupBy("mesh_id").agg(F.greatest(F.avg(F.abs(F.col("y1") - F.col("y0"))), F.lit(weld)).alias("strip"))
    sides = own.join(spread(outer), ["mesh_id", "ring"]).join(spread(height), "mesh_id").where("y0 <> y1")
    strip = lambda y: F.floor(F.col(y) / F.col("strip")) if isinstance(y, str) else F.floor(y / F.col("strip"))
    sides = sides.withColumn("at", F.explode(F.sequence(strip(F.least("y0", "y1")), strip(F.greatest("y0", "y1")))))
    rays = holes.join(spread(height), "mesh_id").withColumn("at", strip("y")).drop("strip")
    crossed = rays.join(spread(sides.select("mesh_id", "ring", "area", "x0", "y0", "x1", "y1", "at")), ["mesh_id", "at"])
    right = (F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))
    right &= F.col("x") < F.col("x0") + (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    around = crossed.where(right & (F.col("area") > -F.col("hole_area"))).groupBy("mesh_id", "hole", "ring", "area").agg(F.count("*").alias("n")).where("n % 2 = 1")
    best = around.groupBy("mesh_id", "hole").agg(F.min(F.struct("area", "ring")).alias("b")).select("mesh_id", F.col("hole").alias("ring"), F.col("b.ring").alias("around"))
    return found.join(spread(best), ["mesh_id", "ring"], "left").select("mesh_id", "ring", "n_points", "area", F.coalesce("around", "ring").alias("polygon"))


def box_triangles(boxes: DataFrame) -> DataFrame:
    """Boxes (mesh_id, box, x, y, z, dx, dy, dz, inward) as twelve triangles each, seen from outside against the clock; those marked
    ``inward`` bound a cavity, so they are turned round."""
    faces = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    corners = [t for a, b, c, d in faces for t in ((a, b, c), (a, c, d))]
    place = lambda k, axis: F.col(axis) + F.when(F.shiftright(k, "xyz".index(axis)).bitwiseAND(1) == 1, F.col("d" + axis)).otherwise(0.0)
    rows = boxes.withColumn("f", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(k).alias(name) for k, name in zip(t, "uvw")]) for n, t in enumerate(corners)])))
    turned = {"u": F.col("f.u"), "v": F.when(F.col("inward"), F.col("f.w")).otherwise(F.col("f.v")), "w": F.when(F.col("inward"), F.col("f.v")).otherwise(F.col("f.w"))}
    return rows.select("mesh_id", (F.col("box") * 12 + F.col("f.n")).alias("tri_id"), *[place(k, axis).alias(p + axis) for p, k in turned.items() for axis in "xyz"])
