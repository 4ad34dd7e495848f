"""Octrees, levels of detail, implicit tiles, mesh and splat tiling, plane sections: columns and grouped counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import geodesy as G

#: Octree and budget limits.
MAX_POINTS, MAX_DEPTH, MIN_EXTENT, LEAST_STEP, MOST_STEP, MAX_SPLATS = 20_000, 20, 0.01, 8, 64, 32_768


def bounds(points: DataFrame) -> tuple[list[float], list[float]]:
    row = points.agg(*[F.min(a) for a in "xyz"], *[F.max(a) for a in "xyz"]).first()
    return [float(v) for v in row[:3]], [float(v) for v in row[3:]]


def octree(points: DataFrame, max_points: int = MAX_POINTS, max_depth: int = MAX_DEPTH, min_extent: float = MIN_EXTENT, key: str = "point_id") -> DataFrame:
    """Points with the path of their leaf.

    A point's path is arithmetic on its coordinates, so nothing is shuffled to split: one cell index per axis
    (extent / 2**depth) gives all levels at once. Counts per path are grouped from the deepest level upwards, and a
    point's leaf is its shortest path that is light enough; only the table of counts is joined.
    """
    low, high = bounds(points)
    extent = max(b - a for a, b in zip(low, high))
    depth = 0
    while depth < max_depth and extent / 2**depth >= min_extent:
        depth += 1
    coded = points.withColumn("path_", digits(depth, low, high))
    counts = coded.groupBy("path_").agg(F.count("*").alias("n"))
    levels = counts.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "path_", "n")
    sizes = levels.groupBy("level", F.expr("substring(path_, 1, level)").alias("node")).agg(F.sum("n").alias("n"))
    # the deepest level that is split, per deepest cell: its leaf is one level below
    heavy = sizes.where((F.col("n") > max_points) & (F.col("level") < depth)).select("level", "node")
    splits = levels.withColumn("node", F.expr("substring(path_, 1, level)")).join(heavy, ["level", "node"]).groupBy("path_").agg((F.max("level") + 1).alias("leaf_depth"))
    return coded.join(splits, "path_", "left").withColumn("path", F.expr("substring(path_, 1, coalesce(leaf_depth, 0))")).drop("path_", "leaf_depth")


def digits(depth: int, low: list[float], high: list[float]) -> Column:
    """The octant digits by cell numbers: bit ``depth - 1 - k`` of each axis' cell is the k-th digit's bit."""
    if not depth:
        return F.lit("")
    cells = []
    for a, lo, hi in zip("xyz", low, high):
        size = (hi - lo) / 2**depth
        cell = F.floor((F.col(a) - lo) / size) if size > 0 else F.lit(2**depth - 1)
        cells.append(F.least(cell.cast("long"), F.lit(2**depth - 1).cast("long")))
    out = []
    for k in range(depth):
        bit = [F.shiftright(c, depth - 1 - k).bitwiseAND(F.lit(1)) for c in cells]
        out.append((bit[0] + 2 * bit[1] + 4 * bit[2]).cast("string"))
    return F.concat(*out)


#: Binary digits of the ids of one slice of a node's points.
SLICE_BITS = 16


def decimated(points: DataFrame, max_points: int = MAX_POINTS, node: str = "path", key: str = "point_id") -> DataFrame:
    """Every k-th point of a node in the order of (whole-number) ids, k = count / max held to 8..64: what a parent shows of it.

    A node's points are numbered slice by slice of 65,536 ids, each from the count of the slices before it, so that no task
    sorts all the points of a large node; only the table of counts is summed a node at a time.
    """
    cut = points.withColumn("slice_", F.shiftright(F.col(key).cast("long"), SLICE_BITS))
    counts = cut.groupBy(node, "slice_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(node)
    before = F.coalesce(F.sum("n_").over(w.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.greatest(F.least((F.sum("n_").over(w) / max_points).cast("int"), F.lit(MOST_STEP)), F.lit(LEAST_STEP))
    steps = counts.select(node, "slice_", before.alias("before_"), k.alias("step_"))
    rows = cut.withColumn("rn_", F.row_number().over(Window.partitionBy(node, "slice_").orderBy(key))).join(steps, [node, "slice_"])
    return rows.where((F.col("before_") + F.col("rn_") - 1) % F.col("step_") == 0).select(*points.columns)


def node_table(leaves: DataFrame) -> DataFrame:
    """All nodes above and including the leaves: node, depth, is_leaf, n (points below)."""
    per_leaf = leaves.groupBy("path").agg(F.count("*").alias("n"))
    up = per_leaf.select(F.explode(F.sequence(F.lit(0), F.length("path"))).alias("depth"), "path", "n")
    return up.groupBy("depth", F.expr("substring(path, 1, depth)").alias("node")).agg(F.sum("n").alias("n"), F.max(F.col("depth") == F.length("path")).alias("is_leaf"))


def tree_stats(nodes: DataFrame, max_points: int) -> DataFrame:
    """Nodes, leaves, inner nodes, greatest depth, and points, those that inner nodes repeat included."""
    step = F.greatest(F.least((F.col("n") / max_points).cast("int"), F.lit(MOST_STEP)), F.lit(LEAST_STEP))
    shown = F.when(F.col("is_leaf"), F.col("n")).otherwise(F.ceil(F.col("n") / step))
    return nodes.agg(F.count("*").alias("nodes"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"), F.sum((~F.col("is_leaf")).cast("long")).alias("internal"), F.max("depth").alias("max_depth"), F.sum(shown).alias("total_points"))


def implicit_cells(points: DataFrame, levels: int) -> DataFrame:
    """Occupied cells of an implicit octree: level, x, y, z, node_index. At ``level`` cells are q >> (levels - level - 1)."""
    low, high = bounds(points)
    extent = max(b - a for a, b in zip(low, high))
    scale = (2**levels - 1) / extent if extent > 0 else 0.0
    q = points.select(*[((F.col(a) - lo) * scale).cast("long").alias(a) for a, lo in zip("xyz", low)]).distinct()
    every = q.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    shifted = every.select("level", *[F.expr(f"shiftright({a}, {levels - 1} - level)").alias(a) for a in "xyz"]).distinct()
    return shifted.withColumn("node_index", node_index(F.col("level"), G.morton(F.col("x"), F.col("y"), F.col("z")), 8))


def node_index(level: Column, code: Column, branches: int) -> Column:
    """A node's place in a subtree: nodes of the levels above, then its Morton code within the level."""
    size = F.pow(F.lit(float(branches)), level).cast("long")
    return ((size - 1) / (branches - 1)).cast("long") + F.pmod(code, size)


def running(rows: DataFrame, value: str, order: list, by: list[str] | None = None) -> Column:
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def triangle_stats(triangles: DataFrame) -> DataFrame:
    """Triangles with centroid and half diagonal."""
    low = {a: F.least(*[v + a for v in "uvw"]) for a in "xyz"}
    high = {a: F.greatest(*[v + a for v in "uvw"]) for a in "xyz"}
    half = F.sqrt(sum((F.pow(high[a] - low[a], 2) for a in "yz"), F.pow(high["x"] - low["x"], 2))) / 2
    return triangles.withColumns({**{f"m{a}": (F.col("u" + a) + F.col("v" + a) + F.col("w" + a)) / 3 for a in "xyz"}, "half": half})


def additive_tiles(meshes: DataFrame, budget: int) -> DataFrame:
    """Per group (``grp``) the meshes of the first tile: largest error first while triangles fit; in_first."""
    run = running(meshes, "triangles", [F.desc("error"), "mesh"], ["grp"])
    return meshes.withColumn("in_first", run <= budget)


def parent_content(meshes: DataFrame, budget: int) -> DataFrame:
    """Meshes that a parent shows: largest first until the budget is reached; ratio they are simplified to."""
    own = meshes.withColumn("before", running(meshes, "triangles", [F.desc("error"), "mesh"], ["grp"]) - F.col("triangles"))
    own = own.where(F.col("before") < budget)
    return own.withColumn("ratio", F.least(F.lit(0.5), budget / F.sum("triangles").over(Window.partitionBy("grp")))).drop("before")


def split_by_half(parts: DataFrame) -> DataFrame:
    """Near or far by running triangle counts in the order of centres, per group; the ends are on their own sides."""
    w = Window.partitionBy("grp")
    order = ["centre", "mesh"]
    before = running(parts, "triangles", order, ["grp"]) - F.col("triangles")
    rn, n, total = F.row_number().over(w.orderBy(*order)), F.count("*").over(w), F.sum("triangles").over(w)
    return parts.withColumn("side", F.when(rn == 1, "near").when(rn == n, "far").when(before < total / 2, "near").otherwise("far"))


def welded(vertices: DataFrame, key: list[str], order: str, by: str) -> DataFrame:
    """Vertices with the number of their place, numbered by first use within ``by``; -0 counts as 0."""
    same = [(F.col(c) + 0.0) for c in key]
    first = vertices.withColumn("first_use", F.min(order).over(Window.partitionBy(by, *same)))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy(by).orderBy("first_use")) - 1).drop("first_use")


def mesh_volume(triangles: DataFrame) -> DataFrame:
    """Signed tetrahedra about the origin, summed: |sum| / 6 per mesh."""
    u, v, w = ([F.col(k + a) for a in "xyz"] for k in "uvw")
    det = u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])
    return triangles.groupBy("mesh_id").agg((F.abs(F.sum(det)) / 6).alias("volume"))


def plane_cut(triangles: DataFrame, height: float, band: float = 1e-4) -> DataFrame:
    """Segments in which triangles cross the plane z = height; a vertex within the band counts as on the upper side."""
    side = {k: F.when(F.col(k + "z") - height > -band, 1).otherwise(-1) for k in "uvw"}
    points = []
    for p, q in (("u", "v"), ("v", "w"), ("w", "u")):
        f = (height - F.col(p + "z")) / F.nullif(F.col(q + "z") - F.col(p + "z"), F.lit(0.0))
        at = F.struct(*[(F.col(p + a) + f * (F.col(q + a) - F.col(p + a))).alias(a) for a in "xy"])
        points.append(F.when((side[p] != side[q]) & (F.col(p + "z") != F.col(q + "z")), at))
    hit = F.filter(F.array(*points), lambda x: x.isNotNull())
    rows = triangles.withColumn("hit", hit).where(F.size("hit") == 2)
    return rows.select("mesh_id", "tri_id", *[F.col("hit")[k][a].alias(f"{a}{k}") for k in (0, 1) for a in "xy"])


def chained(segments: pd.DataFrame, tolerance: float = 1e-4) -> list[tuple[list[tuple[float, float]], bool]]:
    """Chains of the segments of one element, each with whether it closes; endpoints on a grid of the tolerance."""
    at = lambda x, y: (round(x / tolerance), round(y / tolerance))
    edges = [(at(*r[:2]), at(*r[2:])) for r in segments[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
    where = {k: (x, y) for r, e in zip(segments[["x0", "y0", "x1", "y1"]].itertuples(index=False), edges) for k, (x, y) in zip(e, (r[:2], r[2:]))}
    ends: dict = {}
    for n, (a, b) in enumerate(edges):
        ends.setdefault(a, []).append(n)
        ends.setdefault(b, []).append(n)
    used, out = set(), []

    def walk(node):
        chain = [node]
        while True:
            n = next((n for n in ends[chain[-1]] if n not in used), None)
            if n is None:
                return chain
            used.add(n)
            a, b = edges[n]
            chain.append(b if a == chain[-1] else a)

    for node in sorted(ends, key=lambda k: (len(ends[k]) != 1, k)):  # open ends first
        while any(n not in used for n in ends[node]):
            chain = walk(node)
            out.append(([where[k] for k in chain], len(chain) > 3 and chain[0] == chain[-1]))
    return out


def section_rings(segments: DataFrame) -> DataFrame:
    """Per mesh its chains: n_points, closed, signed area; the segments of a mesh make one group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chain, closed in chained(rows):
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(chain, chain[1:])) / 2 if closed else 0.0
            out.append((rows["mesh_id"].iloc[0], len(chain), closed, area))
        return pd.DataFrame(out, columns=["mesh_id", "n_points", "closed", "area"])

    return segments.groupBy("mesh_id").applyInPandas(one, "mesh_id string, n_points long, closed boolean, area double")


def splat_score(opacity: Column, scales: list[Column]) -> Column:
    """The logarithm of opacity times area; scales are logarithms, the two largest span the area."""
    by_size = F.array_sort(F.array(*scales))
    return F.log(opacity) + by_size[1] + by_size[2]


def largest_splats(splats: DataFrame, score: Column, node: str, key: str, n: int = MAX_SPLATS) -> DataFrame:
    w = Window.partitionBy(node).orderBy(F.desc("score"), key)
    return splats.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def simplified(triangles: DataFrame, cell: float) -> DataFrame:
    """Vertex clustering: vertices go to their cell's centre, and triangles that collapse or repeat go."""
    snap = lambda c: (F.floor(F.col(c) / cell) + 0.5) * cell
    names = [k + a for k in "uvw" for a in "xyz"]
    s = triangles.withColumns({c: snap(c) for c in names})
    key = {k: F.concat_ws(",", *[F.col(k + a).cast("string") for a in "xyz"]) for k in "uvw"}
    return s.where((key["u"] != key["v"]) & (key["v"] != key["w"]) & (key["u"] != key["w"])).dropDuplicates(["mesh_id", *names])


def validated(tilesets: DataFrame) -> DataFrame:
    """Tileset JSON texts with the list of what is wrong in each."""
    t = F.from_json("json", "asset struct<version:string>, geometricError double, root struct<boundingVolume:struct<box:array<double>,region:array<double>,sphere:array<double>>,geometricError:double,refine:string>")
    volume = F.col("t.root.boundingVolume")
    tests = [
        (F.col("t.asset.version").isNull(), "asset.version"),
        (~F.coalesce(F.col("t.asset.version"), F.lit("1.1")).isin("1.0", "1.1"), "version"),
        (F.col("t.geometricError").isNull() | (F.col("t.geometricError") < 0), "geometricError"),
        (F.col("t.root").isNull(), "root"),
        (F.col("t.root").isNotNull() & (volume.isNull() | (F.coalesce(F.size(volume["box"]), F.lit(0)) != 12) & (F.coalesce(F.size(volume["region"]), F.lit(0)) != 6) & (F.coalesce(F.size(volume["sphere"]), F.lit(0)) != 4)), "boundingVolume"),
    ]
    problems = F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in tests]), lambda x: x.isNotNull())
    return tilesets.withColumn("t", t).withColumn("problems", problems).drop("t")


def building_height(height: Column, levels: Column) -> Column:
    """Metres by the height tag, else 3.2 m a level, else three levels."""
    tag = F.regexp_extract(height, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*m?\s*$", 1).try_cast("double")
    count = F.regexp_extract(levels, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1).try_cast("double")
    return F.coalesce(F.when(tag > 0, tag), F.when(count > 0, count * 3.2), F.lit(9.6))


def css_colour(text: Column) -> Column:
    """A hexadecimal colour of 3 or 6 digits in lower case, else an empty text."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^#([0-9a-f]{3}|[0-9a-f]{6})$"), low).otherwise("")


def shape_keys(triangles: DataFrame) -> DataFrame:
    """Per mesh a key that copies of one shape share: triangles, and mean edge lengths in centimetres."""
    length = lambda p, q: F.sqrt(sum((F.pow(F.col(p + a) - F.col(q + a), 2) for a in "yz"), F.pow(F.col(p + "x") - F.col(q + "x"), 2)))
    return triangles.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.round(F.avg(length("u", "v")), 2).alias("uv"), F.round(F.avg(length("u", "w")), 2).alias("uw"))


def at_or_below(triangles: DataFrame, height: float) -> DataFrame:
    """Triangles cut by z <= height: the polygon that is left, as an array of x, y, z (Sutherland-Hodgman)."""
    parts = []
    for p, q in (("u", "v"), ("v", "w"), ("w", "u")):
        keep = F.col(p + "z") <= height
        f = (height - F.col(p + "z")) / F.nullif(F.col(q + "z") - F.col(p + "z"), F.lit(0.0))
        cut = F.struct(*[(F.col(p + a) + f * (F.col(q + a) - F.col(p + a))).alias(a) for a in "xy"], F.lit(float(height)).alias("z"))
        parts += [F.when(keep, F.struct(*[F.col(p + a).alias(a) for a in "xyz"])), F.when(keep != (F.col(q + "z") <= height), cut)]
    return triangles.withColumn("polygon", F.filter(F.array(*parts), lambda x: x.isNotNull())).where(F.size("polygon") >= 3)


def extruded(buildings: DataFrame) -> DataFrame:
    """Walls of buildings (id, ring, height): two triangles an edge as corner coordinates; the roof is the ring."""
    n = F.size("ring")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("ring", k).alias("p"), F.get("ring", (k + 1) % n).alias("q")))
    rows = buildings.select("id", "height", F.posexplode(edges).alias("edge", "e"))
    low, high = F.lit(0.0), F.col("height")
    corner = lambda k, z: F.struct(F.col(f"e.{k}.x").alias("x"), F.col(f"e.{k}.y").alias("y"), z.alias("z"))
    two = F.array(F.array(corner("p", low), corner("q", low), corner("q", high)), F.array(corner("p", low), corner("q", high), corner("p", high)))
    return rows.select("id", "edge", F.explode(two).alias("triangle"))


def mesh_tiles(triangles: DataFrame, budget: int) -> DataFrame:
    """Triangles with the path of their tile: an octree of centroids, split until a tile has the budget or less."""
    own = triangle_stats(triangles).selectExpr("*", "mx AS x", "my AS y", "mz AS z")
    return octree(own, budget, key="tri_id").drop("x", "y", "z")


def by_material(parts: DataFrame) -> DataFrame:
    """Triangles (material, z) grouped for one draw call each: material, triangles, low (the least z)."""
    return parts.groupBy("material").agg(F.count("*").alias("triangles"), F.min("z").alias("low"))


def terrain_bases(corners: DataFrame, raster: DataFrame) -> DataFrame:
    """A building's base is the least ground height under its corners (id, row, col): id, base."""
    return corners.join(raster, ["row", "col"]).groupBy("id").agg(F.min("v").alias("base"))
