"""A tree of tiles over Gaussian splats.

A tile with at most ``most`` splats is a leaf and shows all of them; every node above shows the ``most`` splats with the largest
opacity times area of all below it. They are merged from the deepest level upwards: a node is made from what its at most eight
children show, so no task ever holds more than eight tiles, and as the largest of the whole are among the largest of the parts, a
node's splats are the largest of its whole subtree. Equal scores go to the smaller id. Tiles' boxes hold all splats below at three sigma.

Defined cases: splats with a null place, opacity or scale raise, as a cloud that a reader gave has none; an empty table raises too; more
than ``most`` splats that no split of MAX_DEPTH levels parts raise; in a tree that is asked to be less deep, the leaves of its last level
hold all splats of their cells, however many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators import tiling as C
from quarrystone.operators.lineage import settled

#: Fixed value: reach of a splat in standard deviations.
SIGMAS = 3.0


def extents(splats: DataFrame) -> DataFrame:
    """Splats (x, y, z, scale_0..2 as logarithms, rot_0..3 with the scalar part first) with low and high: the box of three sigma. The
    reach along an axis is the length of the rotation's row with its columns stretched by the scales."""
    q = [F.col("q_")[k] for k in range(4)]
    size = F.sqrt(sum((F.col(f"rot_{k}") * F.col(f"rot_{k}") for k in range(1, 4)), F.col("rot_0") * F.col("rot_0")))
    # a rotation of length 0 is none
    unit = splats.withColumn("size_", size).withColumn("q_", F.when(F.col("size_") > 0, F.array(*[F.col(f"rot_{k}") / F.col("size_") for k in range(4)])).otherwise(F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)])))
    w, x, y, z = q
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    reach = [F.lit(SIGMAS) * F.sqrt(sum((F.pow(r[k] * F.exp(F.col(f"scale_{k}")), F.lit(2.0)) for k in range(1, 3)), F.pow(r[0] * F.exp(F.col("scale_0")), F.lit(2.0)))) for r in rows]
    out = unit.withColumn("reach_", F.array(*reach))
    corner = lambda sign: F.struct(*[(F.col(a) + sign * F.col("reach_")[k]).alias(a) for k, a in enumerate("xyz")])
    return out.withColumns({"low": corner(-1), "high": corner(1)}).drop("reach_", "q_", "size_")


def splat_tree(splats: DataFrame, score: Column, most: int = C.MAX_SPLATS, key: str = "id", max_depth: int = C.MAX_DEPTH) -> DataFrame:
    """The splats of every tile: the splats' columns, ``node`` (octant digits, '' the root), ``leaf``, ``score``."""
    if splats.where(score.isNull() | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).limit(1).count():
        raise ValueError("a splat has no place, opacity or scale")
    if splats.isEmpty():
        raise ValueError("the capture holds no splats")
    tree = settled(C.octree(splats, most, max_depth, min_extent=0.0).withColumnRenamed("path", "node").withColumn("score", score).withColumn("leaf", F.lit(True)))
    top = tree.groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.length("node"))).first()
    if top[0] > most and max_depth >= C.MAX_DEPTH:
        raise ValueError(f"{top[0]} splats lie in one cell of the deepest level, more than the {most} of a tile")
    w = Window.partitionBy("node").orderBy(F.desc("score"), key)
    levels, shown = [], None
    for level in range(top[1], -1, -1):
        here = tree.where(F.length("node") == level)
        if shown is not None:
            up = shown.withColumns({"node": F.expr(f"substring(node, 1, {level})"), "leaf": F.lit(False)})
            here = here.unionByName(up.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= most).drop("rank_"))
        shown = settled(here)
        levels.append(shown)
    return reduce(DataFrame.unionByName, levels)


def tiles(tree: DataFrame) -> DataFrame:
    """A row a tile: node, leaf, splats, the box of all splats below (low, high; from the leaves' ``extents``), and geometric_error:
    of a leaf 0, else half the diagonal of its cell, which is the box of all places halved a level at a time."""
    low, high = C.bounds(tree.where("leaf"))
    half = sum((b - a) ** 2 for a, b in zip(low, high)) ** 0.5 / 2
    shown = tree.groupBy("node").agg(F.count("*").alias("splats"), F.bool_and("leaf").alias("leaf"))
    ends = [f(f"{end}.{a}").alias(f"{end}_{a}") for end, f in (("low", F.min), ("high", F.max)) for a in "xyz"]
    leaves = extents(tree.where("leaf")).groupBy("node").agg(*ends)
    up = leaves.withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.length("node")), lambda k: F.substring("node", F.lit(1), k))))
    boxes = up.groupBy("node").agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in leaves.columns if c != "node"])
    return shown.join(boxes, "node").withColumn("geometric_error", F.when(F.col("leaf"), 0.0).otherwise(F.lit(half) / F.pow(F.lit(2.0), F.length("node"))))


def tileset(tree: DataFrame) -> DataFrame:
    """A tileset JSON a tile (path, text): its box, error and content, and its children by their own JSON files."""
    table = tiles(tree)
    kids = table.where("node <> ''").groupBy(F.expr("substring(node, 1, length(node) - 1)").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("kids"))
    parts = table.select(F.col("node").alias("kid"), *[F.col(c).alias(f"kid_{c}") for c in table.columns if c not in ("node", "leaf", "splats")])
    file = lambda n, end: F.concat(F.when(n == "", "root").otherwise(n), F.lit(end))

    def box(prefix: str) -> Column:
        low, high = ([F.col(f"{prefix}{end}_{a}") for a in "xyz"] for end in ("low", "high"))
        half = [(b - a) / 2 for a, b in zip(low, high)]
        axes = [half[k] if k == j else F.lit(0.0) for k in range(3) for j in range(3)]
        return F.struct(F.array(*[(a + b) / 2 for a, b in zip(low, high)], *axes).alias("box"))

    child = F.struct(box("kid_").alias("boundingVolume"), F.col("kid_geometric_error").alias("geometricError"), F.struct(file(F.col("kid"), ".json").alias("uri")).alias("content"))
    below = kids.select("node", F.explode("kids").alias("kid")).join(parts, "kid").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("kid", child.alias("tile")))).alias("below"))
    own = F.struct(box("").alias("boundingVolume"), F.col("geometric_error").alias("geometricError"), F.lit("REPLACE").alias("refine"), F.struct(file(F.col("node"), ".ply").alias("uri")).alias("content"), F.transform("below", lambda b: b["tile"]).alias("children"))
    rows = table.join(below, "node", "left")
    return rows.select(file(F.col("node"), ".json").alias("path"), F.to_json(F.struct(F.struct(F.lit("1.1").alias("version")).alias("asset"), F.col("geometric_error").alias("geometricError"), own.alias("root"))).alias("text"))


def write_splats(tree: DataFrame, folder: str) -> DataFrame:
    """Every tile as a splat file and its JSON in a shared folder; returns path and bytes. Files are PLY, as the compressed format
    of the web needs a codec of its own."""
    from quarrystone.operators import sinks

    named = tree.withColumns({"file_": F.when(F.col("node") == "", "root").otherwise(F.col("node")), "n": F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "id"))})
    texts = tileset(tree).select("path", F.encode("text", "UTF-8").alias("content"))
    return sinks.save(sinks.splat_files(named, "file_").select("path", "content").unionByName(texts), folder)
