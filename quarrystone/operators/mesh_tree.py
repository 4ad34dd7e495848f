"""A tile tree over triangles: material groups, split level by level at the middle of the longest axis, until a tile keeps a budget.

A level is one scan: open nodes' boxes and counts by a grouping, then every triangle of a node over the budget goes to the near
or the far half by its centroid. Where all centroids fall on one side (many copies of a place), the node is split by count: near
triangles are numbered by Spark slice by slice and the first half goes near, so a tile over the budget can't remain. Triangles of
closed nodes take no part in later levels, and only a count of open nodes reaches the driver.

A level costs the driver a dozen jobs, so levels are rounds of Spark only while a node has more than WHOLE triangles. A smaller node goes
to one task, which splits it on by the same rules.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystone.operators.lineage import settled, spread

#: Rows of a slice of identifiers; a slice is what one task counts.
SLICE = 1 << 16
#: The most triangles of a node that one task splits to its end.
WHOLE = 1 << 18


def centroids(triangles: DataFrame) -> DataFrame:
    return triangles.withColumns({f"c{a}": (F.col("u" + a) + F.col("v" + a) + F.col("w" + a)) / 3 for a in "xyz"})


def _pick(axis: Column, of: dict[str, Column]) -> Column:
    return F.when(axis == 0, of["x"]).when(axis == 1, of["y"]).otherwise(of["z"])


def _halved_by_count(rows: DataFrame) -> DataFrame:
    """near of rows (material, path, tri_id, total): the first half of a node's rows in order of tri_id.

    Rows are counted by node and slice of identifiers; what lies before a slice is a sum over slices, and only the slice that holds
    the middle is numbered row by row. A slice has at most SLICE identifiers, so no task sorts a node.
    """
    part = rows.withColumn("slice", F.floor(F.col("tri_id") / SLICE))
    sizes = part.groupBy("material", "path", "slice").agg(F.count("*").alias("n"))
    keys = ["material", "path"]
    ahead = sizes.alias("a").join(spread(sizes.select(*keys, F.col("slice").alias("earlier"), F.col("n").alias("m"))), keys).where("earlier < slice").groupBy(*keys, "slice").agg(F.sum("m").alias("before"))
    placed = part.join(spread(sizes.join(spread(ahead), [*keys, "slice"], "left").select(*keys, "slice", F.coalesce("before", F.lit(0)).alias("before"), "n")), [*keys, "slice"])
    half = F.floor((F.col("total") + 1) / 2)
    # slices wholly on one side need no numbers
    split = (F.col("before") < half) & (F.col("before") + F.col("n") > half)
    ids = placed.where(split).groupBy(*keys, "slice").agg(F.sort_array(F.collect_list("tri_id")).alias("ids"), F.first(half - F.col("before")).alias("k"))
    cut = ids.select(*keys, "slice", F.element_at("ids", F.col("k").cast("int")).alias("last"))
    joined = placed.join(spread(cut), [*keys, "slice"], "left")
    return joined.withColumn("near", F.when(split, F.col("tri_id") <= F.col("last")).otherwise(F.col("before") < half)).drop("slice", "before", "n", "last")


def _at_least(a: float | None, b: float | None) -> bool:
    """a >= b as Spark has it: a null compares to nothing, NaN is the largest number."""
    if a is None or b is None:
        return False
    return a != a or (b == b and a >= b)


def _near(at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of a node's centroids (rows; three columns) are in the near half of its longest axis; unknown ones are not."""
    low, high = [], []
    for a in range(3):
        values = at[known[:, a], a]
        low.append(float(np.fmin.reduce(values)) if len(values) else None)
        high.append(float(np.max(values)) if len(values) else None)
    size = [None if lo is None else hi - lo for lo, hi in zip(low, high)]
    axis = 0 if _at_least(size[0], size[1]) and _at_least(size[0], size[2]) else 1 if _at_least(size[1], size[2]) else 2
    if low[axis] is None:
        return np.zeros(len(at), bool)
    middle = (low[axis] + high[axis]) / 2
    values = at[:, axis]
    return known[:, axis] & (~np.isnan(values) if middle != middle else values < middle)


def _finished(budget: int, most_levels: int):
    """The tree below a node of at most WHOLE triangles: material, tri_id, path; the path is null where ``most_levels`` don't suffice."""

    def split(node: pa.Table) -> pa.Table:
        # in order of tri_id, as a split by count is
        node = node.take(pc.sort_indices(node["tri_id"]))
        columns = [node[c].combine_chunks() for c in ("cx", "cy", "cz")]
        with np.errstate(all="ignore"):
            at = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], axis=1)
            paths: list[str | None] = [None] * len(node)
            open_ = [(node["path"][0].as_py(), np.arange(len(node)))]
            while open_:
                path, rows = open_.pop()
                if len(rows) <= budget:
                    for r in rows:
                        paths[r] = path
                elif len(path) + 1 < most_levels:
                    near = _near(at[rows], known[rows])
                    if near.all() or not near.any():
                        near = np.arange(len(rows)) < (len(rows) + 1) // 2
                    open_ += [(path + "0", rows[near]), (path + "1", rows[~near])]
        return node.select(["material", "tri_id"]).append_column("path", pa.array(paths, pa.string()))

    return split


def mesh_tree(triangles: DataFrame, budget: int, most_levels: int = 48) -> DataFrame:
    """Triangles (tri_id whole numbers, distinct in a material; material; corners) with path: of the tile that holds it, a digit a
    level (0 near, 1 far). Every triangle is in one tile, and no tile has more than ``budget`` triangles. A null material is one of its own.
    """
    if budget < 1:
        raise ValueError("a tile holds one triangle at least")
    rows = centroids(triangles).withColumns({"material": F.coalesce(F.col("material").cast("string"), F.lit("")), "path": F.lit("")})
    own = [c for c in rows.columns if c not in ("cx", "cy", "cz")]
    tree = settled(rows.select("material", "tri_id", "path", "cx", "cy", "cz"))
    small: list[DataFrame] = []
    keys = ["material", "path"]
    for _ in range(most_levels):
        bounds = [f(c).alias(f"{name}{c[1]}") for name, f in (("low", F.min), ("high", F.max)) for c in ("cx", "cy", "cz")]
        nodes = settled(tree.groupBy(*keys).agg(F.count("*").alias("total"), *bounds))
        over = nodes.where(F.col("total") > max(budget, WHOLE))
        if over.isEmpty():
            small.append(tree)
            below = reduce(DataFrame.unionByName, small).groupBy(*keys)
            found = settled(below.applyInArrow(_finished(budget, most_levels), StructType().add("material", "string").add("tri_id", tree.schema["tri_id"].dataType).add("path", "string")))
            if not found.where("path is null").isEmpty():
                break
            return rows.select(*[c for c in own if c != "path"]).join(spread(found), ["material", "tri_id"])
        small.append(tree.join(spread(nodes.where(F.col("total") <= max(budget, WHOLE)).select(*keys)), keys, "left_semi"))
        size = {a: F.col("high" + a) - F.col("low" + a) for a in "xyz"}
        axis = F.when((size["x"] >= size["y"]) & (size["x"] >= size["z"]), 0).when(size["y"] >= size["z"], 1).otherwise(2)
        middle = _pick(F.col("axis"), {a: (F.col("low" + a) + F.col("high" + a)) / 2 for a in "xyz"})
        planes = over.withColumn("axis", axis).select(*keys, "total", "axis", middle.alias("middle"))
        sided = settled(tree.join(spread(planes), keys).withColumn("near", _pick(F.col("axis"), {a: F.col("c" + a) for a in "xyz"}) < F.col("middle")))
        split = sided.groupBy(*keys).agg(F.count_if("near").alias("n_near"), F.max("total").alias("of"))
        flat = settled(split.where("n_near = 0 or n_near = of").select(*keys))
        even = sided.select(*keys, "tri_id", "cx", "cy", "cz", "near")
        if not flat.isEmpty():
            counted = _halved_by_count(sided.join(spread(flat), keys, "left_semi").drop("near", "axis", "middle")).select(*keys, "tri_id", "cx", "cy", "cz", "near")
            even = even.join(spread(flat), keys, "left_anti").unionByName(counted)
        tree = settled(even.select("material", "tri_id", F.concat("path", F.when(F.col("near"), "0").otherwise("1")).alias("path"), "cx", "cy", "cz"))
    raise ValueError(f"tiles over the budget remain after {most_levels} levels")


def tile_table(tiled: DataFrame) -> DataFrame:
    """Every tile and every node above it: material, path, level, triangles, and whether it is a leaf."""
    leaves = tiled.groupBy("material", "path").agg(F.count("*").alias("triangles"))
    nodes = leaves.select("material", "path", "triangles", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("level"))
    up = nodes.groupBy("material", F.expr("substring(path, 1, level)").alias("path"), "level").agg(F.sum("triangles").alias("triangles"), F.max(F.col("level") == F.length("path")).alias("leaf"))
    return up.select("material", "path", "level", "triangles", "leaf")
