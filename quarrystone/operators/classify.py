"""Point classification and colours, as column expressions over neighbourhood aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.lineage import spread
from quarrystone.operators.spatial import neighbours

#: Class codes and labels.
LABELS = {0: "Unclassified", 2: "Ground", 3: "Low Vegetation", 5: "High Vegetation", 6: "Building", 7: "Noise", 11: "Road Surface", 14: "Power Line"}
GEOMETRY = ("linearity", "planarity", "scatter", "normal_z")


def eigenvalues(c: dict[str, Column]) -> list[Column]:
    """The eigenvalues of a symmetric 3 x 3 matrix (xx, yy, zz, xy, xz, yz), largest first, in closed form."""
    off = F.pow(c["xy"], 2) + F.pow(c["xz"], 2) + F.pow(c["yz"], 2)
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    spread = F.sqrt((F.pow(c["xx"] - q, 2) + F.pow(c["yy"] - q, 2) + F.pow(c["zz"] - q, 2) + 2 * off) / 6)
    p = F.when(off < 1e-12, 1.0).otherwise(F.greatest(spread, F.lit(1e-300)))
    b = {k: (v - q if k[0] == k[1] else v) / p for k, v in c.items()}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    phi = F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3
    e1, e3 = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    by_size = F.array_sort(F.array(c["xx"], c["yy"], c["zz"]))
    return [F.when(off < 1e-12, by_size[2 - k]).otherwise(v) for k, v in enumerate((e1, 3 * q - e1 - e3, e3))]


def features(centers: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Per center: neighbours, density, linearity, planarity, scatter, normal_z from the points within a radius.

    Fewer than three neighbours give density and geometry of their defaults (0, 0, 1, 1).
    """
    near = neighbours(centers, points, radius, places=True)
    cov = lambda a, b: F.covar_pop(a, b)
    stats = near.groupBy("center_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *[cov(a, b).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    e1, e2, e3 = eigenvalues({k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")})
    e = stats.select("center_id", "n", "far", e1.alias("e1"), e2.alias("e2"), e3.alias("e3"))
    scatter = F.col("e3") / (F.col("e1") + 1e-10)
    values = {"linearity": (F.col("e1") - F.col("e2")) / (F.col("e1") + 1e-10), "planarity": (F.col("e2") - F.col("e3")) / (F.col("e1") + 1e-10), "scatter": scatter, "normal_z": F.greatest(F.least(1 - scatter, F.lit(1.0)), F.lit(0.0))}
    default = {"linearity": 0.0, "planarity": 0.0, "scatter": 1.0, "normal_z": 1.0}
    few = F.col("n") < 3
    density = F.col("n") / (4 / 3 * math.pi * F.greatest(F.pow("far", 3), F.lit(0.001)))
    return e.select("center_id", "n", F.when(few, 0.0).otherwise(density).alias("density"), *[F.when(few, default[k]).otherwise(v).alias(k) for k, v in values.items()])


def votes(height: Column, planarity: Column, linearity: Column, scatter: Column, normal_z: Column) -> list[Column]:
    """The votes of the three fixed trees. Thresholds and codes."""
    by_height = F.when(height < 0.3, 2).when(height < 2.0, 3).when(planarity < 0.7, 5).otherwise(6)
    by_shape = F.when(linearity < 0.8, F.when(scatter < 0.9, 0).otherwise(7)).otherwise(14)
    by_normal = F.when(normal_z < 0.9, F.when(height < 0.5, 11).otherwise(6)).otherwise(0)
    return [by_height, by_shape, by_normal]


def majority(codes: list[Column]) -> Column:
    """The commonest code but 0; of equally common ones the lowest; 0 without any."""
    every = F.filter(F.array(*codes), lambda c: c != 0)
    best = F.array_sort(F.transform(F.array_distinct(every), lambda c: F.struct((-F.size(F.filter(every, lambda d: d == c))).alias("n"), c.alias("c"))))
    return F.when(F.size(every) == 0, 0).otherwise(F.get(best, F.lit(0))["c"])


def label(code: Column) -> Column:
    out = F.lit("Other")
    for k, name in LABELS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def classified(points: DataFrame, shapes: DataFrame, ground: float) -> DataFrame:
    """Points with their shapes' class: code and label."""
    rows = points.join(spread(shapes), points.point_id == shapes.center_id)
    code = majority(votes(F.greatest(F.col("z") - ground, F.lit(0.0)), *[F.col(k) for k in ("planarity", "linearity", "scatter", "normal_z")]))
    return rows.withColumn("code", code).withColumn("label", label(F.col("code")))


FALLBACK_CONFIDENCE = 0.7


def modelled(points: DataFrame, names: list[str], model=None) -> DataFrame:
    """Points (with their built-in ``code``) with the codes and confidences of a model over the feature columns ``names``.

    The model takes a batch's features as a pandas frame and returns codes and confidences; where it fails or gives another
    number of them, the batch keeps its built-in codes with confidence 0.7, as all points do without a model.
    """
    if model is None:
        return points.withColumn("confidence", F.lit(FALLBACK_CONFIDENCE))

    def run(batches):
        for batch in batches:
            batch["confidence"] = FALLBACK_CONFIDENCE
            try:
                codes, confidences = model(batch[names])
            except Exception:  # noqa: BLE001 - whatever a model raises, the built-in classes stand in
                codes = confidences = []
            if len(codes) == len(confidences) == len(batch):
                batch["code"], batch["confidence"] = list(codes), list(confidences)
            yield batch

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(run, f"{kinds}, confidence double")


def colour_from_ortho(points: DataFrame, pixels: DataFrame, west: float, north: float, size: float, default: float) -> DataFrame:
    """The nearest pixel's value (pixels: row, col, v); points outside have the default, with confidence 1 as all."""
    px, py = ((F.col("x") - west) / size).cast("long"), ((north - F.col("y")) / size).cast("long")
    rows = points.withColumn("col", px).withColumn("row", py).join(pixels, ["row", "col"], "left")
    return rows.select("point_id", F.coalesce("v", F.lit(default)).alias("v"), F.lit(1.0).alias("confidence"))


def colour_from_camera(points: DataFrame, pixels: DataFrame, at: tuple, focal: float, centre: tuple, default: float) -> DataFrame:
    """A pinhole camera that looks along +z: the pixel of points in front of it, confidence 1 / (1 + d / 100)."""
    dx, dy, dz = (F.col(a) - c for a, c in zip("xyz", at))
    rows = points.withColumn("dz", dz).withColumn("d", F.sqrt(dx * dx + dy * dy + dz * dz))
    front = F.col("dz") > 0
    px = F.when(front, (focal * dx / F.col("dz") + centre[0]).cast("long"))
    py = F.when(front, (focal * dy / F.col("dz") + centre[1]).cast("long"))
    rows = rows.withColumn("col", px).withColumn("row", py).join(pixels, ["row", "col"], "left")
    return rows.select("point_id", F.coalesce("v", F.lit(default)).alias("v"), F.when(F.col("v").isNotNull(), 1 / (1 + F.col("d") / 100)).otherwise(0.0).alias("confidence"))


def merged_colours(sets: DataFrame, n_sets: int, default: float) -> DataFrame:
    """Colours of several sets by confidence: v and confidence over the number of sets; too little weight: the default."""
    w = F.sum("confidence")
    return sets.groupBy("point_id").agg(F.when(w < 0.001, default).otherwise(F.round(F.sum(F.col("v") * F.col("confidence")) / w)).alias("v"), (w / n_sets).alias("confidence"))


def traffic_split(key: Column, share: float) -> Column:
    """Model B for a share of the keys, by hash."""
    return F.when(F.pmod(F.xxhash64(key), F.lit(1000)) / 1000 < share, "B").otherwise("A")
