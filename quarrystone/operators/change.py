"""Change detection between point-cloud epochs and between model versions, as full outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.catalog import replayed
from quarrystone.operators.spatial import cells

CELL = ["cx", "cy", "cz"]
#: Thresholds of epoch changes, colours by kind, limits of kept versions.
HEIGHT, CONFIDENCE, MODIFIED = 0.3, 0.5, 1.0
COLOURS = {"Addition": (0, 255, 0), "Removal": (255, 0, 0), "Modification": (255, 165, 0), "TerrainChange": (139, 69, 19)}
KEEP_VERSIONS, KEEP_BYTES = 5, 20 << 30


def cell_digests(points: DataFrame, size: float) -> DataFrame:
    """Per cell a digest of its positions that doesn't depend on their order."""
    h = F.xxhash64("x", "y", "z")
    return cells(points, size).groupBy(*CELL).agg(F.bit_xor(h).alias("xor"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))).alias("sum"), F.count("*").alias("n"))


def cell_diff(old: DataFrame, new: DataFrame, size: float) -> DataFrame:
    """Per cell of either: new, removed, changed or same."""
    a, b = cell_digests(old, size), cell_digests(new, size)
    both = a.select(*CELL, F.struct("xor", "sum", "n").alias("a")).join(b.select(*CELL, F.struct("xor", "sum", "n").alias("b")), CELL, "full_outer")
    return both.select(*CELL, F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


def changed_bounds(diff: DataFrame, size: float) -> DataFrame:
    """The box of the new and changed cells; nulls if there are none."""
    own = diff.where(F.col("change").isin("new", "changed"))
    return own.agg(*[(F.min(c) * size).alias(f"min_{c[1]}") for c in CELL], *[((F.max(c) + 1) * size).alias(f"max_{c[1]}") for c in CELL])


def affected_nodes(diff: DataFrame, size: float, extent: float) -> DataFrame:
    """Tiles to build again: the distinct tiles of new, changed and removed cells."""
    step = max(extent, size)
    return diff.where("change <> 'same'").select(*[F.floor(F.col(c) * size / step).alias(f"n{c[1]}") for c in CELL]).distinct()


def points_in_changed(points: DataFrame, diff: DataFrame, size: float) -> DataFrame:
    return cells(points, size).join(diff.where(F.col("change").isin("new", "changed")), CELL, "left_semi").drop(*CELL)


def epoch_changes(a: DataFrame, b: DataFrame, size: float, height: float = HEIGHT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per plan cell the change of mean height: kind, dz, confidence, count, and whether it is reported.

    A missing epoch has mean 0. Additions and removals always name a kind; the rest by thresholds.
    """
    mean = lambda df, n: cells(df, size, ("cx", "cy")).groupBy("cx", "cy").agg(F.avg("z").alias(f"z{n}"), F.count("*").alias(f"n{n}"))
    both = mean(a, "a").join(mean(b, "b"), ["cx", "cy"], "full_outer").fillna(0, ["za", "zb", "na", "nb"])
    dz = F.col("zb") - F.col("za")
    kind = F.when(F.col("na") == 0, "Addition").when(F.col("nb") == 0, "Removal").when(F.abs(dz) <= height, "NoChange").when(F.abs(dz) < MODIFIED, "TerrainChange").otherwise("Modification")
    sure = F.least((F.col("na") + F.col("nb")) / 20.0, F.lit(1.0)) * F.least(F.abs(dz) / 5.0, F.lit(1.0))
    out = both.select("cx", "cy", kind.alias("kind"), dz.alias("dz"), sure.alias("confidence"), (F.col("na") + F.col("nb")).alias("count"))
    return out.withColumn("reported", (F.col("kind") != "NoChange") & (F.col("confidence") >= confidence))


def change_summary(changes: DataFrame, size: float) -> DataFrame:
    own = changes.where("reported")
    area = size * size
    return own.agg(F.count("*").alias("events"), F.coalesce(F.sum(F.when(F.col("dz") > 0, F.col("dz") * area)), F.lit(0.0)).alias("added"), F.coalesce(F.sum(F.when(F.col("dz") < 0, -F.col("dz") * area)), F.lit(0.0)).alias("removed"), (F.count("*") * area).alias("area"))


def colour(kind: Column, dz: Column) -> list[Column]:
    """Red, green, blue and alpha of a change."""
    out = []
    for k in range(3):
        c = F.lit(0)
        for name, rgb in COLOURS.items():
            c = F.when(kind == name, rgb[k]).otherwise(c)
        out.append(c)
    return [*out, (F.least(F.abs(dz) / 5.0, F.lit(1.0)) * 255).cast("int")]


def slider(points: DataFrame, epoch: Column, size: float) -> DataFrame:
    """Changes between each epoch and the one before it, per plan cell: epoch, previous, cx, cy, dz.

    Epochs are few; each is matched with its predecessor, then cells of the two meet in one full outer join.
    """
    own = cells(points.withColumn("epoch", epoch), size, ("cx", "cy")).groupBy("epoch", "cx", "cy").agg(F.avg("z").alias("z"))
    order = own.select("epoch").distinct()
    pairs = order.withColumn("previous", F.lag("epoch").over(Window.orderBy("epoch"))).where("previous is not null")
    later = own.join(pairs, "epoch")
    earlier = own.withColumnRenamed("epoch", "previous").join(pairs, "previous").withColumnRenamed("z", "z0")
    both = later.join(earlier, ["epoch", "previous", "cx", "cy"], "full_outer")
    return both.select("epoch", "previous", "cx", "cy", (F.coalesce("z", F.lit(0.0)) - F.coalesce("z0", F.lit(0.0))).alias("dz"))


ROOTS = {"@label": "name", "@classFullName": "class", "@storey": "storey", "@parent": "parent_express_id"}


def version_changes(old: DataFrame, old_properties: DataFrame, new: DataFrame, new_properties: DataFrame) -> DataFrame:
    """Per element of either version: kind (added, removed, changed, unchanged) and the changed keys in order."""
    value = F.struct("value_text", "value_number", "value_boolean", "units")

    def side(elements: DataFrame, properties: DataFrame, n: str) -> tuple[DataFrame, DataFrame]:
        ids = elements.select("element_row", "global_id")
        props = properties.join(ids, "element_row").groupBy("global_id", "key").agg(F.max_by(value, "property_row").alias(f"v{n}"))
        return elements.select("global_id", F.struct(*[F.col(c).alias(c) for c in ROOTS.values()]).alias(f"e{n}")), props

    (ea, pa), (eb, pb) = side(old, old_properties, "a"), side(new, new_properties, "b")
    keys = pa.join(pb, ["global_id", "key"], "full_outer").where(~F.col("va").eqNullSafe(F.col("vb"))).groupBy("global_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    both = ea.join(eb, "global_id", "full_outer").join(keys, "global_id", "left")
    roots = F.array(*[F.when(~F.col(f"ea.{c}").eqNullSafe(F.col(f"eb.{c}")), F.lit(name)) for name, c in ROOTS.items()])
    every = F.concat(F.filter(roots, lambda x: x.isNotNull()), F.coalesce("keys", F.array().cast("array<string>")))
    kind = F.when(F.col("ea").isNull(), "added").when(F.col("eb").isNull(), "removed").when(F.size(every) > 0, "changed").otherwise("unchanged")
    return both.select("global_id", kind.alias("kind"), F.when(kind == "changed", every).otherwise(F.array().cast("array<string>")).alias("changed_keys"))


def moved(a: Column, b: Column, tolerance: float) -> Column:
    """Whether a coordinate changed: by more than a tolerance, or known on one side only."""
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(F.abs(a - b) > tolerance)


def retained(versions: DataFrame, keep: int = KEEP_VERSIONS, most_bytes: int = KEEP_BYTES) -> DataFrame:
    """Which versions of a base stay: newest first while there are few and small enough; the newest ready one always.

    Failed versions go once a ready one stays. Greedy (a version that is skipped adds no bytes), so it is a replay of each base's
    versions in order, which holds two numbers of a base at a time.
    """

    def step(state: tuple[int, int], row) -> tuple[bool, tuple[int, int]]:
        kept, used = state
        if row.status != "ready":
            return row.status != "error", state
        good = kept == 0 or (kept < keep and used + row.bytes <= most_bytes)
        return good, ((kept + 1, used + row.bytes) if good else state)

    rows = versions.select("base", "version", "created", "status", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    flags = replayed(rows, "base", ["created", "version", "status"], lambda: (0, 0), step, "kept boolean", descending=True)
    ready = versions.groupBy("base").agg(F.max((F.col("status") == "ready").cast("int")).alias("ready_"))
    return flags.join(ready, "base").select("base", "version", F.when(F.col("status") == "error", F.col("ready_") == 0).otherwise(F.col("kept")).alias("kept"))


def newest_versions(versions: DataFrame, base: int, limit: int) -> DataFrame:
    return versions.where(F.col("base") == base).orderBy(F.desc("created"), F.desc("version")).limit(limit)


def assembled(properties: DataFrame) -> DataFrame:
    """Per element its properties as one sorted text; of a repeated key the last."""
    text = F.coalesce("value_text", F.col("value_boolean").cast("string"), F.col("value_number").cast("decimal(18,2)").cast("string"))
    last = properties.groupBy("element_row", "key").agg(F.max_by(text, "property_row").alias("v"))
    return last.groupBy("element_row").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", "v"))), ";").alias("properties"))


def listed(changes: DataFrame, kind: str | None = None, after: str | None = None, limit: int = 50) -> DataFrame:
    """A keyset page of changes by global_id."""
    if kind is not None:
        changes = changes.where(F.col("kind") == kind)
    if after is not None:
        changes = changes.where(F.col("global_id") > after)
    return changes.orderBy("global_id").limit(limit)


def saved_snapshot(points: DataFrame, folder: str, epoch: str, size: float) -> None:
    """A snapshot of an epoch's cells as Parquet, partitioned by epoch; an epoch that is there is replaced."""
    rows = cells(points, size).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z")).withColumn("epoch", F.lit(epoch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(folder)


def loaded_snapshot(spark, folder: str, epoch: str) -> DataFrame:
    """The cells of an epoch; only its partition is read."""
    return spark.read.parquet(folder).where(F.col("epoch") == epoch).drop("epoch")
