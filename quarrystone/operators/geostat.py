"""Geostatistics: inverse distances, variograms, kriging. Samples are few by contract (at most 500)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of samples and grids, the distance of a hit and of equal samples, the singular pivot.
MAX_SAMPLES, MAX_CELLS, HIT, SAME, PIVOT = 500, 1_000_000, 1e-10, 1e-9, 1e-12


def checked(samples: DataFrame) -> pd.DataFrame:
    """The samples (id, x, y, value) on the driver, at most 500: finite and at different places, else an error."""
    rows = samples.select("id", "x", "y", "value").orderBy("id").limit(MAX_SAMPLES + 1).toPandas()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    if not np.isfinite(rows[["x", "y", "value"]].to_numpy(float)).all():
        raise ValueError("samples must be finite")
    xy = rows[["x", "y"]].to_numpy(float)
    d = np.hypot(*(xy[:, None, k] - xy[None, :, k] for k in (0, 1)))
    if (d[np.triu_indices(len(rows), 1)] < SAME).any():
        raise ValueError("two samples are at one place")
    return rows


def grid(spark, west: float, south: float, east: float, north: float, size: float) -> DataFrame:
    """Cell centres (row, col, x, y), row 0 in the south; at most a million."""
    cols, rows = math.ceil((east - west) / size), math.ceil((north - south) / size)
    if cols * rows > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    cells = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return cells.withColumn("x", west + (F.col("col") + 0.5) * size).withColumn("y", south + (F.col("row") + 0.5) * size)


def idw(places: DataFrame, samples: DataFrame, power: float = 2.0) -> DataFrame:
    """Inverse-distance values of places (keys row, col); at a sample's place the first such sample's value.

    The samples, at most 500 and checked, go to the places as an array of literals' size.
    """
    s = checked(samples)
    held = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(v)).alias("v")) for _, x, y, v in s.itertuples(index=False)])
    d = F.transform(held, lambda p: F.struct(F.sqrt(F.pow(F.col("x") - p["x"], 2) + F.pow(F.col("y") - p["y"], 2)).alias("d"), p["v"].alias("v")))
    rows = places.withColumn("d", d)
    hit = F.get(F.filter("d", lambda p: p["d"] < HIT), F.lit(0))["v"]
    weight = lambda p: 1 / F.pow(F.greatest(p["d"], F.lit(1e-300)), power)
    top = F.aggregate("d", F.lit(0.0), lambda a, p: a + weight(p) * p["v"])
    bottom = F.aggregate("d", F.lit(0.0), lambda a, p: a + weight(p))
    return rows.withColumn("value", F.coalesce(hit, top / bottom)).drop("d")


def variogram(samples: DataFrame, lag: float, n_lags: int) -> DataFrame:
    """Half the mean squared difference of pairs by distance: bin, semivariance, pairs; bins from n_lags on are left out.

    All samples count, however many: pairs are met once by id through cells as large as the longest distance, each cell with
    itself and the cells around it.
    """
    size = F.lit(float(lag * n_lags))
    cell = lambda a: F.floor(F.col(a) / size)
    a, b = (samples.select(*[F.col(c).alias(c + n) for c in ("id", "x", "y", "value")]) for n in "ab")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    a = a.select("*", around).select("*", (cell("xa") + F.col("s.i")).alias("cx"), (cell("ya") + F.col("s.j")).alias("cy"))
    b = b.withColumn("cx", cell("xb")).withColumn("cy", cell("yb"))
    pairs = a.join(b, ["cx", "cy"]).where(F.col("ida") < F.col("idb"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    bins = pairs.withColumn("bin", (d / lag).cast("int")).where(F.col("bin") < n_lags)
    return bins.groupBy("bin").agg((F.avg(F.pow(F.col("valuea") - F.col("valueb"), 2)) / 2).alias("semivariance"), F.count("*").alias("pairs"))


def semivariance(model: str, lag: Column, nugget: float | Column, sill: float | Column, reach: float | Column, exponent: float = 1.5) -> Column:
    """A variogram model at a distance; 0 at no distance."""
    c, h = F.lit(sill) - F.lit(nugget) if not isinstance(sill, Column) else sill - nugget, lag / reach
    shapes = {
        "spherical": F.when(h >= 1, c).otherwise(c * (1.5 * h - 0.5 * F.pow(h, 3))),
        "exponential": c * (1 - F.exp(-3 * h)),
        "gaussian": c * (1 - F.exp(-3 * h * h)),
        "linear": c * F.least(h, F.lit(1.0)),
        "power": c * F.least(F.pow(h, exponent), F.lit(1.0)),
    }
    return F.when(lag <= 0, 0.0).otherwise(nugget + shapes[model])


def fitted(bins: DataFrame, lag: float) -> DataFrame:
    """The spherical model of a variogram: nugget, sill, reach, r2."""
    ends = bins.agg((0.3 * F.min_by("semivariance", "bin")).alias("nugget"), F.max("semivariance").alias("sill"), (0.6 * (F.max("bin") + 0.5) * lag).alias("reach"), F.avg("semivariance").alias("mean"))
    model = bins.join(F.broadcast(ends)).withColumn("m", semivariance("spherical", (F.col("bin") + 0.5) * lag, F.col("nugget"), F.col("sill"), F.col("reach")))
    spread = F.sum(F.pow(F.col("semivariance") - F.col("mean"), 2))
    return model.groupBy("nugget", "sill", "reach").agg((1 - F.try_divide(F.sum(F.pow(F.col("semivariance") - F.col("m"), 2)), spread)).alias("r2"))


def _gamma(d: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    h = d / reach
    return np.where(d <= 0, 0.0, np.where(h >= 1, sill, nugget + (sill - nugget) * (1.5 * h - 0.5 * h**3)))


def kriging(places: DataFrame, samples: DataFrame, nugget: float, sill: float, reach: float, method: str = "ordinary", mean: float | None = None) -> DataFrame:
    """Kriged value and variance (at least 0) of places, by a spherical model; ``ordinary``, ``simple`` or ``universal``.

    The system of the samples is inverted once on the driver (at most 503 rows) and goes to the tasks with the samples.
    """
    s = checked(samples)
    xy, v = s[["x", "y"]].to_numpy(float), s["value"].to_numpy(float)
    n, centre = len(s), s[["x", "y"]].to_numpy(float).mean(0)
    g = _gamma(np.hypot(*(xy[:, None, k] - xy[None, :, k] for k in (0, 1))), nugget, sill, reach)
    if method == "simple":
        extra, system, known = 0, sill - g, float(v.mean() if mean is None else mean)
    else:
        drift = np.ones((n, 1)) if method == "ordinary" else np.column_stack([np.ones(n), xy - centre])
        extra, known = drift.shape[1], 0.0
        system = np.block([[g, drift], [drift.T, np.zeros((extra, extra))]])
    if n == 0 or np.linalg.matrix_rank(system, tol=PIVOT * max(1.0, np.abs(system).max())) < len(system):
        raise ValueError("the system of the samples is singular")
    inverse = np.linalg.inv(system)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch[["x", "y"]].to_numpy(float)
            right = _gamma(np.hypot(*(xy[:, None, k] - at[None, :, k] for k in (0, 1))), nugget, sill, reach)
            if method == "simple":
                right = sill - right
                w = inverse @ right
                value, variance = known + w.T @ (v - known), sill - (w * right).sum(0)
            else:
                tail = np.ones((1, len(at))) if method == "ordinary" else np.vstack([np.ones(len(at)), (at - centre).T])
                right = np.vstack([right, tail])
                w = inverse @ right
                value, variance = w[:n].T @ v, (w * right).sum(0)
            yield batch.assign(value=value, variance=np.maximum(0, variance))

    from pyspark.sql import types as T

    schema = T.StructType([*places.schema.fields, T.StructField("value", T.DoubleType()), T.StructField("variance", T.DoubleType())])
    return places.mapInPandas(run, schema)
