"""Geostatistics and geoprocessing queries (G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import geometry as V
from quarrystone.operators import geostat as G
from quarrystone.plans.registry import query

_GRID = "SELECT CAST(i // 20 AS INT) AS row, CAST(i % 20 AS INT) AS col, (i % 20 + 0.5) * 0.5::DOUBLE AS gx, (i // 20 + 0.5) * 0.5::DOUBLE AS gy FROM range(400) t(i)"
_IDW = f"SELECT row, col, coalesce(min_by(value, id) FILTER (d < 1e-10), sum(value / (d * d)) / sum(1 / (d * d))) AS value FROM (SELECT g.row, g.col, s.id, s.value, sqrt(pow(gx - x, 2) + pow(gy - y, 2)) AS d FROM ({_GRID}) g, samples s) GROUP BY 1, 2"


def _grid(t):
    return G.grid(t.spark, 0.0, 0.0, 10.0, 10.0, 0.5)


@query("g01_idw", f"SELECT row, col, round(value, 6) AS value FROM ({_IDW})")
def idw(t):
    return G.idw(_grid(t), t.samples).select("row", "col", F.round("value", 6).alias("value"))


_PAIRS = "SELECT CAST(floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 1.3::DOUBLE) AS INT) AS bin, pow(a.value - b.value, 2) AS d2 FROM samples a JOIN samples b ON a.id < b.id"
_BINS = f"SELECT bin, avg(d2) / 2 AS semivariance, count(*) AS pairs FROM ({_PAIRS}) WHERE bin < 6 GROUP BY 1"


@query("g02_variogram", f"SELECT bin, round(semivariance, 4) AS semivariance, pairs FROM ({_BINS})")
def variogram(t):
    return G.variogram(t.samples, 1.3, 6).withColumn("semivariance", F.round("semivariance", 4))


@query("g03_variogram_fit", f"SELECT round(0.3 * min_by(semivariance, bin), 4) AS nugget, round(max(semivariance), 4) AS sill, round(0.6 * (max(bin) + 0.5) * 1.3, 6) + CAST(0 AS DOUBLE) AS reach FROM ({_BINS})")
def fit(t):
    f = G.fitted(G.variogram(t.samples, 1.3, 6), 1.3)
    return f.select(F.round("nugget", 4).alias("nugget"), F.round("sill", 4).alias("sill"), F.round("reach", 6).alias("reach"))


@query("g04_semivariance", "SELECT p_partkey, CASE WHEN p_size = 0 THEN 0 ELSE round(CASE WHEN p_size >= 30 THEN 10 ELSE 1 + 9 * (1.5 * (p_size / 30) - 0.5 * pow(p_size / 30, 3)) END, 6) END AS spherical, round(1 + 9 * (1 - exp(-3 * p_size / 30)), 6) AS exponential, round(1 + 9 * (1 - exp(-3 * pow(p_size / 30, 2))), 6) AS gaussian, round(1 + 9 * least(p_size / 30, 1), 6) AS linear, round(1 + 9 * least(pow(p_size / 30, 1.5), 1), 6) AS power FROM part WHERE p_size > 0")
def semivariance(t):
    lag = F.col("p_size").cast("double")
    return t.read("part").where("p_size > 0").select("p_partkey", *[F.round(G.semivariance(m, lag, 1.0, 10.0, 30.0), 6).alias(m) for m in ("spherical", "exponential", "gaussian", "linear", "power")])


@query("g05_ordinary_kriging")
def ordinary(t):
    return G.kriging(_grid(t), t.samples, 1.0, 10.0, 6.0)


@query("g06_simple_kriging")
def simple(t):
    return G.kriging(_grid(t), t.samples, 1.0, 10.0, 6.0, "simple", 5000.0)


@query("g07_universal_kriging")
def universal(t):
    few = t.samples.unionByName(t.spark.createDataFrame([(9001, 2.5, 3.5, 100.0), (9002, 7.5, 8.5, 300.0)], "id long, x double, y double, value double"))
    return G.kriging(_grid(t), few, 1.0, 10.0, 6.0, "universal")


@query("g09_grid_stats", f"SELECT round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM ({_IDW})")
def grid_stats(t):
    v = G.idw(_grid(t), t.samples)
    return v.agg(F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))


_BOX = "SELECT s_suppkey AS id, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 % 10 AS DOUBLE) AS y, 1 + s_suppkey % 3 AS w, 2 + s_suppkey % 2 AS h FROM supplier"


def _boxes(t):
    b = t.read("supplier").selectExpr("s_suppkey AS id", "CAST(s_suppkey % 10 AS DOUBLE) AS x", "CAST(s_suppkey div 10 % 10 AS DOUBLE) AS y", "CAST(1 + s_suppkey % 3 AS DOUBLE) AS w", "CAST(2 + s_suppkey % 2 AS DOUBLE) AS h")
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    return b.withColumn("ring", F.array(p("x", "y"), p("x + w", "y"), p("x + w", "y + h"), p("x", "y + h")))


def _pairs(t):
    b = _boxes(t).select("id", F.col("ring").alias("a"))
    return b.withColumn("b", F.transform("a", lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.75).alias("y"))))


@query("g12_buffer")
def buffer(t):
    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            rings = [V.buffered(np.array([(p["x"], p["y"]) for p in r]), 1000.0, float(r[0]["y"])) for r in batch["ring"]]
            yield pd.DataFrame({"id": batch["id"], "n": [len(r) for r in rings], "area": [V._signed(r) for r in rings]})

    return _boxes(t).select("id", "ring").mapInPandas(run, "id long, n long, area double")


_OVER = f"SELECT id, CAST(1 AS BIGINT) AS rings, w * h AS own, (w - 0.5) * (h - 0.75) AS common FROM ({_BOX})"
for _name, _op, _area in (("g13_union", "union", "2 * own - common"), ("g14_intersection", "intersection", "common"), ("g15_difference", "difference", "own - common")):
    query(_name, f"SELECT id, rings, round(CAST({_area} AS DOUBLE), 4) AS area FROM ({_OVER})")(lambda t, op=_op: V.rings_overlaid(_pairs(t), op).withColumn("area", F.round("area", 4)))


@query("g16_convex_hull")
def hull(t):
    return V.hulls(t.points.select("cls", "x", "y"), "cls")


@query("g17_centroid", f"SELECT id, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy, CAST(w * h AS DOUBLE) AS area FROM ({_BOX})")
def centroid(t):
    c = V.centroid(F.col("ring"))
    return _boxes(t).select("id", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), V.area(F.col("ring")).alias("area"))


@query("g18_simplify")
def simplify(t):
    import numpy as np
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        xy = rows.sort_values("row")[["row", "v"]].to_numpy(float)
        return pd.DataFrame({"col": rows["col"].iloc[:1], "kept": [len(V.simplified(np.asarray(xy), 3.0))]})

    return t.raster.where("v is not null").groupBy("col").applyInPandas(one, "col int, kept long")


@query("g19_point_in_polygon", f"SELECT id, x + 0.5 > x AND x + 0.5 < x + w AND y + 1.5 < y + h AS inside FROM ({_BOX})")
def inside(t):
    return _boxes(t).select("id", V.contains(F.col("ring"), F.col("x") + 0.5, F.col("y") + 1.5).alias("inside"))


@query("g20_geodesic_area")
def geodesic(t):
    return _boxes(t).select("id", F.round(V.geodesic_area(F.col("ring")), 0).alias("m2"))
