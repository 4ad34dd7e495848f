"""Classification, colour and metadata queries (E and H rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import classify as E
from quarrystone.operators import metadata as H
from quarrystone.plans.registry import query

_D2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"
_STATS = f"SELECT a.point_id AS center_id, count(*) AS n, max(sqrt({_D2})) AS far, " + ", ".join(f"covar_pop(b.{a}, b.{b}) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + f" FROM points a JOIN points b ON {_D2} <= 9 GROUP BY 1"
_EIG = f"""WITH s AS ({_STATS}),
p1 AS (SELECT *, xy*xy + xz*xz + yz*yz AS o, (xx + yy + zz) / 3 AS q FROM s),
p2 AS (SELECT *, CASE WHEN o < 1e-12 THEN 1 ELSE greatest(sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * o) / 6), 1e-300) END AS p FROM p1),
p3 AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / pow(p, 3) / 2 AS r FROM p2),
p4 AS (SELECT *, q + 2 * p * cos(acos(greatest(least(r, 1), -1)) / 3) AS a1, q + 2 * p * cos(acos(greatest(least(r, 1), -1)) / 3 + 2 * pi() / 3) AS a3 FROM p3),
e AS (SELECT *, CASE WHEN o < 1e-12 THEN greatest(xx, yy, zz) ELSE a1 END AS e1, CASE WHEN o < 1e-12 THEN xx + yy + zz - greatest(xx, yy, zz) - least(xx, yy, zz) ELSE 3 * q - a1 - a3 END AS e2, CASE WHEN o < 1e-12 THEN least(xx, yy, zz) ELSE a3 END AS e3 FROM p4),
f AS (SELECT center_id, n, CASE WHEN n < 3 THEN 0 ELSE n / (4.0::DOUBLE / 3 * pi() * greatest(pow(far, 3), 0.001)) END AS density, CASE WHEN n < 3 THEN 0 ELSE (e1 - e2) / (e1 + 1e-10) END AS linearity, CASE WHEN n < 3 THEN 0 ELSE (e2 - e3) / (e1 + 1e-10) END AS planarity, CASE WHEN n < 3 THEN 1 ELSE e3 / (e1 + 1e-10) END AS scatter, CASE WHEN n < 3 THEN 1 ELSE greatest(least(1 - e3 / (e1 + 1e-10), 1), 0) END AS normal_z FROM e) """


def _features(t):
    return E.features(t.points, t.points, 3.0)


@query("e01_density", f"SELECT center_id, n, round(CASE WHEN n < 3 THEN 0 ELSE n / (4.0::DOUBLE / 3 * pi() * greatest(pow(far, 3), 0.001)) END, 6) AS density FROM ({_STATS})")
def density(t):
    return _features(t).select("center_id", "n", F.round("density", 6).alias("density"))


@query("e02_geometry", _EIG + "SELECT center_id, round(linearity, 5) AS linearity, round(planarity, 5) AS planarity, round(scatter, 5) + 0.0 AS scatter, round(normal_z, 5) AS normal_z FROM f")
def geometry(t):
    return _features(t).select("center_id", *[(F.round(k, 5) + 0.0).alias(k) for k in E.GEOMETRY])


_M = {"xx": "4 + p_size", "yy": "3 + p_partkey % 7", "zz": "2 + p_partkey % 5", "xy": "p_partkey % 3", "xz": "CAST(0 AS BIGINT)", "yz": "p_partkey % 2"}


@query("e03_eigenvalues", "SELECT p_partkey, round(CAST(9 + p_size + p_partkey % 7 + p_partkey % 5 AS DOUBLE), 6) AS trace, true AS ordered FROM part")
def eigen(t):
    e = E.eigenvalues({k: F.expr(v).cast("double") for k, v in _M.items()})
    rows = t.read("part").select("p_partkey", *[v.alias(f"e{k}") for k, v in enumerate(e)])
    return rows.select("p_partkey", F.round(F.col("e0") + F.col("e1") + F.col("e2"), 6).alias("trace"), ((F.col("e0") >= F.col("e1") - 1e-9) & (F.col("e1") >= F.col("e2") - 1e-9)).alias("ordered"))


_SHAPE = "SELECT p_partkey, (p_size % 12) / 4.0::DOUBLE AS h, (p_partkey % 10) / 10.0::DOUBLE AS planarity, (p_partkey % 11) / 10.0::DOUBLE AS linearity, (p_size % 11) / 10.0::DOUBLE AS scatter, 1 - (p_partkey % 8) / 10.0::DOUBLE AS normal_z FROM part"
_VOTES = f"SELECT *, CASE WHEN h < 0.3 THEN 2 WHEN h < 2 THEN 3 WHEN planarity < 0.7 THEN 5 ELSE 6 END AS v1, CASE WHEN linearity < 0.8 THEN CASE WHEN scatter < 0.9 THEN 0 ELSE 7 END ELSE 14 END AS v2, CASE WHEN normal_z < 0.9 THEN CASE WHEN h < 0.5 THEN 11 ELSE 6 END ELSE 0 END AS v3 FROM ({_SHAPE})"
_CLASS = f"SELECT p_partkey, coalesce((SELECT v FROM (SELECT unnest([v1, v2, v3]) AS v) WHERE v <> 0 GROUP BY v ORDER BY count(*) DESC, v LIMIT 1), 0) AS code FROM ({_VOTES})"


def _codes(t):
    p = t.read("part").selectExpr("p_partkey", "(p_size % 12) / 4D AS h", "(p_partkey % 10) / 10D AS planarity", "(p_partkey % 11) / 10D AS linearity", "(p_size % 11) / 10D AS scatter", "1 - (p_partkey % 8) / 10D AS normal_z")
    return p.select("p_partkey", E.majority(E.votes(*[F.col(k) for k in ("h", "planarity", "linearity", "scatter", "normal_z")])).alias("code"))


query("e04_votes", _CLASS)(_codes)


@query("e05_classify_points", _EIG + "SELECT code, count(*) AS n FROM (SELECT center_id, coalesce((SELECT v FROM (SELECT unnest([v1, v2, v3]) AS v) WHERE v <> 0 GROUP BY v ORDER BY count(*) DESC, v LIMIT 1), 0) AS code FROM (SELECT center_id, CASE WHEN h < 0.3 THEN 2 WHEN h < 2 THEN 3 WHEN planarity < 0.7 THEN 5 ELSE 6 END AS v1, CASE WHEN linearity < 0.8 THEN CASE WHEN scatter < 0.9 THEN 0 ELSE 7 END ELSE 14 END AS v2, CASE WHEN normal_z < 0.9 THEN CASE WHEN h < 0.5 THEN 11 ELSE 6 END ELSE 0 END AS v3 FROM (SELECT f.*, greatest(z - 10, 0) AS h FROM f JOIN points ON point_id = center_id))) GROUP BY 1")
def classify_points(t):
    return E.classified(t.points, _features(t), 10.0).groupBy("code").agg(F.count("*").alias("n"))


@query("e07_labels", f"SELECT code, CASE code WHEN 0 THEN 'Unclassified' WHEN 2 THEN 'Ground' WHEN 3 THEN 'Low Vegetation' WHEN 5 THEN 'High Vegetation' WHEN 6 THEN 'Building' WHEN 7 THEN 'Noise' WHEN 11 THEN 'Road Surface' WHEN 14 THEN 'Power Line' END AS label, count(*) AS n FROM ({_CLASS}) GROUP BY 1, 2")
def labels(t):
    return _codes(t).groupBy("code", E.label(F.col("code")).alias("label")).agg(F.count("*").alias("n"))


_ORTHO = "SELECT point_id, coalesce(v, -1) AS v FROM points p LEFT JOIN raster r ON r.col = CAST(trunc(x / 2.5) AS BIGINT) AND r.row = CAST(trunc((100 - y) / 2.5) AS BIGINT)"


def _ortho(t):
    return E.colour_from_ortho(t.points, t.raster, 0.0, 100.0, 2.5, -1.0)


@query("e08_ortho", f"SELECT point_id, round(v, 6) AS v, CAST(1 AS DOUBLE) AS confidence FROM ({_ORTHO})")
def ortho(t):
    return _ortho(t).withColumn("v", F.round("v", 6))


_CAMERA = "SELECT point_id, coalesce(v, -1) AS v, CASE WHEN v IS NOT NULL THEN 1 / (1 + d / 100) ELSE 0 END AS confidence FROM (SELECT point_id, sqrt(pow(x - 50, 2) + pow(y - 50, 2) + pow(z + 5, 2)) AS d, CAST(trunc(20 * (x - 50) / (z + 5) + 20) AS BIGINT) AS col, CAST(trunc(20 * (y - 50) / (z + 5) + 20) AS BIGINT) AS row FROM points WHERE z + 5 > 0) p LEFT JOIN raster r USING (row, col)"


def _camera(t):
    return E.colour_from_camera(t.points, t.raster, (50, 50, -5), 20.0, (20, 20), -1.0)


@query("e09_camera", f"SELECT point_id, round(v, 6) AS v, round(confidence, 6) AS confidence FROM ({_CAMERA})")
def camera(t):
    return _camera(t).withColumns({c: F.round(c, 6) for c in ("v", "confidence")})


@query("e10_merge_colours", f"SELECT point_id, CASE WHEN sum(confidence) < 0.001 THEN -1 ELSE round(sum(v * confidence) / sum(confidence)) END AS v, round(sum(confidence) / 2, 6) AS confidence FROM (SELECT point_id, v, CAST(1 AS DOUBLE) AS confidence FROM ({_ORTHO}) UNION ALL SELECT * FROM ({_CAMERA})) GROUP BY 1")
def merge(t):
    return E.merged_colours(_ortho(t).union(_camera(t)), 2, -1.0).withColumn("confidence", F.round("confidence", 6))


@query("e11_model_split")
def split(t):
    return t.read("events").select("event_id", E.traffic_split(F.col("user_id"), 0.3).alias("model"), (F.col("event_type") != "error").alias("ok")).groupBy("model").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("good"))


for _name, _args, _where in [
    ("float_above", ("height", ">", 950.0), "height > 950"), ("float_below", ("height", "<", 930.0), "height < 930"), ("float_between", ("height", "between", (920.0, 940.0)), "height BETWEEN 920 AND 940"),
    ("int_above", ("yearBuilt", ">", 40), "yearBuilt > 40"), ("contains", ("name", "contains", "anvil"), "contains(name, 'anvil')"), ("flag", ("flag", "equals", True), "flag"),
]:
    query(f"h01_filter_{_name}", f"SELECT feature FROM building WHERE {_where}")(lambda t, args=_args: H.filtered(t.building, *args).select("feature"))


@query("h02_stats", "SELECT round(min(height), 6) AS min, round(max(height), 6) AS max, round(avg(height), 6) AS mean, count(height) AS count FROM building")
def stats(t):
    return H.stats(t.building, "height").withColumns({c: F.round(c, 6) for c in ("min", "max", "mean")})


@query("h04_feature_table", "SELECT p_brand AS asset, p_type AS class, dense_rank() OVER (ORDER BY p_brand, p_type) - 1 AS feature_id, count(*) AS n FROM part GROUP BY 1, 2")
def features(t):
    return H.feature_table(t.read("part").selectExpr("p_brand AS asset", "p_type AS class"), ["asset", "class"])


@query("h05_class_counts", "SELECT cls, count(*) AS n FROM points GROUP BY 1")
def class_counts(t):
    return H.class_counts(t.points, "cls")


