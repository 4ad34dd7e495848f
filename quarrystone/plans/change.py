"""Change queries (D rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import change as D
from quarrystone.plans.registry import query

_CELL = "CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, CAST(floor(z / 5) AS BIGINT) AS cz"
_SIDE = f"SELECT {_CELL}, count(*) AS n, string_agg(round(x, 6) || ',' || round(y, 6) || ',' || round(z, 6), ';' ORDER BY x, y, z) AS h FROM {{}} GROUP BY 1, 2, 3"
_DIFF = f"SELECT coalesce(a.cx, b.cx) AS cx, coalesce(a.cy, b.cy) AS cy, coalesce(a.cz, b.cz) AS cz, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change FROM ({_SIDE.format('cells_old')}) a FULL JOIN ({_SIDE.format('cells_new')}) b ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz"


def _diff(t):
    return D.cell_diff(t.cells_old, t.cells_new, 5.0)


@query("d01_cell_digests", f"SELECT {_CELL}, count(*) AS n FROM cells_old GROUP BY 1, 2, 3")
def digests(t):
    return D.cell_digests(t.cells_old, 5.0).select(*D.CELL, "n")


query("d02_cell_diff", _DIFF)(_diff)


@query("d03_changed_bounds", f"SELECT " + ", ".join(f"CAST(min(c{a}) * 5 AS DOUBLE) AS min_{a}, CAST((max(c{a}) + 1) * 5 AS DOUBLE) AS max_{a}" for a in "xyz") + f" FROM ({_DIFF}) WHERE change IN ('new', 'changed')")
def bounds(t):
    return D.changed_bounds(_diff(t), 5.0)


@query("d05_affected_nodes", "SELECT DISTINCT " + ", ".join(f"CAST(floor(c{a} * 5.0 / 20) AS BIGINT) AS n{a}" for a in "xyz") + f" FROM ({_DIFF}) WHERE change <> 'same'")
def nodes(t):
    return D.affected_nodes(_diff(t), 5.0, 20.0)


@query("d06_changed_points", f"SELECT point_id FROM cells_new WHERE (CAST(floor(x / 5) AS BIGINT), CAST(floor(y / 5) AS BIGINT), CAST(floor(z / 5) AS BIGINT)) IN (SELECT (cx, cy, cz) FROM ({_DIFF}) WHERE change IN ('new', 'changed'))")
def changed_points(t):
    return D.points_in_changed(t.cells_new, _diff(t), 5.0).select("point_id")


_MEAN = "SELECT CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, avg(z) AS z, count(*) AS n FROM {} GROUP BY 1, 2"
_EPOCH = f"""SELECT *, kind <> 'NoChange' AND confidence >= 0.5 AS reported FROM (SELECT cx, cy, dz, na + nb AS count,
CASE WHEN na = 0 THEN 'Addition' WHEN nb = 0 THEN 'Removal' WHEN abs(dz) <= 0.3 THEN 'NoChange' WHEN abs(dz) < 1 THEN 'TerrainChange' ELSE 'Modification' END AS kind,
least((na + nb) / 20.0::DOUBLE, 1) * least(abs(dz) / 5, 1) AS confidence
FROM (SELECT coalesce(a.cx, b.cx) AS cx, coalesce(a.cy, b.cy) AS cy, coalesce(b.z, 0) - coalesce(a.z, 0) AS dz, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM ({_MEAN.format('epoch_a')}) a FULL JOIN ({_MEAN.format('epoch_b')}) b ON a.cx = b.cx AND a.cy = b.cy))"""


def _epochs(t):
    return D.epoch_changes(t.epoch_a, t.epoch_b, 5.0)


@query("d07_epoch_changes", f"SELECT cx, cy, kind, round(dz, 6) AS dz, round(confidence, 6) AS confidence, count, reported FROM ({_EPOCH})")
def epochs(t):
    return _epochs(t).withColumns({c: F.round(c, 6) for c in ("dz", "confidence")})


@query("d07_epoch_summary", f"SELECT count(*) AS events, round(coalesce(sum(CASE WHEN dz > 0 THEN dz * 25 END), 0), 4) AS added, round(coalesce(sum(CASE WHEN dz < 0 THEN -dz * 25 END), 0), 4) AS removed, CAST(count(*) * 25 AS DOUBLE) AS area FROM ({_EPOCH}) WHERE reported")
def summary(t):
    return D.change_summary(_epochs(t), 5.0).withColumns({c: F.round(c, 4) for c in ("added", "removed")})


@query("d08_change_colours", f"SELECT cx, cy, CASE kind WHEN 'Addition' THEN 0 WHEN 'Removal' THEN 255 WHEN 'Modification' THEN 255 WHEN 'TerrainChange' THEN 139 ELSE 0 END AS r, CASE kind WHEN 'Addition' THEN 255 WHEN 'Modification' THEN 165 WHEN 'TerrainChange' THEN 69 ELSE 0 END AS g, CAST(trunc(255 * least(abs(dz) / 5, 1)) AS INT) AS a FROM ({_EPOCH}) WHERE kind <> 'NoChange'")
def colours(t):
    r, g, _, a = D.colour(F.col("kind"), F.col("dz"))
    return _epochs(t).where("kind <> 'NoChange'").select("cx", "cy", r.alias("r"), g.alias("g"), a.alias("a"))


@query(
    "d09_time_slider",
    """WITH own AS (SELECT CAST(year(observed) AS INT) AS epoch, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, avg(z) AS z FROM points GROUP BY 1, 2, 3),
p AS (SELECT epoch, lag(epoch) OVER (ORDER BY epoch) AS previous FROM (SELECT DISTINCT epoch FROM own)),
l AS (SELECT own.epoch, previous, cx, cy, z FROM own JOIN p ON p.epoch = own.epoch WHERE previous IS NOT NULL),
e AS (SELECT p.epoch, p.previous, cx, cy, z FROM own JOIN p ON p.previous = own.epoch)
SELECT coalesce(l.epoch, e.epoch) AS epoch, coalesce(l.previous, e.previous) AS previous, coalesce(l.cx, e.cx) AS cx, coalesce(l.cy, e.cy) AS cy, round(coalesce(l.z, 0) - coalesce(e.z, 0), 6) AS dz FROM l FULL JOIN e ON l.epoch = e.epoch AND l.cx = e.cx AND l.cy = e.cy""",
)
def slider(t):
    return D.slider(t.points, F.year("observed"), 5.0).withColumn("dz", F.round("dz", 6))


_VALUE = "coalesce(value_text, '~') || '|' || coalesce(CAST(value_number AS VARCHAR), '~') || '|' || coalesce(CAST(value_boolean AS VARCHAR), '~') || '|' || coalesce(units, '~')"
_P = "SELECT e.global_id, p.key, max_by({v}, property_row) AS v FROM {p} p JOIN {e} e ON e.element_row = p.element_row GROUP BY 1, 2"
_VERSIONS = f"""
WITH k AS (SELECT coalesce(a.global_id, b.global_id) AS global_id, string_agg(coalesce(a.key, b.key), ',' ORDER BY coalesce(a.key, b.key)) AS keys FROM ({_P.format(v=_VALUE, p='properties', e='elements')}) a FULL JOIN ({_P.format(v=_VALUE, p='properties_v2', e='elements_v2')}) b ON a.global_id = b.global_id AND a.key = b.key WHERE a.v IS DISTINCT FROM b.v GROUP BY 1),
m AS (SELECT coalesce(a.global_id, b.global_id) AS global_id, a.global_id IS NULL AS added, b.global_id IS NULL AS removed, concat_ws(',', CASE WHEN a.name IS DISTINCT FROM b.name THEN '@label' END, CASE WHEN a.class IS DISTINCT FROM b.class THEN '@classFullName' END, CASE WHEN a.storey IS DISTINCT FROM b.storey THEN '@storey' END, CASE WHEN a.parent_express_id IS DISTINCT FROM b.parent_express_id THEN '@parent' END, keys) AS every FROM elements a FULL JOIN elements_v2 b ON a.global_id = b.global_id LEFT JOIN k ON k.global_id = coalesce(a.global_id, b.global_id))
SELECT global_id, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN every <> '' THEN 'changed' ELSE 'unchanged' END AS kind, CASE WHEN added OR removed THEN '' ELSE every END AS changed_keys FROM m"""


def _versions(t):
    return D.version_changes(t.elements, t.properties, t.elements_v2, t.properties_v2)


@query("d10_version_changes", _VERSIONS)
def versions(t):
    return _versions(t).withColumn("changed_keys", F.array_join("changed_keys", ","))


@query("d11_changed_keys", f"SELECT k AS key, count(*) AS n FROM (SELECT unnest(string_split(changed_keys, ',')) AS k FROM ({_VERSIONS}) WHERE changed_keys <> '') GROUP BY 1")
def changed_keys(t):
    return _versions(t).select(F.explode("changed_keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("d13_location_changed", "SELECT a.point_id, abs(a.x - b.x) > 1e-8 OR abs(a.z - b.z) > 1e-3 AS changed FROM cells_old a JOIN cells_new b ON a.point_id = b.point_id")
def locations(t):
    b = t.cells_new.select("point_id", F.col("x").alias("x2"), F.col("z").alias("z2"))
    return t.cells_old.join(b, "point_id").select("point_id", (D.moved(F.col("x"), F.col("x2"), 1e-8) | D.moved(F.col("z"), F.col("z2"), 1e-3)).alias("changed"))


@query("d14_list_changes", f"SELECT * FROM ({_VERSIONS}) WHERE kind = 'changed' AND global_id > 'C12' ORDER BY global_id LIMIT 50")
def list_changes(t):
    return D.listed(_versions(t), "changed", "C12", 50).withColumn("changed_keys", F.array_join("changed_keys", ","))


_MV = "SELECT doc_id % 20 AS base, doc_id AS version, doc_id AS created, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ready' END AS status, n_chars AS bytes FROM documents"


def _model_versions(t):
    return t.read("documents").selectExpr("doc_id % 20 AS base", "doc_id AS version", "doc_id AS created", "CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ready' END AS status", "n_chars AS bytes")


@query("d15_versions_newest", f"SELECT version, status FROM ({_MV}) WHERE base = 3 ORDER BY created DESC LIMIT 30")
def newest(t):
    return D.newest_versions(_model_versions(t), 3, 30).select("version", "status")


@query(
    "d16_retention",
    f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created DESC) AS rn FROM ({_MV}) WHERE status = 'ready'),
g AS (SELECT base, version, rn, CAST(1 AS BIGINT) AS kept, bytes AS used, true AS keep FROM v WHERE rn = 1
UNION ALL SELECT v.base, v.version, v.rn, CASE WHEN g.kept < 5 AND g.used + v.bytes <= 9000 THEN g.kept + 1 ELSE g.kept END, CASE WHEN g.kept < 5 AND g.used + v.bytes <= 9000 THEN g.used + v.bytes ELSE g.used END, g.kept < 5 AND g.used + v.bytes <= 9000 FROM g JOIN v ON v.base = g.base AND v.rn = g.rn + 1)
SELECT base, version, keep AS kept FROM g UNION ALL SELECT base, version, false FROM ({_MV}) WHERE status = 'error'""",
)
def retention(t):
    return D.retained(_model_versions(t), 5, 9000)


@query("d12_element_properties", f"SELECT element_row, string_agg(key || '=' || v, ';' ORDER BY key) AS properties FROM (SELECT element_row, key, max_by(coalesce(value_text, CAST(value_boolean AS VARCHAR), CAST(CAST(value_number AS DECIMAL(18,2)) AS VARCHAR)), property_row) AS v FROM properties GROUP BY 1, 2) GROUP BY 1")
def element_properties(t):
    return D.assembled(t.properties)
