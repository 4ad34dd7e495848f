"""The roles that test tables play, as DataFrames and as DuckDB common tables with the same arithmetic."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey AS point_id", "CAST(o_custkey % 100 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) / 10 AS x", "CAST(o_custkey div 15 AS DOUBLE) AS y", "o_totalprice / 10000 AS z",
            "CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 6 ELSE 5 END AS cls", "CAST(o_orderkey % 1000 AS INT) AS intensity", "o_orderdate AS observed",
        )

    @cached_property
    def epoch_a(self) -> DataFrame:
        return self.points.where("observed < timestamp'1998-04-01' AND x >= 10")

    @cached_property
    def epoch_b(self) -> DataFrame:
        return self.points.where("observed >= timestamp'1998-04-01' AND x < 90")

    @cached_property
    def cells_old(self) -> DataFrame:
        return self.points.where("x >= 10")

    @cached_property
    def cells_new(self) -> DataFrame:
        return self.points.where("x < 90").withColumn("z", F.expr("CASE WHEN x >= 20 AND x < 40 THEN z + 1 ELSE z END"))

    @cached_property
    def elements(self) -> DataFrame:
        """element_row is the express_id, which orders the rows in the same way and needs no global ranking."""
        r = self.read("region").selectExpr("CAST(1000000 + r_regionkey AS BIGINT) AS express_id", "concat('R', r_regionkey) AS global_id", "'Region' AS class", "r_name AS name", "CAST(NULL AS BIGINT) AS parent_express_id", "CAST(NULL AS STRING) AS storey")
        n = self.read("nation").selectExpr("CAST(2000000 + n_nationkey AS BIGINT)", "concat('N', n_nationkey)", "'Nation'", "n_name", "CAST(1000000 + n_regionkey AS BIGINT)", "CAST(NULL AS STRING)")
        c = self.read("customer").selectExpr("3000000 + c_custkey", "concat('C', c_custkey)", "'Customer'", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END", "CAST(2000000 + c_nationkey AS BIGINT)", "c_mktsegment")
        return r.union(n).union(c).withColumn("element_row", F.col("express_id"))

    @cached_property
    def properties(self) -> DataFrame:
        """EAV rows; property_row orders the rows of an element, so that the last of a repeated key is well defined."""
        c, n = self.read("customer"), self.read("nation")
        row = lambda df, at, where, key, text, number, boolean, units: df.where(where).selectExpr(
            *( [f"CAST({'3000000 + c_custkey' if df is c else '2000000 + n_nationkey'} AS BIGINT) AS element_row", f"{at} AS property_row", f"'{key}' AS key", f"CAST({text} AS STRING) AS value_text", f"CAST({number} AS DOUBLE) AS value_number", f"CAST({boolean} AS BOOLEAN) AS value_boolean", f"CAST({units} AS STRING) AS units"])
        )
        parts = [
            row(c, 0, "c_custkey % 3 <> 0", "Acct.Balance", "NULL", "c_acctbal", "NULL", "'usd'"),
            row(n, 0, "true", "Acct.Balance", "NULL", "n_nationkey * 10", "NULL", "'kusd'"),
            row(c, 1, "c_custkey % 4 <> 0", "Seg.Name", "c_mktsegment", "NULL", "NULL", "NULL"),
            row(c, 2, "true", "Flag.Positive", "NULL", "NULL", "c_acctbal > 0", "NULL"),
            row(c, 3, "c_custkey % 2 = 0", "Mixed.Value", "NULL", "c_custkey % 100", "NULL", "NULL"),
            row(c, 3, "c_custkey % 2 <> 0", "Mixed.Value", "concat('v', c_custkey % 7)", "NULL", "NULL", "NULL"),
            row(c, 4, "c_custkey % 50 = 1", "Acct.Balance", "NULL", "c_acctbal + 1", "NULL", "'usd'"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    @cached_property
    def elements_v2(self) -> DataFrame:
        kept = self.elements.where("NOT (class = 'Customer' AND (express_id - 3000000) % 20 = 5)")
        kept = kept.withColumn("storey", F.expr("CASE WHEN class = 'Customer' AND (express_id - 3000000) % 17 = 2 THEN 'MOVED' ELSE storey END"))
        new = self.spark.range(40).selectExpr("9000000 + id AS express_id", "concat('X', id) AS global_id", "'Customer' AS class", "concat('New#', id) AS name", "CAST(2000000 AS BIGINT) AS parent_express_id", "'NEW' AS storey", "9000000 + id AS element_row")
        return kept.unionByName(new)

    @cached_property
    def properties_v2(self) -> DataFrame:
        kept = self.properties.where("NOT (element_row >= 3000000 AND (element_row - 3000000) % 20 = 5)")
        return kept.withColumn("value_number", F.expr("CASE WHEN element_row >= 3000000 AND (element_row - 3000000) % 13 = 4 AND key = 'Acct.Balance' THEN value_number + 1 ELSE value_number END"))

    @cached_property
    def samples(self) -> DataFrame:
        """At most 400 places, as kriging takes no more than 500 samples; every supplier counts in the mean of its place."""
        places = self.read("supplier").groupBy(F.expr("s_suppkey % 400").alias("id")).agg(F.avg("s_acctbal").alias("value"))
        return places.selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x", "CAST(id div 10 AS DOUBLE) AS y", "value")

    @cached_property
    def sites(self) -> DataFrame:
        return self.read("supplier").selectExpr("s_suppkey AS id", "CAST(s_suppkey % 10 AS DOUBLE) AS x", "CAST(s_suppkey div 10 AS DOUBLE) AS y", "s_acctbal AS value")

    @cached_property
    def raster(self) -> DataFrame:
        return self.read("part").selectExpr("CAST(p_partkey div 40 AS INT) AS row", "CAST(p_partkey % 40 AS INT) AS col", "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) + p_retailprice / 10 END AS v")

    @cached_property
    def bands(self) -> DataFrame:
        return self.read("lineitem").selectExpr("CAST(l_partkey div 40 AS INT) AS row", "CAST(l_partkey % 40 AS INT) AS col", "CAST(l_suppkey % 2 AS INT) AS band", "l_shipdate AS day", "1500 + l_quantity * 100 AS v")

    @cached_property
    def triangles(self) -> DataFrame:
        """Three vertices u, v = u + (1 + key % 3, 0, 0), w = u + (0, 2, 1)."""
        a = self.read("part").selectExpr("p_brand AS mesh_id", "p_partkey AS tri_id", "CAST(p_size AS DOUBLE) AS ux", "CAST(p_partkey % 13 AS DOUBLE) AS uy", "p_retailprice / 100 AS uz")
        return a.selectExpr("*", "ux + 1 + tri_id % 3 AS vx", "uy AS vy", "uz AS vz", "ux AS wx", "uy + 2 AS wy", "uz + 1 AS wz")

    @cached_property
    def building(self) -> DataFrame:
        return self.read("part").selectExpr("p_partkey AS feature", "p_retailprice AS height", "CAST(p_size AS BIGINT) AS yearBuilt", "p_name AS name", "p_size > 25 AS flag")

    @cached_property
    def realtime(self) -> DataFrame:
        return self.read("events").selectExpr("event_id AS seq", "event_type AS room", "user_id AS user", "event_id % 3 AS conn", "CASE WHEN value < 10 THEN 'Join' WHEN value < 20 THEN 'Leave' ELSE 'Cursor' END AS type")

    @cached_property
    def requests(self) -> DataFrame:
        return self.read("events").selectExpr("user_id % 10 AS key", "event_id", "ts")

    @cached_property
    def audit(self) -> DataFrame:
        return self.read("events").selectExpr("event_id AS id", "ts AS timestamp", "user_id AS user", "event_type AS action", "get_json_object(props, '$.k') AS resource")

    @cached_property
    def job_runs(self) -> DataFrame:
        return self.read("events").selectExpr("user_id % 20 AS job", "event_id AS seq", "event_type <> 'error' AS ok", "ts")

    @cached_property
    def assets(self) -> DataFrame:
        labels = self.read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        return self.read("documents").join(labels, "doc_id", "left").selectExpr("doc_id AS id", "source AS name", "text AS description", "array(lang) AS tags", "lang AS type", "CASE WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'error' ELSE 'processing' END AS status", "doc_id AS created", "n_chars AS bytes")


_PROPERTY = "SELECT CAST({row} AS BIGINT) AS element_row, {at} AS property_row, '{key}' AS key, CAST({text} AS VARCHAR) AS value_text, CAST({number} AS DOUBLE) AS value_number, CAST({boolean} AS BOOLEAN) AS value_boolean, CAST({units} AS VARCHAR) AS units FROM {table} WHERE {where}"
_ROWS = [
    ("3000000 + c_custkey", 0, "Acct.Balance", "NULL", "c_acctbal", "NULL", "'usd'", "customer", "c_custkey % 3 <> 0"),
    ("2000000 + n_nationkey", 0, "Acct.Balance", "NULL", "n_nationkey * 10", "NULL", "'kusd'", "nation", "true"),
    ("3000000 + c_custkey", 1, "Seg.Name", "c_mktsegment", "NULL", "NULL", "NULL", "customer", "c_custkey % 4 <> 0"),
    ("3000000 + c_custkey", 2, "Flag.Positive", "NULL", "NULL", "c_acctbal > 0", "NULL", "customer", "true"),
    ("3000000 + c_custkey", 3, "Mixed.Value", "NULL", "c_custkey % 100", "NULL", "NULL", "customer", "c_custkey % 2 = 0"),
    ("3000000 + c_custkey", 3, "Mixed.Value", "'v' || (c_custkey % 7)", "NULL", "NULL", "NULL", "customer", "c_custkey % 2 <> 0"),
    ("3000000 + c_custkey", 4, "Acct.Balance", "NULL", "c_acctbal + 1", "NULL", "'usd'", "customer", "c_custkey % 50 = 1"),
]
_NAMES = ("row", "at", "key", "text", "number", "boolean", "units", "table", "where")

CTES = {
    "points": "SELECT o_orderkey AS point_id, CAST(o_custkey % 100 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) / 10 AS x, CAST(o_custkey // 15 AS DOUBLE) AS y, o_totalprice / 10000 AS z, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 6 ELSE 5 END AS cls, CAST(o_orderkey % 1000 AS INT) AS intensity, o_orderdate AS observed FROM orders",
    "epoch_a": "SELECT * FROM points WHERE observed < TIMESTAMP '1998-04-01' AND x >= 10",
    "epoch_b": "SELECT * FROM points WHERE observed >= TIMESTAMP '1998-04-01' AND x < 90",
    "cells_old": "SELECT * FROM points WHERE x >= 10",
    "cells_new": "SELECT * REPLACE (CASE WHEN x >= 20 AND x < 40 THEN z + 1 ELSE z END AS z) FROM points WHERE x < 90",
    "elements": "SELECT *, express_id AS element_row FROM (SELECT CAST(1000000 + r_regionkey AS BIGINT) AS express_id, 'R' || r_regionkey AS global_id, 'Region' AS class, r_name AS name, CAST(NULL AS BIGINT) AS parent_express_id, CAST(NULL AS VARCHAR) AS storey FROM region UNION ALL SELECT CAST(2000000 + n_nationkey AS BIGINT), 'N' || n_nationkey, 'Nation', n_name, CAST(1000000 + n_regionkey AS BIGINT), NULL FROM nation UNION ALL SELECT 3000000 + c_custkey, 'C' || c_custkey, 'Customer', CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END, CAST(2000000 + c_nationkey AS BIGINT), c_mktsegment FROM customer)",
    "properties": " UNION ALL ".join(_PROPERTY.format(**dict(zip(_NAMES, r))) for r in _ROWS),
    "elements_v2": "SELECT * REPLACE (CASE WHEN class = 'Customer' AND (express_id - 3000000) % 17 = 2 THEN 'MOVED' ELSE storey END AS storey) FROM elements WHERE NOT (class = 'Customer' AND (express_id - 3000000) % 20 = 5) UNION ALL SELECT 9000000 + i, 'X' || i, 'Customer', 'New#' || i, 2000000, 'NEW', 9000000 + i FROM range(40) t(i)",
    "properties_v2": "SELECT * REPLACE (CASE WHEN element_row >= 3000000 AND (element_row - 3000000) % 13 = 4 AND key = 'Acct.Balance' THEN value_number + 1 ELSE value_number END AS value_number) FROM properties WHERE NOT (element_row >= 3000000 AND (element_row - 3000000) % 20 = 5)",
    "samples": "SELECT id, CAST(id % 10 AS DOUBLE) AS x, CAST(id // 10 AS DOUBLE) AS y, value FROM (SELECT s_suppkey % 400 AS id, avg(s_acctbal) AS value FROM supplier GROUP BY 1)",
    "sites": "SELECT s_suppkey AS id, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 AS DOUBLE) AS y, s_acctbal AS value FROM supplier",
    "raster": "SELECT CAST(p_partkey // 40 AS INT) AS row, CAST(p_partkey % 40 AS INT) AS col, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) + p_retailprice / 10 END AS v FROM part",
    "bands": "SELECT CAST(l_partkey // 40 AS INT) AS row, CAST(l_partkey % 40 AS INT) AS col, CAST(l_suppkey % 2 AS INT) AS band, l_shipdate AS day, 1500 + l_quantity * 100 AS v FROM lineitem",
    "triangles": "SELECT *, ux + 1 + tri_id % 3 AS vx, uy AS vy, uz AS vz, ux AS wx, uy + 2 AS wy, uz + 1 AS wz FROM (SELECT p_brand AS mesh_id, p_partkey AS tri_id, CAST(p_size AS DOUBLE) AS ux, CAST(p_partkey % 13 AS DOUBLE) AS uy, p_retailprice / 100 AS uz FROM part)",
    "building": "SELECT p_partkey AS feature, p_retailprice AS height, CAST(p_size AS BIGINT) AS yearBuilt, p_name AS name, p_size > 25 AS flag FROM part",
    "realtime": "SELECT event_id AS seq, event_type AS room, user_id AS user, event_id % 3 AS conn, CASE WHEN value < 10 THEN 'Join' WHEN value < 20 THEN 'Leave' ELSE 'Cursor' END AS type FROM events",
    "requests": "SELECT user_id % 10 AS key, event_id, ts FROM events",
    "audit": "SELECT event_id AS id, ts AS timestamp, user_id AS user, event_type AS action, json_extract_string(props, '$.k') AS resource FROM events",
    "job_runs": "SELECT user_id % 20 AS job, event_id AS seq, event_type <> 'error' AS ok, ts FROM events",
    "assets": "SELECT d.doc_id AS id, source AS name, text AS description, [lang] AS tags, lang AS type, CASE WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'error' ELSE 'processing' END AS status, d.doc_id AS created, n_chars AS bytes FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id",
}
_NEEDS = {"epoch_a": ["points"], "epoch_b": ["points"], "cells_old": ["points"], "cells_new": ["points"], "elements_v2": ["elements"], "properties_v2": ["properties"]}


def with_ctes(sql: str) -> str:
    """The SQL with the common tables that it names in front; a leading WITH [RECURSIVE] of its own is merged."""
    used: list[str] = []
    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            used += [n for n in [*_NEEDS.get(name, []), name] if n not in used]
    if not used:
        return sql
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in used)
    if own:
        return f"WITH {own[1] or ''}{head}, {body[own.end():]}"
    return f"WITH {head} {body}"
