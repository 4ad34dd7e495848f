"""Streams against their batch replays, over a folder copy of events."""

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import catalog
from quarrystone.plans.inputs import Tables
from quarrystone.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    at = str(tmp_path_factory.mktemp("stream") / "events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(1).sortWithinPartitions("event_id").write.parquet(at)
    schema = spark.read.parquet(at).schema
    yield lambda: spark.readStream.schema(schema).parquet(at)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_token_bucket(spark, stream, tmp_path):
    t = Tables(spark, SF)
    requests = stream().selectExpr("user_id % 10 AS key", "event_id", "ts")
    want = sorted(tuple(r) for r in catalog.token_bucket(t.requests, 10, 2).collect())
    assert run(state.token_bucket(requests, 10, 2), "buckets", tmp_path) == want
    assert not all(r[2] for r in want)


def test_disabled_jobs(spark, stream, tmp_path):
    runs = stream().selectExpr("user_id % 20 AS job", "event_id AS seq", "event_type <> 'error' AS ok")
    want = sorted(tuple(r) for r in catalog.disabled_after(Tables(spark, SF).job_runs).collect())
    assert run(state.disabled_jobs(runs), "disabled", tmp_path) == want


def test_presence(spark, stream, tmp_path):
    events = stream().selectExpr("event_id AS seq", "event_type AS room", "user_id AS user", "event_id % 3 AS conn", "CASE WHEN value < 10 THEN 'Join' WHEN value < 20 THEN 'Leave' ELSE 'Cursor' END AS type")
    rows = run(state.presence(events), "presence", tmp_path)
    last = {}
    for room, user, seq, change in sorted(rows, key=lambda r: r[2]):
        last[room, user] = change
    present = {k for k, v in last.items() if v == "joined"}
    assert present == {(r["room"], r["user"]) for r in catalog.roster(Tables(spark, SF).realtime).collect()}


def test_lockout(spark, stream, tmp_path):
    attempts = stream().selectExpr("user_id % 3 AS user", "event_id AS seq", "ts", "event_type <> 'error' AS ok")
    rows = run(state.lockouts(attempts, 2, 86_400), "lockouts", tmp_path)
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r[2] for r in rows} == {"in", "refused", "locked"}


def test_audit_windows(spark, stream, tmp_path):
    audit = stream().selectExpr("ts AS timestamp", "event_type AS action")
    rows = run(state.audit_per_window(audit), "audit_windows", tmp_path, "complete")
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts"), "event_type").count().count()
    assert len(rows) == want
