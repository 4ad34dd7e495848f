"""Operational queries (I rows, and K14, K19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import catalog as I
from quarrystone.operators.lineage import spread
from quarrystone.plans.registry import query


@query("i01_search_assets", "SELECT id FROM assets WHERE (name ILIKE '%license%' OR description ILIKE '%license%') AND list_contains(tags, 'en') AND status = 'ready'")
def search_assets(t):
    return I.search_assets(t.assets, "license", "en", None, "ready").select("id")


@query("i02_audit_entries", "SELECT id, user, action FROM audit WHERE action = 'click' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' ORDER BY timestamp DESC, id DESC LIMIT 100")
def audit_entries(t):
    return I.audit_entries(t.audit, None, "click", "2024-01-05", "2024-01-20", 100).select("id", "user", "action")


@query("i03_audit_sweep", "SELECT id FROM audit WHERE id NOT IN (SELECT id FROM audit WHERE timestamp < TIMESTAMP '2024-01-10' ORDER BY timestamp, id LIMIT 50000)")
def sweep(t):
    return I.swept(t.audit, "2024-01-10").select("id")


@query("i04_audited_routes", "SELECT a.id, r.name FROM audit a JOIN (VALUES ('signup', 'account'), ('purchase', 'order')) r(action, name) ON a.action = r.action WHERE CAST(a.resource AS INT) % 10 BETWEEN 2 AND 5")
def audited(t):
    routes = t.spark.createDataFrame([("signup", "account"), ("purchase", "order")], "action string, name string")
    calls = t.audit.withColumn("status", F.expr("CAST(CASE WHEN CAST(resource AS INT) % 10 BETWEEN 2 AND 5 THEN 204 ELSE 404 END AS INT)"))
    return I.audited(calls, routes).select("id", "name")


_JOBS = "SELECT event_id AS job, user_id AS asset, CASE WHEN event_type = 'error' THEN 'running' ELSE 'queued' END AS status, ts AS created FROM events"


def _jobs(t):
    return t.read("events").selectExpr("event_id AS job", "user_id AS asset", "CASE WHEN event_type = 'error' THEN 'running' ELSE 'queued' END AS status", "ts AS created")


@query("i05_next_job", f"SELECT job FROM ({_JOBS}) WHERE status = 'queued' AND asset NOT IN (SELECT asset FROM ({_JOBS}) WHERE status = 'running' AND created < TIMESTAMP '2024-01-02') ORDER BY created, job LIMIT 1")
def next_job(t):
    jobs = _jobs(t)
    return I.next_job(jobs, jobs.where("status = 'running' and created < timestamp'2024-01-02'"))


@query("i06_claim_build", f"SELECT job FROM ({_JOBS}) WHERE status = 'queued' ORDER BY created, job LIMIT 1")
def claim(t):
    return I.oldest_queued(_jobs(t))


@query("i07_finished_jobs", f"SELECT status, count(*) AS n FROM ({_JOBS}) WHERE NOT (status = 'queued' AND created < TIMESTAMP '2024-01-15') GROUP BY 1")
def finished(t):
    return I.without_finished(_jobs(t), "queued", "2024-01-15").groupBy("status").agg(F.count("*").alias("n"))


@query("i08_totals", "SELECT count(*) AS assets, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM assets")
def totals(t):
    return I.storage_totals(t.assets)


@query("i09_signup_window", "SELECT event_id, count(*) OVER (PARTITION BY key ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM requests")
def signup_window(t):
    return I.sliding_count(t.requests, "key", "ts", 3600).select("event_id", "recent")


@query("i11_token_bucket")
def bucket(t):
    return I.token_bucket(t.requests, 10, 500)


@query("i11_requests_per_day", "SELECT key, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, count(*) AS n FROM requests GROUP BY 1, 2")
def per_day(t):
    return t.requests.groupBy("key", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("i12_rate_tiers", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 1000 END AS per_second, CASE c_custkey % 3 WHEN 0 THEN 10000 WHEN 1 THEN 500000 END AS per_day FROM customer")
def tiers(t):
    table = t.spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(I.TIERS)], "tier long, per_second int, per_day int")
    return t.read("customer").withColumn("tier", F.col("c_custkey") % 3).join(F.broadcast(table), "tier").select("c_custkey", "per_second", "per_day")


@query("i13_roster", "SELECT room, user, count(*) AS connections FROM (SELECT room, user, conn, max_by(type, seq) AS type FROM realtime WHERE type IN ('Join', 'Leave') GROUP BY 1, 2, 3) WHERE type = 'Join' GROUP BY 1, 2")
def roster(t):
    return I.roster(t.realtime)


@query("i14_admissions")
def admissions(t):
    return I.admissions(t.realtime)


#: Shares of a room's messages, and lists that a room's members are dealt to.
_SHARES, _LISTS = 64, 4096


@query("i15_fan_out", "SELECT m.seq, r.user AS receiver FROM realtime m JOIN (SELECT room, user FROM (SELECT room, user, conn, max_by(type, seq) AS type FROM realtime WHERE type IN ('Join', 'Leave') GROUP BY 1, 2, 3) WHERE type = 'Join' GROUP BY 1, 2) r ON r.room = m.room AND r.user <> m.user WHERE m.type = 'Cursor'")
def fan_out(t):
    # rooms are few and large: a room's messages are dealt in shares, so that no task has a room alone. A message goes to one share; what
    # every share has a copy of is the members, in lists, as they are fewer than the messages and a list is smaller than its rows
    members = I.roster(t.realtime).groupBy("room", F.pmod(F.xxhash64("user"), F.lit(_LISTS)).alias("list")).agg(F.collect_list("user").alias("receivers"))
    members = members.select("room", "receivers", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SHARES - 1).cast("long"))).alias("share"))
    sent = t.realtime.where("type = 'Cursor'").select("seq", "room", "user", F.pmod(F.xxhash64("seq"), F.lit(_SHARES)).alias("share"))
    pairs = sent.join(spread(members), ["room", "share"]).select("seq", "user", F.explode("receivers").alias("receiver"))
    return pairs.where("receiver <> user").select("seq", "receiver")


@query("i16_sender", "SELECT seq, 'user-' || user AS sender FROM realtime")
def sender(t):
    return I.with_sender(t.realtime).select("seq", "sender")


@query("i17_webhooks", "SELECT e.event_id, h.hook FROM events e JOIN (SELECT n_nationkey AS hook, n_nationkey % 2 = 0 AS active, CASE WHEN n_nationkey % 3 = 0 THEN ['click', 'error'] ELSE ['purchase'] END AS subscribed FROM nation) h ON h.active AND list_contains(h.subscribed, e.event_type) WHERE e.user_id % 25 = h.hook")
def webhooks(t):
    hooks = t.read("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS hook", "n_nationkey % 2 = 0 AS active", "CASE WHEN n_nationkey % 3 = 0 THEN array('click', 'error') ELSE array('purchase') END AS subscribed")
    return I.deliveries(t.read("events").withColumn("hook", F.col("user_id") % 25), hooks).select("event_id", F.col("hook").cast("int"))


@query("i18_retries", "SELECT event_id, CAST(a AS INT) AS attempt, CAST(30 * pow(2, a - 1) AS INT) AS delay_s FROM events, range(1, 4) t(a) WHERE event_type = 'error'")
def retries(t):
    return I.retry_delays(t.read("events").where("event_type = 'error'").select("event_id"))


@query("i19_interval_runs", "SELECT n_nationkey AS job, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', to_seconds(3600 * (1 + n_nationkey % 4)))) AS run_at FROM nation")
def interval_runs(t):
    jobs = t.read("nation").selectExpr("n_nationkey AS job", "3600 * (1 + n_nationkey % 4) AS interval_s")
    return I.runs_between(jobs, "2024-01-01", "2024-01-03").select("job", F.col("run_at").cast("timestamp_ntz").alias("run_at"))


@query("i19_cron_runs", "SELECT run_at FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-14 23:59:00', INTERVAL 1 MINUTE)) AS run_at) WHERE minute(run_at) % 20 = 5 AND hour(run_at) BETWEEN 8 AND 9 AND dayofweek(run_at) IN (1, 3)")
def cron_runs(t):
    minutes = t.spark.range(14 * 1440).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("run_at"))
    return minutes.where(I.cron_matches("5-59/20 8-9 * * 1,3", F.col("run_at"))).select(F.col("run_at").cast("timestamp_ntz").alias("run_at"))


@query("i20_disabled_jobs", "SELECT job, min(seq) AS seq FROM (SELECT job, seq, row_number() OVER (PARTITION BY job, good ORDER BY seq) AS n FROM (SELECT job, seq, ok, sum(CAST(ok AS INT)) OVER (PARTITION BY job ORDER BY seq) AS good FROM job_runs) WHERE NOT ok) WHERE n = 3 GROUP BY 1")
def disabled(t):
    return I.disabled_after(t.job_runs)


@query("i21_due_jobs", "SELECT job FROM job_runs WHERE ok GROUP BY job HAVING max(ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-30 20:00:00'")
def due(t):
    return I.due(t.job_runs, "2024-01-30 20:00:00", 3600).select("job")


@query("i22_cache", "SELECT event_id AS key, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_id, ts, 100 + user_id AS bytes FROM events)) WHERE run <= 20000")
def cache(t):
    return I.cache_survivors(t.read("events").selectExpr("event_id AS key", "ts AS at", "100 + user_id AS bytes"), 20_000)


@query("i23_etag", "SELECT doc_id, substr(sha256(text), 1, 16) AS etag, doc_id % 3 = 0 OR (doc_id % 3 = 1 AND text IS NOT NULL) AS not_modified FROM documents")
def etag(t):
    tag = I.etag(F.col("text"))
    asked = F.when(F.col("doc_id") % 3 == 0, F.lit("*")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"x", W/"'), tag, F.lit('"'))).otherwise(F.lit('"none"'))
    return t.read("documents").select("doc_id", tag.alias("etag"), I.not_modified(tag, asked).alias("not_modified"))


@query("i24_portal_items", "SELECT id FROM assets WHERE id % 50 = 3 OR status IN ('ready', 'error') ORDER BY created DESC, id LIMIT 200")
def portal(t):
    return I.visible_items(t.assets, F.col("id") % 50 == 3, F.col("status").isin("ready", "error")).select("id")


@query("i25_annotations", "SELECT event_id, event_type FROM events WHERE user_id = 12 AND event_type <> 'error'")
def annotations(t):
    return I.listed_annotations(t.read("events"), "user_id", 12, F.col("event_type") == "error").select("event_id", "event_type")


@query("i26_next_id", "WITH res AS (SELECT CAST(s_suppkey AS BIGINT) + 500 AS id FROM supplier WHERE s_suppkey < 8), taken AS (SELECT 510 + i AS id FROM range(3) t(i)) SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM res WHERE id = 501) THEN 501 ELSE (SELECT min(id + 1) FROM res WHERE id + 1 > 500 AND id + 1 NOT IN (SELECT id FROM res) AND id + 1 NOT IN (SELECT id FROM taken)) END AS id")
def next_id(t):
    reserved = t.read("supplier").where("s_suppkey < 8").selectExpr("s_suppkey + 500 AS id")
    return I.next_free_id(t.spark.range(3).selectExpr("510 + id AS id"), 500, reserved)


@query("i28_dashboard", "SELECT (SELECT count(*) FROM assets) AS assets, CAST((SELECT sum(bytes) FROM (SELECT bytes FROM assets ORDER BY created DESC, id LIMIT 10)) AS BIGINT) AS recent_bytes, (SELECT count(*) FROM (SELECT * FROM " + f"({_JOBS})" + " ORDER BY created DESC, job DESC LIMIT 100) WHERE status = 'running') AS active")
def dashboard(t):
    return I.dashboard(t.assets, _jobs(t))


@query("i29_recent_jobs", f"SELECT job, status FROM ({_JOBS}) ORDER BY created DESC, job DESC LIMIT 25")
def recent_jobs(t):
    return I.latest(_jobs(t), "created", "job", 25).select("job", "status")


@query("i27_histograms", "SELECT event_type AS name, b.le, count(*) FILTER (value <= coalesce(b.le, 1e300)) AS n FROM events, (VALUES (5.0::DOUBLE), (20), (80), (NULL)) b(le) GROUP BY 1, 2")
def histograms(t):
    return I.histogram(t.read("events"), "event_type", "value", [5, 20, 80])


@query("k14_expire_exports", "SELECT event_id, CASE WHEN event_type <> 'error' AND ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' THEN 'expired' WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS status FROM events")
def expire(t):
    exports = t.read("events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS status", "ts + interval 7 days AS expires_at")
    return I.expired(exports, "2024-01-20").select("event_id", "status")


@query("k19_upsert_topics", "SELECT user, action, max(id) AS id, max_by(resource, id) AS resource FROM audit GROUP BY 1, 2")
def upsert(t):
    return I.upserted(t.audit.select("user", "action", "id", "resource"), ["user", "action"], "id")


@query("i10_lockouts")
def lockouts(t):
    attempts = t.read("events").selectExpr("user_id AS user", "event_id AS seq", "ts", "event_type <> 'error' AS ok")
    return I.lockouts(attempts, 3, 86_400)
