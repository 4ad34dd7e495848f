"""Operational tables: searches, queues, limits, schedules and retention, each as a batch replay of its events."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requests per second and per day by tier; attempts and first delay of webhooks; failures that disable.
TIERS = [("free", 10, 10_000), ("pro", 100, 500_000), ("enterprise", 1000, None)]
ATTEMPTS, FIRST_DELAY, FAILURES, DAY_S = 4, 30, 3, 86_400
ROOM_LIMITS = {"rooms_per_user": 8, "rooms": 512, "per_room": 23, "per_user": 16}


def search_assets(assets: DataFrame, q: str | None = None, tag: str | None = None, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Assets by text in name or description, tag, type and status, newest first."""
    tests: list[Column] = []
    if q:
        tests.append(F.col("name").ilike(f"%{q}%") | F.col("description").ilike(f"%{q}%"))
    if tag:
        tests.append(F.array_contains("tags", tag))
    if kind:
        tests.append(F.col("type") == kind)
    if status:
        tests.append(F.col("status") == status)
    return assets.where(reduce(Column.__and__, tests, F.lit(True))).orderBy(F.desc("created"), "id")


def audit_entries(audit: DataFrame, user: int | None = None, action: str | None = None, since: str | None = None, until: str | None = None, limit: int = 1000) -> DataFrame:
    for column, value in (("user", user), ("action", action)):
        if value is not None:
            audit = audit.where(F.col(column) == value)
    if since:
        audit = audit.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until:
        audit = audit.where(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return audit.orderBy(F.desc("timestamp"), F.desc("id")).limit(min(limit, 1000))


def swept(audit: DataFrame, cutoff: str, most: int = 50_000) -> DataFrame:
    """What an audit sweep leaves: rows before the cutoff go, the oldest ``most`` of them at one sweep."""
    old = audit.where(F.col("timestamp") < F.lit(cutoff).cast("timestamp")).orderBy("timestamp", "id").limit(most)
    return audit.join(old.select("id"), "id", "left_anti")


def next_job(jobs: DataFrame, busy: DataFrame) -> DataFrame:
    """The oldest queued job of an asset that isn't busy."""
    free = jobs.where("status = 'queued'").join(busy.select("asset"), "asset", "left_anti")
    return free.agg(F.min_by("job", F.struct("created", "job")).alias("job"))


def sliding_count(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """How many rows of the key lie in the trailing time, each row included."""
    w = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return rows.withColumn("recent", F.count("*").over(w))


def replayed(rows: DataFrame, key: str, order: list[str], start, step, result: str, descending: bool = False) -> DataFrame:
    """A sequential replay of each key's rows in order, in memory of one batch and one key's state, however many rows it has.

    ``start()`` gives a key's first state, ``step(state, row)`` a row's result and the next state; key, order columns and the
    result come out. Keys are dealt by one exchange and sorted inside tasks.
    """
    names = [key, *(c for c in order if c != key)]
    ordered = rows.repartition(key).sortWithinPartitions(key, *[F.desc(c) if descending else F.asc(c) for c in order])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = getattr(row, key)
                if state is None or own != current:
                    current, state = own, start()
                value, state = step(state, row)
                out.append(value)
            yield batch[names].assign(**{result.split()[0]: out})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered.mapInPandas(run, ", ".join([*(f"{n} {kinds[n]}" for n in names), result]))


def token_bucket(requests: DataFrame, rate: float, per_day: int | None) -> DataFrame:
    """Replays requests (key, event_id, ts) against a bucket of ``rate`` with continuous refill and a rolling daily count.

    The bucket is sequential in time; the streaming form keeps the same numbers as state.
    """

    def step(state: tuple, row) -> tuple[bool, tuple]:
        level, last, first, used = state
        level = rate if last is None else min(rate, level + (row.at - last) * rate)
        if level < 1:
            return False, (level, row.at, first, used)
        if first is None or row.at - first >= DAY_S:
            first, used = row.at, 0
        if per_day is not None and used >= per_day:
            return False, (level, row.at, first, used)
        return True, (level - 1, row.at, first, used + 1)

    rows = requests.select("key", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return replayed(rows, "key", ["at", "event_id"], lambda: (rate, None, None, 0), step, "allowed boolean").select("key", "event_id", "allowed")


def roster(events: DataFrame) -> DataFrame:
    """Who is in which room at the end: users whose last word on some connection was Join; room, user, connections."""
    last = events.where(F.col("type").isin("Join", "Leave")).groupBy("room", "user", "conn").agg(F.max_by("type", "seq").alias("type"))
    return last.where("type = 'Join'").groupBy("room", "user").agg(F.count("*").alias("connections"))


def admissions(events: DataFrame, limits: dict = ROOM_LIMITS) -> DataFrame:
    """Replays joins and leaves against limits of rooms and connections; seq, admitted.

    The limits are global, so the replay is one ordered pass over the joins and leaves alone.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        rooms: dict = {}
        out = []
        for room, user, conn, kind in rows[["room", "user", "conn", "type"]].itertuples(index=False):
            own = rooms.setdefault(room, set())
            if kind == "Leave":
                own.discard((user, conn))
                if not own:
                    rooms.pop(room)
                out.append(True)
                continue
            mine = [r for r, members in rooms.items() if any(u == user for u, _ in members)]
            held = sum(u == user for members in rooms.values() for u, _ in members)
            good = (user, conn) in own or ((room in mine or len(mine) < limits["rooms_per_user"]) and (own or len(rooms) <= limits["rooms"]) and len(own) < limits["per_room"] and held < limits["per_user"])
            if good:
                own.add((user, conn))
            elif not own:
                rooms.pop(room)
            out.append(bool(good))
        return pd.DataFrame({"seq": rows["seq"], "admitted": out})

    moves = events.where(F.col("type").isin("Join", "Leave"))
    return moves.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(one, "seq long, admitted boolean")


def retry_delays(failed: DataFrame, attempts: int = ATTEMPTS, first: int = FIRST_DELAY) -> DataFrame:
    """The retries of failed deliveries: attempt (from 1) and delay in seconds, doubling."""
    rows = failed.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts - 1))))
    return rows.withColumn("delay_s", (first * F.pow(F.lit(2), F.col("attempt") - 1)).cast("int"))


def runs_between(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """Runs of interval schedules (job, interval_s) from a start to an end, both included."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return jobs.withColumn("run_at", F.explode(F.sequence(a, b, F.make_dt_interval(secs=F.col("interval_s")))))


def cron_matches(expression: str, at: Column) -> Column:
    """Whether a five-field cron expression (UTC; ``*``, lists, ranges, steps) holds at a minute."""
    minute, hour, day, month, weekday = expression.split()
    values = [F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1]
    ranges = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]

    def allowed(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = (str(low) + "-" + str(high) if span == "*" else span).partition("-")
            out.update(range(int(a), int(b or (high if step else a)) + 1, int(step or 1)))
        return out

    fields = (minute, hour, day, month, weekday)
    tests = [v.isin(sorted({x % 7 if k == 4 else x for x in allowed(f, *r)})) for k, (f, v, r) in enumerate(zip(fields, values, ranges))]
    days = tests[2] | tests[4] if day != "*" and weekday != "*" else tests[2] & tests[4]
    return tests[0] & tests[1] & tests[3] & days


def disabled_after(runs: DataFrame, failures: int = FAILURES) -> DataFrame:
    """Per job the first run at which it had failed so often in a row (gaps and islands); job, seq."""
    w = Window.partitionBy("job").orderBy("seq")
    islands = runs.withColumn("good", F.sum(F.col("ok").cast("int")).over(w))
    bad = islands.where(~F.col("ok")).withColumn("n", F.row_number().over(Window.partitionBy("job", "good").orderBy("seq")))
    return bad.where(F.col("n") == failures).groupBy("job").agg(F.min("seq").alias("seq"))


def cache_survivors(writes: DataFrame, most_bytes: int) -> DataFrame:
    """What a cache that drops its oldest writes holds at the end, if keys are written once: a suffix of the writes.

    Prefix sums by hour first, so that no task orders the whole history.
    """
    hourly = writes.groupBy(F.date_trunc("hour", "at").alias("hour")).agg(F.sum("bytes").alias("b"))
    later = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    bases = hourly.select("hour", F.coalesce(F.sum("b").over(later), F.lit(0)).alias("base"))
    own = Window.partitionBy("hour").orderBy(F.desc("at"), F.desc("key"))
    rows = writes.withColumn("hour", F.date_trunc("hour", "at")).withColumn("run", F.sum("bytes").over(own))
    return rows.join(bases, "hour").where(F.col("run") + F.col("base") <= most_bytes).select("key", "bytes")


def next_free_id(taken: DataFrame, last: int, reserved: DataFrame) -> DataFrame:
    """The id after the last; if that is reserved, the smallest one above it that follows a reserved one and is free."""
    after = reserved.select((F.col("id") + 1).alias("id")).where(F.col("id") > last)
    candidates = after.join(reserved.select("id"), "id", "left_anti").join(taken.select("id"), "id", "left_anti")
    first = reserved.where(F.col("id") == last + 1).agg(F.count("*").alias("n"))
    return first.join(F.broadcast(candidates.agg(F.min("id").alias("m")))).select(F.when(F.col("n") == 0, F.lit(last + 1)).otherwise(F.col("m")).cast("long").alias("id"))


def upserted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def lockouts(attempts: DataFrame, most: int = 5, seconds: int = 900) -> DataFrame:
    """Replays login attempts (user, seq, ts, ok): in, refused or locked."""

    def step(state: tuple, row) -> tuple[str, tuple]:
        failures, until = state
        if row.at < until:
            return "locked", state
        failures = 0 if row.ok else failures + 1
        result = "in" if row.ok else "refused"
        return result, ((0, row.at + seconds) if failures >= most else (failures, until))

    rows = attempts.select("user", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "ok")
    return replayed(rows, "user", ["seq"], lambda: (0, 0.0), step, "result string").select("user", "seq", "result")


def dataset_statistics(datasets: DataFrame, by: str, size: str) -> DataFrame:
    """Datasets and their bytes by a column."""
    return datasets.groupBy(by).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def search_items(items: DataFrame, box: tuple[float, float, float, float] | None = None, between: tuple[str | None, str | None] = (None, None), collections: list[str] = (), limit: int = 10) -> DataFrame:
    """Catalogue items (id, lon, lat, datetime, collection) in a box (west, south, east, north), a time and collections, by id."""
    if not 1 <= limit <= 500:
        raise ValueError("a search takes 1 to 500 items")
    if box is not None:
        west, south, east, north = box
        if not (west <= east and south <= north):
            raise ValueError("a box runs from south-west to north-east")
        items = items.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    for value, test in zip(between, (Column.__ge__, Column.__le__)):
        if value:
            items = items.where(test(F.col("datetime"), F.lit(value).cast("timestamp")))
    if collections:
        items = items.where(F.col("collection").isin(list(collections)))
    return items.orderBy("id").limit(limit)


def get_tile(tiles: DataFrame, source: str, z: int, x: int, y: int) -> DataFrame:
    """The tile of a source by its place; a table partitioned by source and z is read only there."""
    if not (0 <= x < 2**z and 0 <= y < 2**z):
        raise ValueError("no such tile at this level")
    return tiles.where((F.col("source") == source) & (F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))


def stored(blobs: DataFrame) -> DataFrame:
    """Blobs under safe keys: steps to a parent folder are taken out."""
    return blobs.withColumn("key", F.replace("key", F.lit(".."), F.lit("")))


def listed(blobs: DataFrame, prefix: str) -> DataFrame:
    return blobs.where(F.col("key").startswith(prefix))


def deleted(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    return blobs.join(keys.select("key"), "key", "left_anti")


def catalogue(entries: DataFrame, category: object = None) -> DataFrame:
    """A catalogue's entries, of one category if so."""
    return entries if category is None else entries.where(F.col("category") == category)


def expired(exports: DataFrame, now: str) -> DataFrame:
    """Exports (status, expires_at): ready ones whose time has come are expired."""
    due = (F.col("status") == "ready") & (F.col("expires_at") <= F.lit(now).cast("timestamp"))
    return exports.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def audited(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls (action, status) of audited routes (action, name) that succeeded; Spark broadcasts the routes if they are few."""
    return calls.where(F.col("status").between(200, 299)).join(routes, "action")


def oldest_queued(jobs: DataFrame) -> DataFrame:
    """The job that a claim takes: the oldest queued one, as one aggregate."""
    return jobs.where("status = 'queued'").agg(F.min_by("job", F.struct("created", "job")).alias("job"))


def without_finished(jobs: DataFrame, status: str, cutoff: str) -> DataFrame:
    """Jobs without those of a status from before a time."""
    return jobs.where(~((F.col("status") == status) & (F.col("created") < F.lit(cutoff).cast("timestamp"))))


def storage_totals(assets: DataFrame) -> DataFrame:
    return assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def with_sender(messages: DataFrame, user: str = "user") -> DataFrame:
    """Messages stamped with their sender by the server, whatever they say themselves."""
    return messages.withColumn("sender", F.concat(F.lit("user-"), F.col(user)))


def deliveries(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Events (hook, event_type) for each active hook (hook, active, subscribed) that listens to their type."""
    own = hooks.where("active").select("hook", F.explode("subscribed").alias("event_type"))
    return events.join(own, ["hook", "event_type"])


def due(runs: DataFrame, now: str, interval_s: int) -> DataFrame:
    """Jobs whose next run, an interval after the last good one, has come."""
    last = runs.where("ok").groupBy("job").agg(F.max("ts").alias("last"))
    return last.where(F.col("last") + F.make_dt_interval(secs=F.lit(interval_s)) <= F.lit(now).cast("timestamp"))


def etag(content: Column) -> Column:
    """A content's tag: the first 16 hexadecimal digits of its SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def not_modified(tag: Column, asked: Column) -> Column:
    """Whether an If-None-Match list names the tag, or is ``*``."""
    names = F.transform(F.split(asked, ","), lambda x: F.regexp_replace(F.trim(x), '^(W/)?"|"$', ""))
    return F.coalesce((F.trim(asked) == "*") | F.array_contains(names, tag), F.lit(False))


def visible_items(items: DataFrame, viewer: Column, shared: Column, limit: int = 200) -> DataFrame:
    """Items of the viewer or shared with them, newest first."""
    return items.where(viewer | shared).orderBy(F.desc("created"), "id").limit(limit)


def listed_annotations(annotations: DataFrame, asset: str, value: object, hidden: Column | None = None) -> DataFrame:
    """An asset's annotations without hidden ones."""
    own = annotations.where(F.col(asset) == value)
    return own if hidden is None else own.where(~hidden)


def latest(rows: DataFrame, created: str, key: str, limit: int) -> DataFrame:
    """The newest rows; of the same time the larger key first."""
    return rows.orderBy(F.desc(created), F.desc(key)).limit(limit)


def dashboard(assets: DataFrame, jobs: DataFrame, recent: int = 10, looked_at: int = 100) -> DataFrame:
    """One row: how many assets, the bytes of the most recent ones, running jobs among the latest."""
    size = assets.orderBy(F.desc("created"), "id").limit(recent).agg(F.sum("bytes").alias("recent_bytes"))
    active = latest(jobs, "created", "job", looked_at).where("status = 'running'").agg(F.count("*").alias("active"))
    return assets.agg(F.count("*").alias("assets")).crossJoin(size).crossJoin(active)  # one row each


def histogram(values: DataFrame, name: str, value: str, bounds: list[float]) -> DataFrame:
    """Metrics as cumulative buckets: name, le (the bucket's upper bound, null for infinity), n."""
    rows = values.select(F.col(name).alias("name"), F.col(value).alias("value"))
    counts = rows.groupBy("name").agg(*[F.count(F.when(F.col("value") <= b, 1)).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("value").alias("all_"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("all_").alias("n"))]
    return counts.select("name", F.explode(F.array(*pairs)).alias("b")).select("name", "b.le", "b.n")
