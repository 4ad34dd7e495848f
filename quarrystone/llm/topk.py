"""Exact top-k search by pivot-table elimination.

Vectors are quantised to integers; the score is their inner product. With one more component, the root of M - |x|^2 (M:
the largest squared norm), every candidate has the same norm, so the largest product is the smallest distance, and
distances obey the triangle inequality: for pivots p, max |d(q, p) - d(x, p)| is a lower bound of d(q, x). The distances
of all candidates to the pivots are computed once. Each query starts with the k-th best score in a bounded sample, which
its result can't be below; the candidates are taken in the order of their bounds, and the search stops as soon as the next
bound is over the distance of the k-th score known, which is exact.

Candidates and queries are packed into blocks, and blocks into groups of bounded size. Spark deals every group of queries to every
group of candidates, a pair of groups is a task's work, what isn't below the queries' first scores comes out, and Spark merges that.
Nothing but the pivots and the sample is broadcast. Inside a part of the table, rows near the same pivot lie in the same block, so
whole blocks fall out; the k-th score known after a block is the next one's first.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a null vec_id takes no part; of
vectors of unlike length the shorter one counts as filled with zeros; rows with the query's vec_id are its own; repeated
rows of another vec_id are all candidates; of queries with the same vec_id the one whose vector sorts first counts; ties go
to the smaller vec_id; scores beyond 64 bits become the nearest 64-bit number; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import read, written

SCALE, K, PIVOTS = 1024, 10, 24
CANDIDATES, QUERIES, SAMPLE = 4096, 256, 2000
#: Parts of the candidates and of the queries that a group has.
CANDIDATE_PARTS, QUERY_PARTS = 16, 256


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q, floor(1024 * x) of every component, of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("q"))


def matrix(rows: list | np.ndarray, width: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix, the shorter ones filled with zeros."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), max(1, sizes.max(initial=0)) if width is None else width), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([*rows, []]).astype(np.int64) if len(rows) else 0
    return out


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of x with q, the shorter side filled with zeros; not ``exact``: they may pass 64 bits."""
    d = min(x.shape[1], q.shape[-1])
    if exact:
        return x[:, :d] @ q[:d]
    big = x[:, :d].astype(object) @ q[:d].astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in big], np.int64)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Pivots far from each other, by farthest-first choice in a bounded sample."""
    if not len(sample):
        return sample
    picked, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def lifted_distances(x: np.ndarray, pivots: np.ndarray, top: float, lift: bool) -> np.ndarray:
    """Distances to the pivots (which are lifted candidates), of candidates (lifted) or queries (last component 0)."""
    x, d = x.astype(np.float64), min(x.shape[1], pivots.shape[1])
    last = np.sqrt(np.maximum(0, top - (x**2).sum(1))) if lift else np.zeros(len(x))
    p_last = np.sqrt(np.maximum(0, top - (pivots**2).sum(1)))
    squared = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x[:, :d] @ pivots[:, :d].T + (last[:, None] - p_last[None, :]) ** 2
    return np.sqrt(np.maximum(0, squared))


def first_scores(queries: np.ndarray, q_ids: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int, exact: bool) -> np.ndarray:
    """Per query the k-th best score in a sample of the candidates, or the smallest number where the sample has fewer."""
    out = np.full(len(queries), -(1 << 63), np.int64)
    for n in range(len(queries)):
        own = products(sample[ids != q_ids[n]], queries[n], exact)
        if len(own) >= k:
            out[n] = np.partition(own, len(own) - k)[len(own) - k]
    return out


def search(
    queries: np.ndarray, q_ids: np.ndarray, q_far: np.ndarray, first: np.ndarray, rows: np.ndarray, ids: np.ndarray, far: np.ndarray, top: float, k: int, exact: bool = True
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its number, and the vec_ids and scores of its k best of these candidates, best first, none below ``first``."""
    norms = (queries.astype(np.float64) ** 2).sum(1)
    low, high = far.min(axis=0), far.max(axis=0)
    # no row of the block can be nearer than its interval of pivot distances allows
    least = np.maximum(np.maximum(low - q_far, q_far - high).max(axis=1), 0)
    for n in range(len(queries)):
        worst, best_ids, best = int(first[n]), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # what has the score ``worst`` or a better one lies within this distance
        reach = lambda: np.sqrt(max(0.0, norms[n] + top - 2 * float(worst))) * (1 + 1e-9) + 1e-6  # noqa: B023, E731
        if least[n] > reach():
            continue
        bounds = np.abs(q_far[n] - far).max(axis=1)
        allowed = np.flatnonzero((ids != q_ids[n]) & (bounds <= reach()))
        order = allowed[np.argsort(bounds[allowed], kind="stable")]
        at, step = 0, 128
        while at < len(order) and bounds[order[at]] <= reach():
            part = order[at : at + step]
            best = np.concatenate([best, products(rows[part], queries[n], exact)])
            best_ids = np.concatenate([best_ids, ids[part]])
            keep = np.lexsort((best_ids, -best))[:k] if exact else np.array(sorted(range(len(best)), key=lambda i: (-int(best[i]), best_ids[i]))[:k])
            best, best_ids, at, step = best[keep], best_ids[keep], at + step, min(4 * step, 2048)
            if len(best) == k:
                worst = max(worst, int(best[-1]))
        good = best >= first[n]
        if good.any():
            yield n, best_ids[good], best[good]


def top_k(vectors: DataFrame, k: int = K, every: int = 100, n_pivots: int = PIVOTS, parts: tuple[int, int] = (CANDIDATE_PARTS, QUERY_PARTS)) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank (from 1), vec_id, score of its k best."""
    rows = written(quantised(vectors))
    square = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    n, top = rows.agg(F.count("*"), F.max(square)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    share = int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= share).sort("vec_id", "q").limit(2 * SAMPLE).collect()
    known, known_ids = matrix([r["q"] for r in sample]), np.array([r["vec_id"] for r in sample], np.int64)
    pivots = choose_pivots(known.astype(np.float64), n_pivots) if len(sample) else np.zeros((1, 1))
    top = max(float(top), float((pivots**2).sum(1).max()))
    exact = top < 2.0**62  # by the inequality of Cauchy and Schwarz no product is larger

    def blocks(size: int, asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held_ids, held, part = [], [], TaskContext.get().partitionId()

            def flush():
                ids, x = np.concatenate(held_ids), matrix(held)
                far = lifted_distances(x, pivots, top, not asks)
                near = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
                for at in range(0, len(ids), size):
                    own = near[at : at + size]
                    first = first_scores(x[own], ids[own], known, known_ids, k, exact) if asks else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids[own], x[own], far[own], first)] + [pa.array([part], pa.int64())], names=["ids", "rows", "far", "first", "part"])

            for batch in batches:
                held_ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64))
                held += [x.values.to_numpy(zero_copy_only=False) for x in batch.column("q")]
                if len(held) >= 2 * size:
                    yield from flush()
                    held_ids, held = [], []
            if held:
                yield from flush()

        return run

    shape = "ids binary, rows binary, far binary, first binary, part long"
    n_parts, q_parts = max(1, -(-n // CANDIDATES)), max(1, -(-n // every // QUERIES))
    candidates = written(rows.repartition(n_parts, F.xxhash64("vec_id", "q")).mapInArrow(blocks(CANDIDATES, False), shape))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    queries = written(asked.repartition(q_parts, "vec_id").mapInArrow(blocks(QUERIES, True), shape))
    groups = [max(1, -(-a // b)) for a, b in zip((n_parts, q_parts), parts)]
    # small tables have a group a core
    groups[0] = max(groups[0], min(n_parts, vectors.sparkSession.sparkContext.defaultParallelism))
    # c and q number the groups; blocks of either side are dealt to all groups of the other
    every_one = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    left = candidates.select("ids", "rows", "far", (F.col("part") % groups[0]).alias("c"), every_one(groups[1]).alias("q"))
    right = queries.select("ids", "rows", "far", "first", (F.col("part") % groups[1]).alias("q"), every_one(groups[0]).alias("c"))

    def compare(mine: pa.Table, asking: pa.Table) -> pa.Table:
        def arrays(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
            for x in table.select(["ids", "rows", "far"]).to_pylist():
                ids = np.frombuffer(x["ids"], np.int64)
                yield ids, np.frombuffer(x["rows"], np.int64).reshape(len(ids), -1), np.frombuffer(x["far"], np.float64).reshape(len(ids), -1)

        out = []
        for (q_ids, q, q_far), held in zip(arrays(asking), asking.column("first").to_pylist()):
            first, best = np.frombuffer(held, np.int64).copy(), {}
            for ids, x, far in arrays(mine):
                for m, v, s in search(q, q_ids, q_far, first, x, ids, far, top, k, exact):
                    if m in best:
                        v, s = np.concatenate([best[m][0], v]), np.concatenate([best[m][1], s])
                    # ~ turns the order of all 64-bit numbers, as a minus would not of the smallest one
                    order = np.lexsort((v, ~s))[:k]
                    best[m] = v[order], s[order]
                    if len(order) == k:
                        first[m] = max(first[m], best[m][1][-1])
            out += [(np.full(len(v), q_ids[m]), v, s) for m, (v, s) in best.items()]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    near = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(compare, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), a AS (
  SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CASE WHEN least(len(a.q), len(b.q)) = 0 THEN 0 ELSE
    CAST(list_inner_product(a.q[1:least(len(a.q), len(b.q))], b.q[1:least(len(a.q), len(b.q))]) AS BIGINT) END AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
