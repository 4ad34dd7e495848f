"""Benchmark decontamination by greedy string tiling.

Seeds: Karp-Rabin hashes of windows of words that a document and a benchmark item share. Pairs that share a seed are
tiled by running Karp-Rabin: windows of a search length over the unmarked words are hashed, the longest common run is
marked, again and again, and when none is left the search length is halved, down to the minimum. Tiles may stand in any order,
so reordered passages are caught. An item's coverage is the share of its words that lie in tiles; a document whose best
coverage reaches the threshold is contaminated.

A benchmark whose measured size is below ``BROADCAST_BYTES`` goes to the tasks that read the documents, which then need
no shuffle; its index (sorted arrays of seeds and of words) takes about four times its text. A larger one is joined by seed with Spark's own joins. Both ways give the same rows.

Defined cases: null and empty texts, and those without words, have coverage 0 and no item; items with fewer words than the
minimum count if all their words stand in a row; equal coverages go to the smaller item_id; null items take no part;
repeated rows are judged alike; empty tables give no contamination; other columns pass through, except those named as an
added one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import Words, append_columns, grams, read, written

MIN_MATCH = 5
THRESHOLD = 0.5
BROADCAST_BYTES = 32 << 20
#: About so many pairs of equal windows of a document and an item are held at a time; the tiles don't hang on it.
MOST_PAIRS = 1 << 21
_ADDED = T.StructType([T.StructField("coverage", T.DoubleType()), T.StructField("item_id", T.LongType())])


def _windows(words: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k unmarked words, and where they begin."""
    h, at = grams(words, np.zeros(len(words), np.int8), k)
    if len(h):
        marked = np.concatenate([[0], np.cumsum(~free)])
        whole = marked[at + k] == marked[at]
        h, at = h[whole], at[whole]
    return h, at


class _Runs:
    """Runs of equal windows of a document and an item, some of the document's windows at a time, so that about ``MOST_PAIRS`` pairs of
    equal windows are held however often a word repeats."""

    def __init__(self, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray):
        near = np.isin(a, b)
        self.at_a, order = at_a[near], np.argsort(b, kind="stable")
        self.at_b = at_b[order]
        self.first = np.searchsorted(b[order], a[near], "left")
        self.count = np.searchsorted(b[order], a[near], "right") - self.first
        self.ends = np.append(0, np.cumsum(self.count))
        self.item = int(at_b.max(initial=0)) + 2
        # if all pairs fit they are made once
        self.whole = [next(self._steps())] if 0 < self.ends[-1] <= MOST_PAIRS else None

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (place in the document, place in the item) in order, and how many windows the run that ends there has."""
        return iter(self.whole) if self.whole else self._steps()

    def _steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at, carried, before = 0, np.zeros(self.item, np.int64), -2
        while at < len(self.at_a):
            to = max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + MOST_PAIRS, "right")) - 1)
            count = self.count[at:to]
            i = np.repeat(self.at_a[at:to], count)
            j = self.at_b[np.repeat(self.first[at:to] - np.cumsum(count) + count, count) + np.arange(len(i))]
            line = np.lexsort((i, i - j))
            x, y = i[line], j[line]
            new = np.ones(len(x), bool)
            new[1:] = ((x - y)[1:] != (x - y)[:-1]) | (x[1:] != x[:-1] + 1)
            begin = np.flatnonzero(new)
            # a run that begins in the first row may go on from the step before
            own = np.where((x[begin] == before + 1) & (y[begin] > 0), carried[np.maximum(y[begin] - 1, 0)], 0)
            size = np.empty(len(x), np.int64)
            size[line] = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x)))) + 1 + np.repeat(own, np.diff(np.append(begin, len(x))))
            before, carried = int(self.at_a[to - 1]), np.zeros(self.item, np.int64)
            carried[j[i == before]] = size[i == before]
            order = np.lexsort((j, i))
            yield i[order], j[order], size[order]
            at = to


def _longest(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, k: int) -> tuple[int, Iterator[tuple[int, int]]]:
    """The length of the longest common runs of unmarked words, if that is k at least (else 0), and their places in order."""
    (a, at_a), (b, at_b) = _windows(doc, free_doc, k), _windows(item, free_item, k)
    runs = _Runs(a, at_a, b, at_b)
    best = max((int(size.max(initial=0)) for _, _, size in runs), default=0)
    places = ((x, y) for i, j, size in runs for x, y in zip((i[size == best] - best + 1).tolist(), (j[size == best] - best + 1).tolist()))
    return (best + k - 1 if best else 0), places


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in doc, place in item, words), longest first."""
    least = min(min_match, len(item))
    if not least or len(doc) < least:
        return []
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), len(doc)) // 2)
    while free_item.any():
        best, places = _longest(doc, item, free_doc, free_item, length)
        if not best:
            if length == least:
                break
            length = max(least, length // 2)
            continue
        for i, j in places:
            if free_doc[i : i + best].all() and free_item[j : j + best].all():
                free_doc[i : i + best] = free_item[j : j + best] = False
                found.append((i, j, best))
    return found


class Index:
    """The benchmark's items as word hashes, and their seeds by window length."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        self.min_match = min_match
        rows = sorted(rows, key=lambda r: r[0])
        words = Words([text for _, text in rows])
        first = np.searchsorted(words.doc, np.arange(len(rows) + 1))
        held = np.flatnonzero(np.diff(first))
        self.items = [(rows[k][0], words.hash[first[k] : first[k + 1]]) for k in held.tolist()]
        number = np.zeros(len(rows), np.int64)
        number[held] = np.arange(len(held))
        size = np.diff(first)
        #: By window length: which first 20 bits occur; the seeds' hashes in order, and each one's item.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(size[held], min_match)).tolist():
            h, at = words.grams(k)
            fits = np.minimum(size[words.doc[at]], min_match) == k
            h, item = h[fits], number[words.doc[at[fits]]]
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            new = (np.diff(h, prepend=h[:1] - np.uint64(1)) != 0) | (np.diff(item, prepend=-1) != 0)
            known = np.zeros(1 << 20, bool)
            known[h >> np.uint64(44)] = True
            self.seeds[k] = (known, h[new], item[new].astype(np.int32))

    def candidates(self, words: Words) -> dict[int, set[int]]:
        """Items that share a seed with a document, by document."""
        out: dict[int, set[int]] = {}
        for k, (known, hashes, item) in self.seeds.items():
            h, at = words.grams(k)
            near = np.flatnonzero(known[h >> np.uint64(44)])
            h, doc = h[near], words.doc[at[near]]
            held = np.searchsorted(hashes, h, "left")
            there = held < len(hashes)
            there[there] = hashes[held[there]] == h[there]
            # of each document a seed once
            order = np.lexsort((h[there], doc[there]))
            h, doc, held = h[there][order], doc[there][order], held[there][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc, held = h[new], doc[new], held[new]
            count = np.searchsorted(hashes, h, "right") - held
            for d, a, n in zip(doc.tolist(), held.tolist(), count.tolist()):
                out.setdefault(d, set()).update(item[a : a + n].tolist())
        return out

    def judge(self, texts: list[str | None]) -> dict[str, list]:
        words = Words(texts)
        coverage, best = [0.0] * len(texts), [None] * len(texts)
        first = np.searchsorted(words.doc, np.arange(len(texts) + 1))
        for doc, items in self.candidates(words).items():
            own = words.hash[first[doc] : first[doc + 1]]
            for n in sorted(items):
                item_id, item = self.items[n]
                share = sum(t[2] for t in tiles(own, item, self.min_match)) / len(item)
                if share > coverage[doc]:
                    coverage[doc], best[doc] = share, item_id
        return {"coverage": coverage, "item_id": best}


def coverage(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with coverage (0 to 1) and item_id, the item that is covered best."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size <= broadcast_bytes:
        index = Index([tuple(r) for r in items.collect()], min_match)
        return append_columns(docs, index.judge, _ADDED)
    return _joined_coverage(docs, items, min_match)


def _joined_coverage(docs: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    """The same for a benchmark of any size: seeds are joined by Spark, then each pair of texts is tiled in its own row."""
    kinds = T.StructType([T.StructField("seeds_", T.ArrayType(T.LongType()))])

    def seeds_of(lengths: list[int] | None):
        def kernel(texts):
            words = Words(texts)
            first = np.searchsorted(words.doc, np.arange(len(texts) + 1))
            out = []
            for k in range(len(texts)):
                own = words.hash[first[k] : first[k + 1]]
                sizes = lengths if lengths is not None else [min(min_match, len(own))]
                out.append([h for n in sizes if n for h in np.unique(grams(own, np.zeros(len(own), np.int8), n)[0]).view(np.int64).tolist()])
            return {"seeds_": out}

        return kernel

    keyed = docs.withColumn("key_", F.xxhash64("text"))
    texts = keyed.select("key_", "text").where("text is not null").dropDuplicates(["key_"])
    item_sizes = append_columns(items, lambda texts: {"n_": [len(Words([t]).hash) for t in texts]}, T.StructType([T.StructField("n_", T.LongType())]))
    # at most ``min_match`` numbers: which seed lengths there are
    lengths = sorted(int(r["n"]) for r in item_sizes.select(F.least("n_", F.lit(min_match)).alias("n")).distinct().collect() if r["n"])
    doc_seeds = append_columns(texts, seeds_of(lengths), kinds).select("key_", F.explode("seeds_").alias("seed"))
    item_seeds = append_columns(items, seeds_of(None), kinds).select("item_id", F.col("text").alias("item"), F.explode("seeds_").alias("seed"))
    # a seed of very many documents or items: adaptive execution splits it, as nothing but the join follows its exchanges
    pairs = written(doc_seeds.join(item_seeds.select("item_id", "seed"), "seed").select("key_", "item_id").distinct())
    both = pairs.join(texts, "key_").join(items.withColumnRenamed("text", "item"), "item_id")

    @F.pandas_udf("double")
    def share(doc, item):
        import pandas as pd

        out = []
        for a, b in zip(doc, item):
            x, y = Words([a]).hash, Words([b]).hash
            out.append(sum(t[2] for t in tiles(x, y, min_match)) / len(y))
        return pd.Series(out, dtype="float64")

    judged = both.select("key_", "item_id", share("text", "item").alias("share"))
    best = judged.groupBy("key_").agg(F.max(F.struct("share", (-F.col("item_id")).alias("n"))).alias("b"))
    best = best.where("b.share > 0").select("key_", F.col("b.share").alias("coverage"), (-F.col("b.n")).alias("item_id"))
    names = {"coverage", "item_id"}
    kept = [c for c in docs.columns if c.lower() not in names]
    return keyed.select(*kept, "key_").join(best, "key_", "left").select(*kept, F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without contaminated documents."""
    return coverage(docs, benchmark).where(F.col("coverage") < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = coverage(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.round("coverage", 9).alias("coverage"), "item_id", (F.col("coverage") >= THRESHOLD).alias("contaminated"))
