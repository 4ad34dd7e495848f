"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words and their beginnings, hashed; the
document's score is their noisy-or, 1 - prod(1 - p). Only documents have labels: the likelihood of the noisy-or is what is trained, so the
sentences' scores are learned through it, and afterwards they locate the offending sentences.

Fitted on a bounded sample of labelled rows (about ``TRAIN`` of either label, a parameter; repeated labels of a document
count once, the larger, and of the texts of a repeated doc_id the one with the smallest hash). Features are screened by Spark:
how many documents of either label have each is a grouped count, and only the telling features of the sample's sentences
reach the driver. Defined cases: null and empty texts, and those without words, score 0; repeated rows score alike; without
labels every score is 0; an empty table gives an empty result; other columns pass through and are never inputs, except
those named as an added one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import Words, append_columns, mixed, read, written

BITS = 18
TRAIN, ROUNDS, RATE, DECAY = 2000, 150, 0.2, 1e-3
#: Besides whole words, their first so many bytes are features. A feature is used if so many documents of the sample
#: have it and its shares in the two labels differ by so many standard errors.
PREFIXES = (4, 6)
LEAST_DOCS, LEAST_Z = 3, 4.0
#: Sentences from this score on are offending ones.
OFFENDING = 0.3


def features(texts: list[str | None], bits: int = BITS):
    """(sentence, hashed feature) pairs, repeats included; of each sentence its document and first byte; the Words."""
    words = Words(texts)
    number, doc, start = words.sentences()
    shift = np.uint64(64 - bits)
    pairs = [(number, words.hash >> shift)]
    for k in PREFIXES:
        long = np.flatnonzero(words.end - words.start >= k)
        pairs.append((number[long], mixed(words.prefix(long, k) + np.uint64(k)) >> shift))
    return np.concatenate([s for s, _ in pairs]).astype(np.int64), np.concatenate([w for _, w in pairs]).astype(np.int64), doc, start, words


def distinct(sentence: np.ndarray, word: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((sentence << bits) | word)
    return pairs >> bits, pairs & ((1 << bits) - 1)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros(1 << BITS), -np.inf)

    @classmethod
    def fit(cls, bags: list[tuple[np.ndarray, np.ndarray, int]], names: np.ndarray, positive_share: float, sentences: list[int] | None = None) -> Model:
        """bags: per document the sentence and word of its pairs, and its label; names: the telling features, ascending, the
        only ones that are used; sentences: how many each document has. Labels are weighted to their share.

        Adam on the likelihood of the noisy-or, with decay that draws useless words to zero.
        """
        labels = np.array([y for _, _, y in bags], float)
        if not len(labels) or labels.min() == labels.max():
            return cls.empty()
        offsets = np.cumsum([0, *(sentences or (int(s.max()) + 1 if len(s) else 1 for s, _, _ in bags))])
        sentence = np.concatenate([s.astype(np.int64) + o for (s, _, _), o in zip(bags, offsets)])
        word = np.concatenate([w.astype(np.int64) for _, w, _ in bags])
        doc = np.repeat(np.arange(len(bags)), np.diff(offsets))
        place = np.full(1 << BITS, -1)
        place[names] = np.arange(len(names))
        keep = place[word] >= 0
        sentence, word = sentence[keep], place[word[keep]]
        share = labels.mean()
        weight = np.where(labels == 1, positive_share / share, (1 - positive_share) / (1 - share))
        n, n_sentences, total = len(names), offsets[-1], weight.sum()
        w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        w[-1] = -np.log(np.diff(offsets).mean() / max(positive_share, 1e-3))
        for step in range(1, ROUNDS + 1):
            z = np.bincount(sentence, w[word], minlength=n_sentences) + w[-1]
            soft = np.logaddexp(0, z)
            s = np.maximum(np.bincount(doc, soft, minlength=len(bags)), 1e-9)
            slope = np.where(labels == 1, -1 / np.expm1(np.minimum(s, 50)), 1.0) * weight / total
            g = slope[doc] * np.exp(z - soft)
            gradient = np.append(np.bincount(word, g[sentence], minlength=n), g.sum())
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - DECAY * RATE)
        weights = np.zeros(1 << BITS)
        weights[names] = w[:-1]
        return cls(weights, w[-1])

    def score(self, texts: list[str | None]) -> dict[str, list]:
        sentence, word, doc, start, words = features(texts)
        used = self.weights[word] != 0
        sentence, word = distinct(sentence[used], word[used])
        z = np.bincount(sentence, self.weights[word], minlength=len(doc)) + self.bias
        with np.errstate(over="ignore", invalid="ignore"):
            soft = np.logaddexp(0, z)
            own = 1 - np.exp(-soft)
        score = 1 - np.exp(-np.bincount(doc, soft, minlength=len(texts))) if len(doc) else np.zeros(len(texts))
        found: list[list[dict]] = [[] for _ in texts]
        for k in np.flatnonzero(own >= OFFENDING).tolist():
            d = int(doc[k])
            first, begin = int(words.doc_start[d]), int(start[k])
            stop = int(start[k + 1]) if k + 1 < len(doc) and doc[k + 1] == d else first + len(texts[d].encode("utf-8", "surrogatepass"))
            place = lambda at: len(bytes(words.raw[first:at]).decode("utf-8", "replace"))  # noqa: B023, E731
            found[d].append({"start": place(begin), "end": place(stop), "score": float(own[k])})
        return {"toxicity": np.round(score, 6).astype(float).tolist(), "offending": found}


_PLACE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
_ADDED = T.StructType([T.StructField("toxicity", T.DoubleType()), T.StructField("offending", T.ArrayType(_PLACE))])


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def telling(table: DataFrame) -> np.ndarray:
    """Of a table of documents' distinct features (words, toxic): the features that enough documents have and whose shares
    in the two labels differ by enough standard errors; at most 2**BITS small numbers, counted by Spark."""
    n = {int(r["toxic"]): int(r["n"]) for r in table.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, np.int64)
    has = lambda y: F.count(F.when(F.col("toxic") == y, 1))
    counts = table.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(has(0).alias("c0"), has(1).alias("c1"))
    even = (F.col("c0") + F.col("c1")) / F.lit(n0 + n1)
    z = F.abs(F.col("c1") / F.lit(n1) - F.col("c0") / F.lit(n0)) / F.sqrt(F.greatest(even * (1 - even), F.lit(1e-12)) * F.lit(1 / n0 + 1 / n1))
    return np.array(sorted(r["word"] for r in counts.where((F.col("c0") + F.col("c1") >= LEAST_DOCS) & (z >= LEAST_Z)).select("word").collect()), np.int64)


def fitted(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Model:
    """A model of about ``train`` labelled documents of either label that aren't held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"]): int(r["n"]) for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model.empty()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, int(min(1, train / sizes[1]) * (1 << 30))).otherwise(int(min(1, train / sizes[0]) * (1 << 30)))
    # about 2 * train rows of two numbers, whatever the size of the tables
    picked = F.broadcast(usable.where(order < limit).limit(4 * train))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def kernel(texts):
        out, words = [], []
        for t in texts:
            pairs = distinct(*features([t])[:2])
            out.append(np.stack(pairs).astype("<u4").tobytes())
            words.append(np.unique(pairs[1]).astype(np.int32))
        return {"pairs_": out, "words": words}

    added = T.StructType([T.StructField("pairs_", T.BinaryType()), T.StructField("words", T.ArrayType(T.IntegerType()))])
    sample = written(append_columns(texts, kernel, added).select("doc_id", "toxic", "pairs_", "words"))
    names = telling(sample)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[names] = True
        for batch in batches:
            kept = []
            for pairs in batch.column("pairs_").to_pylist():
                sentence, word = np.frombuffer(pairs, "<u4").reshape(2, -1)
                good = known[word]
                # the last sentence's number stays, as the noisy-or goes over all sentences
                kept.append((int(sentence.max()) + 1 if len(sentence) else 1, np.stack([sentence[good], word[good]]).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array([n for n, _ in kept], pa.int32()), pa.array([p for _, p in kept], pa.binary())], names=["doc_id", "toxic", "sentences", "pairs"])

    rows = sample.select("doc_id", "toxic", "pairs_").mapInArrow(told, "doc_id long, toxic int, sentences int, pairs binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["pairs"]))
    bags = [(*np.frombuffer(r["pairs"], "<u4").reshape(2, -1), int(r["toxic"])) for r in rows]
    return Model.fit(bags, names, sizes[1] / (sizes[0] + sizes[1]), [r["sentences"] for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and offending (start, end in code points, and score, of the offending sentences)."""
    return append_columns(docs, model.score, _ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fitted(docs, read(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
