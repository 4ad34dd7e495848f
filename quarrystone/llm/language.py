"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3; hashed; two end marks follow a text) present in both, over the root of the
product of their numbers: a blended-spectrum presence kernel. Some training texts are Nyström landmarks; one-versus-rest
kernel ridge regression over them gives a weight per landmark and language. Texts are scored in batches by two matrix
products: presence by landmarks, kernel values by weights.

Fitted on a bounded sample of labelled rows (about ``TRAIN`` rows, a parameter, as many of every language as there are). A text's language is the one with the
highest score; ties go to the language first in the alphabet. Defined cases: null, empty and letterless texts are ``und``
with score 0, as all texts are if no row is labelled; repeated rows are predicted alike; an empty table gives an empty
result; other columns pass through and are never inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import append_columns, read

BITS = 15
TRAIN, LANDMARKS, RIDGE = 3000, 96, 1e-3
UNKNOWN = "und"
#: Below this score a text is in none of the learned languages; the pipeline lets such texts go.
LEAST_SCORE = 0.1


def has_letter(text: str | None) -> bool:
    return next(filter(str.isalpha, text or ""), None) is not None


def presence(texts: list[str | None], bits: int = BITS) -> np.ndarray:
    """A row per text: which hashed 1-, 2- and 3-grams of its lower-cased characters occur."""
    out = np.zeros((len(texts), 1 << bits), bool)
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    gap = np.zeros(2, np.uint32)
    flat = np.concatenate([x for c in codes for x in (c, gap)]).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(codes)), [len(c) + 2 for c in codes]) << bits
    cells, shift = out.reshape(-1), np.uint64(64 - bits)
    h = np.zeros(len(flat), np.uint64)
    for n in range(3):
        m = len(flat) - n
        h = h[:m] * np.uint64(0x100000001B3) + flat[n:] + np.uint64(1)
        inside = flat[:m] != 0
        cells[row[:m][inside] + ((h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)] = True
    return out


class Model:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.weights = languages, weights
        self.columns = np.flatnonzero(landmarks.any(axis=0))
        norm = np.sqrt(np.maximum(1, landmarks.sum(axis=1)))
        self.landmarks = np.ascontiguousarray((landmarks[:, self.columns] / norm[:, None]).T.astype(np.float32))

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.int64)))
        return (rows[:, self.columns].astype(np.float32) @ self.landmarks) / own[:, None]

    @classmethod
    def fit(cls, rows: np.ndarray, labels: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        """rows: presence; landmarks are taken from the languages in turn."""
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros((1, rows.shape[1] if rows.ndim == 2 else 1 << BITS), bool), np.zeros((1, 0)))
        y = np.searchsorted(languages, labels)
        turn = np.zeros(len(y), np.int64)
        for c in range(len(languages)):
            turn[y == c] = np.arange((y == c).sum())
        picked = np.lexsort((y, turn))[:n_landmarks]
        model = cls(languages, rows[picked], np.zeros((len(picked), len(languages))))
        k = model.kernel(rows).astype(np.float64)
        share = np.bincount(y) / len(y)
        weight = 1 / (len(languages) * share[y])
        target = np.eye(len(languages))[y]
        left = k.T @ (k * weight[:, None]) + ridge * len(y) * k[picked] + 1e-6 * np.eye(len(picked))
        model.weights = np.linalg.solve(left, k.T @ (target * weight[:, None]))
        return model

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(known), 128):
            part = known[at : at + 128]
            values = self.kernel(presence([texts[k] for k in part])) @ self.weights
            best = values.argmax(axis=1)
            for k, c, v in zip(part, best.tolist(), values.max(axis=1).tolist()):
                languages[k], scores[k] = self.languages[c], round(min(1.0, max(0.0, v)), 6)
        return {"lang_pred": languages, "lang_score": scores}


def bucket() -> F.Column:
    """crc32 of the identifier as text, modulo 4; rows where it is 2 are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def fitted(docs: DataFrame, train: int = TRAIN) -> Model:
    """A model of labelled rows that aren't held out: of every language about ``train`` by the number of languages, chosen by a
    hash of the row, so that null and repeated identifiers count like others; equal rows are taken once, twice ``train`` at most."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket() != 2))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    shares = [(lang, int(min(1.0, train / len(sizes) / n) * (1 << 30))) for lang, n in sorted(sizes.items())]
    # a row per language
    quota = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, most_ long"))

    def kernel(texts):
        return {"bits_": [np.packbits(presence([t])[0]).tobytes() for t in texts]}

    picked = usable.select("doc_id", "text", "lang", order.alias("order_")).join(quota, "lang").where("order_ < most_")
    sample = picked.dropDuplicates(["doc_id", "order_", "lang"]).select("text", F.col("lang").alias("lang_"), "order_").limit(2 * train)
    rows = append_columns(sample, kernel, T.StructType([T.StructField("bits_", T.BinaryType())])).drop("text").collect()
    rows.sort(key=lambda r: (r["order_"], r["lang_"], r["bits_"]))
    bits = np.array([np.frombuffer(r["bits_"], np.uint8) for r in rows], np.uint8).reshape(len(rows), (1 << BITS) // 8)
    return Model.fit(np.unpackbits(bits, axis=1).astype(bool), [r["lang_"] for r in rows])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and lang_score."""
    return append_columns(docs, model.predict, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that are in a learned language, by a score of at least ``least``."""
    found = identified(docs, fitted(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identified(docs.select("doc_id", "text"), fitted(docs))
    return found.select("doc_id", (bucket() == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
