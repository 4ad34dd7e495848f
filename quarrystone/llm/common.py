"""Helpers shared by the text operators: table reads, shared-folder tables, Arrow kernels, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Kernels get slices of an Arrow batch of about so many bytes of text (one longer text is a slice of its own).
SLICE_BYTES = 1 << 19
#: Arrow batches of texts get so many rows where the session has Spark's default, which is meant for small rows.
BATCH_ROWS, DEFAULT_ROWS = 2000, "10000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    A session on one machine (tests) that names none gets a default; on a cluster that is an error, as a local folder would
    be another one on each executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/quarrystone"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, which survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches: executors then hold less outside the heap."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == DEFAULT_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with at most about ``most`` bytes in ``column``."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def append_columns(
    docs: DataFrame,
    kernel: Callable[[list[str | None]], dict[str, object]],
    added: T.StructType,
    text: str = "text",
) -> DataFrame:
    """Rows of ``docs`` with the columns ``added``, computed from whole texts by ``kernel``, a function of a list.

    Input columns with the name of an added one are replaced. No shuffle.
    """
    names = {f.name.lower() for f in added}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    arrow = {f.name: _arrow_type(f.dataType) for f in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = kernel(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(got[n], type=t) for n, t in arrow.items())],
                    names=[*part.schema.names, *arrow],
                )
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Odd multipliers of the rolling hash, its inverse modulo 2**64, and of the mixing steps.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


#: Byte classes: a-z, 0-9 and bytes from 0x80 are themselves, A-Z become a-z, all else separates words.
FOLD = np.array([c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if 65 <= c <= 90 else 0 for c in range(256)], np.uint8)
BREAKS = np.zeros(256, bool)
BREAKS[[0, *b".!?\n"]] = True


class Words:
    """The words of a list of texts as flat arrays: ``hash`` (64 bits), ``doc``, and on demand ``sentence``.

    A word is a maximal run of ASCII letters and digits and of bytes from 0x80; A-Z count as a-z. Null texts have none.
    """

    def __init__(self, texts: list[str | None]):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        self.raw, self.n_docs = raw, len(parts)
        self.doc_start = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1] if parts else np.zeros(0, np.int64)
        folded = FOLD[raw]
        inside = folded != 0
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edges[::2], edges[1::2]
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        self._total, self._down = total, down
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start])
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its sentence's number; of each sentence with words its document and first byte."""
        place = np.cumsum(BREAKS[self.raw])[self.start]
        new = np.diff(place, prepend=-1) != 0
        number = np.cumsum(new) - 1
        return number, self.doc[new], self.start[new]

    def prefix(self, which: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the first k bytes of some words, which must be that long."""
        at = self.start[which]
        return mixed((self._total[at + k] - self._total[at]) * self._down[at])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Karp-Rabin hashes of all windows of k words inside one document, and the first word of each."""
        return grams(self.hash, self.doc, k)


def grams(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(BASE) + words[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mixed(total[at]), at
