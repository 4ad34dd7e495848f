"""Terms of whole texts as Arrow arrays, and tables of documents and their slices' distinct terms.

A slice is some documents that stand next to each other in a task, of about ``SLICE`` bytes of text (one longer text is a
slice of its own). Its distinct terms are rows of their own, so a table of any number of terms is looked up by a join of
one row per slice and term, and no vocabulary is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import _arrow_type, small_batches, written

SLICE, SLICE_ROWS = 12 << 20, 20_000
SPACE = 0x20


def _table(kept: Callable[[int], bool]) -> np.ndarray:
    """Of each byte what it counts as: A-Z as a-z, those not kept as a space."""
    return np.array([(b + 32 if 65 <= b <= 90 else b) if kept(b) else SPACE for b in range(256)], np.uint8)


#: Words end at ASCII white space; runs of letters end at any ASCII character that isn't a letter.
WORDS = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LETTERS = _table(lambda b: b >= 0x80 or chr(b).isalpha())


def tokens(texts: pa.Array, fold: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the number of each one's text. Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n, (_, offsets, data) = len(texts), texts.buffers()
    if not n or not data:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
    folded = fold[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    plain = pa.StringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(folded))
    lists = pc.ascii_split_whitespace(plain)
    found, text = lists.flatten(), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    whole = pc.greater(pc.binary_length(found), 0)
    return found.filter(whole), text[whole.to_numpy(zero_copy_only=False)]


def numbered(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each term among the distinct ones, and these, in order of their first places."""
    coded = found.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def gathered(batches: Iterator[pa.RecordBatch], most: int = SLICE, column: str = "text") -> Iterator[pa.Table]:
    """Tables of consecutive rows with about ``most`` bytes in ``column``, and at most about SLICE_ROWS rows."""
    parts: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(lengths), 0
        while a < batch.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + most - size, "right")))
            b = min(b, batch.num_rows, a + max(1, SLICE_ROWS - rows))
            parts.append(batch.slice(a, b - a))
            size, rows, a = size + int(ends[b - 1]) - before, rows + b - a, b
            if size >= most or rows >= SLICE_ROWS or a < batch.num_rows:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts, size, rows = [], 0, 0
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def text_of(table: pa.Table, column: str = "text") -> pa.Array:
    got = table.column(column)
    return got.combine_chunks() if got.num_chunks != 1 else got.chunk(0)


def _own(docs: DataFrame, names: set[str]) -> list[T.StructField]:
    return [f for f in docs.schema if f.name != "text" and f.name.lower() not in names]


def sliced(docs: DataFrame, kernel: Callable[[pa.Array], tuple[dict[str, object], pa.Array, bytes | None]], added: T.StructType, term: T.DataType, most: int = SLICE) -> DataFrame:
    """A written table with a row per document and a row per slice and distinct term.

    ``kernel`` gets a slice's texts and gives the columns ``added`` of its documents, its distinct terms, and bytes of the
    slice if any. Rows of documents hold their columns but the text; ``slice_`` numbers slices, ``at_`` numbers a slice's terms,
    ``term_`` is null but in rows of terms, ``bytes_`` is set in a row of its own. Columns of ``docs`` named as an added one go.
    """
    names = {f.name.lower() for f in added} | {"slice_", "at_", "term_", "bytes_"}
    own = _own(docs, names)
    schema = T.StructType([*own, *added.fields, T.StructField("slice_", T.LongType()), T.StructField("at_", T.IntegerType()), T.StructField("term_", term), T.StructField("bytes_", T.BinaryType())])
    types = {f.name: _arrow_type(f.dataType) for f in schema}

    def rows(n: int, **given: object) -> pa.RecordBatch:
        columns = [given[k] if isinstance(given.get(k), pa.Array) else pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in types.items()]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types.values())], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(gathered(batches, most)):
            columns, terms, payload = kernel(text_of(table))
            n, number = table.num_rows, first + k
            yield rows(n, slice_=np.full(n, number), **{f.name: text_of(table, f.name) for f in own}, **columns)
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                yield rows(len(part), slice_=np.full(len(part), number), at_=np.arange(a, a + len(part), dtype=np.int32), term_=part)
            if payload is not None:
                yield rows(1, slice_=[number], bytes_=[payload])
        pa.default_memory_pool().release_unused()

    columns = [f.name for f in own]
    return written(small_batches(docs).select(*columns, F.col("text")).mapInArrow(run, schema))


def looked_up(table: DataFrame, values: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], added: T.StructType, kept: list[str]) -> DataFrame:
    """Rows of documents of a ``sliced`` table with new columns.

    ``values`` has term_ and more, one row a term; ``finish`` gets a slice's rows (of documents and bytes) and its terms' rows
    (at_ and values, those found) and gives the columns ``added`` of the documents. ``kept`` are columns that pass through.
    """
    inner = [c for c in values.columns if c != "term_"]
    terms = table.where("term_ is not null").select("slice_", "at_", "term_").join(values, "term_").select(F.col("slice_").alias("of_"), "at_", *inner)
    rows = table.where("term_ is null").drop("term_", "at_")
    fields = [f for f in table.schema if f.name in kept]
    types = {f.name: _arrow_type(f.dataType) for f in [*fields, *added.fields]}

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        got = finish(left, right)
        docs = left.filter(pc.is_null(left.column("bytes_")))
        columns = [docs.column(f.name) for f in fields] + [got.column(f.name) for f in added]
        return pa.table([c.cast(t) for c, t in zip(columns, types.values())], names=list(types))

    return rows.groupBy("slice_").cogroup(terms.groupBy("of_")).applyInArrow(joined, T.StructType([*fields, *added.fields]))
