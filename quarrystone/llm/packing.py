"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Piece lengths are integers up to the capacity, so the whole instance is its histogram: how many pieces have each length.
That histogram (at most ``capacity`` numbers, whatever the data's size) is solved on the driver: sets of pieces which
dominate every alternative that holds their largest piece are fixed for good, which shrinks the instance; the remainder is
packed best-fit decreasing, many equal sequences at a time. The plan says which ranks of each length go where; ranks are
given out by Spark inside salted (length, salt) groups, so a length that a third of the pieces share is no hot group.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import read, slices, small_batches, written
from quarrystone.llm.tokens import CACHE, default_path, encoder

CAPACITY = 2048


class Sizes:
    """A multiset of lengths as counts, with the distinct lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest_to(self, most: int) -> int | None:
        k = bisect_left(self.order, most + 1)
        return self.order[k - 1] if k else None

    def smallest_sum(self, k: int) -> int | None:
        """The sum of the k smallest lengths; None if there are fewer."""
        total = 0
        for s in self.order:
            t = min(k, self.n[s])
            total, k = total + t * s, k - t
            if not k:
                return total
        return None


def reduced(sizes: Sizes, capacity: int) -> list[tuple[int, list[int]]]:
    """Fixes dominating sets, from the largest length down, and takes them out; returns (times, lengths).

    A set with the largest piece dominates if each other feasible set with that piece could exchange its rest for the
    set's: alone where nothing fits beside it; with a partner that fills the sequence exactly; with the largest fitting
    partner where no two others fit; or where that partner is as long as any two that fit together.
    """
    fixed, again = [], True
    while again:
        again = False
        for size in reversed(list(sizes.order)):
            while sizes.n.get(size):
                room = capacity - size
                sizes.take(size, 1)  # one piece of this length looks for its best set
                partner = sizes.largest_to(room)
                pair = sizes.smallest_sum(2)
                if partner is None:
                    lengths = [size]
                elif partner == room or pair is None or pair > room or _best_pair(sizes, room) <= partner:
                    lengths = [size, partner]
                else:
                    _put_back(sizes, size)
                    break
                left = sizes.n.get(size, 0)
                if len(lengths) == 1:
                    times = 1 + left
                    if left:
                        sizes.take(size, left)
                elif partner == size:
                    times = (1 + left) // 2
                    sizes.take(size, 2 * times - 1)
                else:
                    # as long as the partner lasts the same reason holds
                    times = min(1 + left, sizes.n[partner])
                    if times > 1:
                        sizes.take(size, times - 1)
                    sizes.take(partner, times)
                fixed.append((times, lengths))
                again = True
    return fixed


def _put_back(sizes: Sizes, size: int) -> None:
    if size not in sizes.n:
        sizes.n[size] = 0
        insort(sizes.order, size)
    sizes.n[size] += 1


def _best_pair(sizes: Sizes, room: int) -> int:
    """The largest sum up to ``room`` of two lengths, by two pointers; only asked for where no three fit."""
    three = sizes.smallest_sum(3)
    if three is not None and three <= room:
        return room + 1
    best, low, high = 0, 0, len(sizes.order) - 1
    while low <= high:
        a, b = sizes.order[low], sizes.order[high]
        if a + b > room:
            high -= 1
        else:
            if low < high or sizes.n[a] > 1:
                best = max(best, a + b)
            low += 1
    return best


def best_fit(sizes: Sizes, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on counts: equal sequences are filled together; returns (times, lengths)."""
    groups: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, lengths: list[int]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((times, lengths))

    for size in reversed(list(sizes.order)):
        left = sizes.n[size]
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                times, lengths = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            else:
                room, times, lengths = capacity, left, []
            each = min(room // size, left)
            full = min(times, left // each)
            put(room - each * size, full, lengths + [size] * each)
            if full < times and lengths:
                put(room, times - full, lengths)
            left -= full * each
    return [x for own in groups.values() for x in own]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """All sequences as (times, lengths)."""
    sizes = Sizes(counts)
    return reduced(sizes, capacity) + best_fit(sizes, capacity)


def slots(sequences: list[tuple[int, list[int]]]) -> np.ndarray:
    """Per run of equal places: length, first rank, pieces per sequence, first sequence, first offset; sorted."""
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for times, lengths in sequences:
        offset, k = 0, 0
        while k < len(lengths):
            size, each = lengths[k], 1
            while k + each < len(lengths) and lengths[k + each] == size:
                each += 1
            rows.append((size, ranks.get(size, 0), each, first, offset))
            ranks[size] = ranks.get(size, 0) + each * times
            offset, k = offset + each * size, k + each
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Documents over the capacity are cut, the rest coming first.

    A smaller cache takes less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, cache)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode.encode(part.column("text").to_pylist())):
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, vocabulary or default_path(), capacity, cache))
    n = cut.count()
    salts = max(64, n // 200_000)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = written(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {int(r["length"]): int(r["n"]) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(own)).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first_rank, each, first, offset = table[np.searchsorted(code, (length << 44) | rank, "right") - 1].T
            sequence, within = np.divmod(rank - first_rank, each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first + sequence), pa.array(offset + within * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
