"""Sorted-string-table shards of token ids, keyed by document identifier.

Documents are range-partitioned and sorted by identifier; every task encodes its range and writes one shard into the
shared folder, under a name that no other attempt has. Only the shards that the successful tasks report are read, and files
of other attempts are removed, so a task that is lost or repeated does no harm, whatever the file system. A shard is

    data blocks     entries (shared key bytes, other key bytes, value bytes; key suffix; ids), restarts, zstd-compressed
    Bloom filter    over the keys
    block index     the last key of each block, its place, length and number of entries
    footer          places and lengths of filter and index, counts, magic

A lookup reads the footer, asks the filter, finds the block by binary search in the sparse index, and the entry by binary
search over the restarts of the block. Ids are held in 16 bits where the shard's vocabulary fits, else in 32.

Defined cases: a null text is empty and holds the end id alone; a null identifier sorts first; repeated identifiers are
all kept, next to each other; an empty table gives no shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import read, shared_dir, slices, small_batches
from quarrystone.llm.tokens import default_path, encoder

MAGIC = b"SSTIDS01"
BLOCK_BYTES, RESTART = 1 << 18, 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQB8s")
_ENTRY = struct.Struct("<HHI")


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes that sort as the identifiers do, after the empty key of null."""
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


class Bloom:
    def __init__(self, data: bytearray | bytes):
        self.data = data

    @classmethod
    def for_keys(cls, n: int) -> Bloom:
        return cls(bytearray(max(8, -(-n * BLOOM_BITS // 8))))

    def places(self, key: bytes) -> Iterator[int]:
        a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
        for k in range(BLOOM_HASHES):
            yield (a + k * b) % (8 * len(self.data))

    def add(self, key: bytes) -> None:
        for p in self.places(key):
            self.data[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.places(key))


class ShardWriter:
    """Writes entries in ascending key order; memory holds one block, the sparse index and the keys' filter."""

    def __init__(self, out, width: int):
        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=1)
        self.at, self.n, self.n_ids, self.index, self.hashes = 0, 0, 0, [], []
        self.keys: list[bytes] = []
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.last, self.count = bytearray(), [], b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        value = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last, self.count, self.n, self.n_ids = key, self.count + 1, self.n + 1, self.n_ids + len(ids) // 4
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if not self.count:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        data = self.pack.compress(body)
        self.out.write(data)
        self.index.append((self.last, self.at, len(data), self.count))
        self.at += len(data)
        self._open()

    def close(self) -> None:
        self._close_block()
        bloom = Bloom.for_keys(self.n)
        for k in self.keys:
            bloom.add(k)
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QII", *rest) for k, *rest in self.index)
        self.out.write(bytes(bloom.data) + index)
        self.out.write(_FOOTER.pack(self.at, len(bloom.data), self.at + len(bloom.data), len(index), self.n, self.n_ids, self.width, MAGIC))


class ShardReader:
    """Reads one shard; ``lookup`` by binary search, iteration in key order block by block."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < _FOOTER.size:
            raise ValueError("not a shard")
        self.bloom_at, self.bloom_len, at, length, self.n, self.n_ids, self.width, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, self.index, p = file.read_at(length, at), [], 0
        while p < len(raw):
            (k,) = struct.unpack_from("<H", raw, p)
            self.index.append((raw[p + 2 : p + 2 + k], *struct.unpack_from("<QII", raw, p + 2 + k)))
            p += 2 + k + 16

    def _block(self, place: int, length: int) -> tuple[bytes, list[int]]:
        body = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, place))
        (n,) = struct.unpack_from("<I", body, len(body) - 4)
        end = len(body) - 4 - 4 * n
        return body[:end], list(struct.unpack_from(f"<{n}I", body, end))

    def _entries(self, body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, other, length = _ENTRY.unpack_from(body, at)
            at += _ENTRY.size
            key = key[:shared] + body[at : at + other]
            at += other
            value = body[at : at + length]
            at += length
            yield key, value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for _, place, length, _ in self.index:
            body, _ = self._block(place, length)
            for key, ids in self._entries(body, 0):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> bytes | None:
        """The ids of the first document with this identifier, or None."""
        key = key_of(doc_id)
        if key not in Bloom(self.file.read_at(self.bloom_len, self.bloom_at)):
            return None
        k = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        if k == len(self.index):
            return None
        body, restarts = self._block(*self.index[k][1:3])

        def restart_key(at: int) -> bytes:
            _, other, _ = _ENTRY.unpack_from(body, at)
            return body[at + _ENTRY.size : at + _ENTRY.size + other]

        first = max(0, bisect.bisect_left(restarts, key, key=restart_key) - 1)
        for own, ids in self._entries(body, restarts[first]):
            if own >= key:
                return ids if own == key else None
        return None


def opened(path: str):
    """A pyarrow file system and the path in it, for any scheme that pyarrow knows; a bare path is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, folder: str, n_shards: int, vocabulary: str) -> list[tuple]:
    """Encodes and writes all documents; returns per shard (shard, file, n_docs, n_ids), a few numbers per task."""
    # the texts' hashes let an identifier with very many rows spread over several shards
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = small_batches(docs).select("doc_id", "text").repartitionByRange(n_shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(vocabulary)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        fs, root = opened(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        writer = None
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = ShardWriter(sink, width)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode.encode(part.column("text").to_pylist())):
                    writer.add(key_of(doc_id), ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{folder}/{name}"], "n_docs": [writer.n], "n_ids": [writer.n_ids]})

    shards = sorted(tuple(r) for r in ranged.mapInArrow(run, "shard long, file string, n_docs long, n_ids long").collect())
    fs, root = opened(folder)
    whole = {file.rsplit("/", 1)[1] for _, file, _, _ in shards}
    for found in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("shard-") and found.base_name not in whole:
            fs.delete_file(found.path)
    return shards


def read_shards(spark: SparkSession, shards: list[tuple]) -> DataFrame:
    """Per document of the shards, in file order: doc_id, start, n_tokens, ids_crc32, ids (bytes, unsigned 32 bits)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")), T.StructField("ids", T.BinaryType())])
    rows, start = [], 0
    for _, file, _, n_ids in shards:
        rows.append((file, start))
        start += n_ids
    files = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = opened(row["file"])
                start, held, size = row["start"], [], 0
                with fs.open_input_file(path) as file:
                    for doc_id, ids in ShardReader(file):
                        held.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size > 1 << 22:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=schema.names)

    return files.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    folder = f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    shards = write_shards(docs, folder, n, default_path())
    return read_shards(spark, shards).drop("ids")
