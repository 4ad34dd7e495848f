"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed once per row without a shuffle. Distinct fingerprints meet in buckets (two of them within r
bits share k - r of k blocks of bits, for every such choice), whose size stays bounded as the data grows because the
key gets more bits. A bucket larger than a tile is split into pairs of tiles, so no task gets an unbounded group. Inside
a tile pair bit planes stand vertically, 64 fingerprints to a machine word: one XOR and a carry-save addition per plane
updates 64 distances, and words in which all distances are over the radius are abandoned. A tile pair reports a spanning
forest of its links, which loses no component and never lists all pairs.

Given a similarity (the pipeline: 0.8), texts are also linked whose distinct five-word shingles have that Jaccard
similarity. Wide fingerprints of 256 bits only find candidates: random choices of their bits deal texts into buckets, as
many as the whole chain needs for a recall of 0.99 there, and near ones become candidates. Inside each component of
candidates the shingles themselves are compared, in tile pairs, and only pairs that are alike by them are linked.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer words
than a shingle count as one shingle; repeated rows share a fingerprint and so a component; null doc_ids never become a
component's id unless a component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import Words, append_columns, grams, mixed, read, written
from quarrystone.llm.components import connected_components

SEED = 42
WORDS_PER_SHINGLE = 3
RADIUS = 3
#: A bucket has about so many fingerprints on average; a larger one is split into tiles of so many.
BUCKET, TILE = 512, 4096
#: Pairs are handed on of so many words of 64 distances at a time.
YIELD_WORDS = 2048
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words_per_shingle: int = WORDS_PER_SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends)]
    n = max(1, len(words) - words_per_shingle + 1)
    last = ends[words_per_shingle - 1 :] or ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], last[at : at + (1 << 15)])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = WORDS_PER_SHINGLE) -> DataFrame:
    """``docs`` with the column ``simhash`` (signed 64 bits). No shuffle."""

    def kernel(texts):
        return {"simhash": np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)}

    return append_columns(docs, kernel, T.StructType([T.StructField("simhash", T.LongType())]))


def bit_sliced(left: np.ndarray, right: np.ndarray, radius: int):
    """Yields index arrays (i, j) of all pairs of left[i], right[j] (uint64) that differ in at most ``radius`` bits."""
    n = len(right)
    if not n or not len(left):
        return
    words = -(-n // 64)
    spread = np.zeros((64, words * 64), np.uint8)
    spread[:, :n] = (right[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    planes = np.packbits(spread, axis=1, bitorder="little").view(np.uint64)
    beyond = np.zeros(words, np.uint64)
    if n % 64:
        beyond[-1] = _ONES << np.uint64(n % 64)
    levels = max(1, radius.bit_length())
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        masks = np.where((part[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), _ONES, np.uint64(0))
        row, word = (x.ravel() for x in np.indices((len(part), words)))
        over = np.tile(beyond, len(part))
        counters = [np.zeros(len(row), np.uint64) for _ in range(levels)]
        for b in range(64):
            if b < 16 and len(row) == len(part) * words:
                carry = (planes[b][None, :] ^ masks[b][:, None]).ravel()
            else:
                carry = planes[b][word] ^ masks[b][row]
            for level in range(levels):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            over |= carry
            if b % 8 == 7:  # words of 64 distances that all exceed the radius are abandoned
                keep = np.flatnonzero(over != _ONES)
                if len(keep) < 0.7 * len(row):
                    row, word, over = row[keep], word[keep], over[keep]
                    counters = [c[keep] for c in counters]
                if not len(row):
                    break
        keep = np.flatnonzero(over != _ONES)
        if not len(keep):
            continue
        lane = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for first in range(0, len(keep), YIELD_WORDS):  # very many near pairs come in parts
            own = keep[first : first + YIELD_WORDS]
            distance = sum(lane(c[own]).astype(np.int16) << level for level, c in enumerate(counters))
            k, bit = np.nonzero((lane(over[own]) == 0) & (distance <= radius))
            yield at + row[own][k], word[own][k] * 64 + bit


def labels(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of n nodes the smallest one each is connected to, by blocks of linked index arrays."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    while not (label[label] == label).all():
        label = label[label]
    return label


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what links within ``left``, or between ``left`` and ``right``, connect."""
    right = left if right is None else right
    both = np.unique(np.concatenate([left, right]))
    at_left, at_right = np.searchsorted(both, left), np.searchsorted(both, right)
    label = labels(len(both), ((at_left[i], at_right[j]) for i, j in bit_sliced(left.view(np.uint64), right.view(np.uint64), radius)))
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def bucket_keys(n: int, radius: int, bucket: int = BUCKET) -> list[list[tuple[int, int]]]:
    """For n fingerprints, the bit ranges (first, length) of every bucket key: any two within the radius share a key.

    The 64 bits are cut into k blocks, of which two fingerprints within the radius share k - radius at least.
    """
    want = max(0, math.ceil(math.log2(max(1, n / bucket))))
    if want == 0:
        return [[]]
    for k in range(radius + 1, radius + 5):
        if want <= (64 // k) * (k - radius):
            break
    size, out = 64 // k, []
    for blocks in combinations(range(k), k - radius):
        left, ranges = want, []
        for b in blocks:
            if left > 0:
                ranges.append((b * size, min(size, left)))
                left -= size
        out.append(ranges)
    return [list(x) for x in dict.fromkeys(map(tuple, out))]


def links(prints: DataFrame, n: int, radius: int = RADIUS, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``prints.simhash``, as a forest per tile pair; a > b."""
    keys = []
    for k, ranges in enumerate(bucket_keys(n, radius, bucket)):
        value, shift = F.lit(0).cast("long"), 0
        for first, size in ranges:
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("simhash", first).bitwiseAND(F.lit((1 << size) - 1)), shift))
            shift += size
        keys.append(F.struct(F.lit(k).alias("band"), value.alias("key")))
    rows = prints.select("simhash", F.explode(F.array(*keys)).alias("k")).select("simhash", "k.band", "k.key")
    dealt = _tile_pairs(rows, ["simhash"], "simhash", F.ceil(F.count("*") / F.lit(tile)))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        values, side = group["simhash"].to_numpy(), group["own"].to_numpy()
        if i == j:
            a, b = forest(values, None, radius)
        else:
            a, b = forest(values[side == i], values[side == j], radius)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("band", "key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


WIDE_WORDS, WIDE_SHINGLE, RECALL = 4, 5, 0.99
#: Comparing is cheap beside moving rows: with larger buckets fewer tables reach the recall.
WIDE_BUCKET = 4096
#: A tile of a component of candidates has about so many shingles on average (8 bytes each).
TILE_SHINGLES = 1 << 19


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of k words (all words, if fewer), as hashes, and their documents; sorted by document and hash."""
    h, at = words.grams(k)
    doc = words.doc[at]
    sizes = np.bincount(words.doc, minlength=words.n_docs)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        first = np.searchsorted(words.doc, short)
        own = [grams(words.hash[a : a + m], np.zeros(m, np.int8), m)[0][0] for a, m in zip(first.tolist(), sizes[short].tolist())]
        h, doc = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _prints(words: Words, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document n 64-bit SimHashes of its distinct windows of k words, zeros without words; and how many it has."""
    h, doc = _shingles(words, k)
    out = np.zeros((words.n_docs, n), np.uint64)
    if not len(h):
        return out, np.zeros(words.n_docs, np.int64)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.diff(np.append(starts, len(h)))
    for seed in range(n):
        bits = np.unpackbits(mixed(h + np.uint64(seed)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[doc[starts], seed] = np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel()
    return out, np.bincount(doc, minlength=words.n_docs)


def wide_fingerprints(docs: DataFrame, words_per_shingle: int = WORDS_PER_SHINGLE) -> DataFrame:
    """``docs`` with ``simhash``, ``wide`` (256 bits of five-word shingles, null without words) and ``shingles``, how many those
    are; all by one Python worker a task."""

    def kernel(texts):
        wide, sizes = _prints(Words(texts), WIDE_SHINGLE, WIDE_WORDS)
        own = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)
        return {"simhash": own, "wide": [w.tobytes() if n else None for w, n in zip(wide, sizes)], "shingles": sizes}

    return append_columns(docs, kernel, T.StructType([T.StructField("simhash", T.LongType()), T.StructField("wide", T.BinaryType()), T.StructField("shingles", T.LongType())]))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``texts`` (node, text) as node and ``sets``, the sorted hashes of the distinct five-word shingles (8 bytes each)."""

    def kernel(part):
        h, doc = _shingles(Words(part), WIDE_SHINGLE)
        cuts = np.searchsorted(doc, np.arange(len(part) + 1))
        return {"sets": [h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}

    return append_columns(texts, kernel, T.StructType([T.StructField("sets", T.BinaryType())])).drop("text")


def wide_limits(similarity: float) -> tuple[int, int, float]:
    """For a Jaccard similarity of shingles: the largest distance of wide prints (its mean and three standard deviations),
    of their first 64 bits (its mean and four), and the chance that a bit differs. Each is a filter; none decides."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = lambda n, more: int(n * differ + more * math.sqrt(n * differ * (1 - differ)))
    return far(64 * WIDE_WORDS, 3), far(64, 4), differ


def wide_recall(similarity: float, bits: int, tables: int) -> float:
    """The chance that a pair of that similarity shares one of the tables' buckets and passes both limits."""
    most_wide, most_first, differ = wide_limits(similarity)
    n = 64 * WIDE_WORDS
    chance = lambda n, d: math.comb(n, d) * differ**d * (1 - differ) ** (n - d)
    met = sum(chance(n, d) * (1 - (1 - math.comb(n - d, bits) / math.comb(n, bits)) ** tables) for d in range(most_wide + 1))
    return met - sum(chance(64, d) for d in range(most_first + 1, 65))


def wide_tables(similarity: float, n: int, bucket: int = WIDE_BUCKET) -> tuple[int, int]:
    """For n texts: the bits of a bucket's key, and the fewest tables that give the recall."""
    bits = min(40, max(0, math.ceil(math.log2(max(1, n / bucket)))))
    tables = 1
    while bits and wide_recall(similarity, bits, tables) < RECALL:
        tables += 1
    return bits, tables


def _near(wide: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, most_wide: int, most_first: int):
    """Yields index arrays of the pairs of ``left`` and ``right`` whose wide prints are near."""
    for a, b in bit_sliced(wide[left, 0], wide[right, 0], most_first):
        a, b = left[a], right[b]
        keep = a < b if same else slice(None)
        a, b = a[keep], b[keep]
        far = np.zeros(len(a), np.int64)
        for w in range(WIDE_WORDS):
            far += np.bitwise_count(wide[a, w] ^ wide[b, w])
        yield a[far <= most_wide], b[far <= most_wide]


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of a tile pair: nodes, wide prints, the rows of either tile, and whether it is one tile with itself."""
    i, j, side = int(group["i"].iloc[0]), int(group["j"].iloc[0]), group["own"].to_numpy()
    wide = np.frombuffer(b"".join(map(bytes, group["wide"])), np.uint64).reshape(-1, WIDE_WORDS)
    return group["node"].to_numpy(), wide, np.flatnonzero(side == i), np.flatnonzero(side == j), i == j


def wide_candidates(texts: DataFrame, n: int, similarity: float, bucket: int = WIDE_BUCKET, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over ``texts`` (node, wide), n of them, as a forest per tile pair of those whose wide prints are near."""
    most_wide, most_first, _ = wide_limits(similarity)
    bits, tables = wide_tables(similarity, n, bucket)
    keys = []
    for k in range(tables):
        value = F.lit(0).cast("long")
        for place, bit in enumerate(sorted(random.Random(k).sample(range(64 * WIDE_WORDS), bits))):
            value = value.bitwiseOR(F.shiftleft(F.shiftright(f"part{bit // 32}", bit % 32).bitwiseAND(F.lit(1)), place))
        keys.append(F.struct(F.lit(k).alias("band"), value.alias("key")))
    parts = [F.conv(F.hex(F.substring("wide", 4 * k + 1, 4)), 16, 10).cast("long").alias(f"part{k}") for k in range(2 * WIDE_WORDS)]
    rows = texts.where("wide is not null").select("node", "wide", *parts).select("node", "wide", F.explode(F.array(*keys)).alias("k")).select("node", "wide", "k.band", "k.key")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        node, wide, left, right, same = _sides(group)
        label = labels(len(node), _near(wide, left, right, same, most_wide, most_first))
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    dealt = _tile_pairs(rows, ["node", "wide"], "node", F.ceil(F.count("*") / F.lit(tile)))
    return dealt.groupBy("band", "key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have at least that Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b) - 1e-9:
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def wide_links(texts: DataFrame, docs: DataFrame, n: int, similarity: float, bucket: int = WIDE_BUCKET, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Edges (a, b) over ``texts`` (node, wide, shingles), n of them, whose shingles have that Jaccard similarity, as a
    forest per tile pair; ``docs`` (node, text, repeated at will) has the texts."""
    most_wide, most_first, _ = wide_limits(similarity)
    found = written(connected_components(wide_candidates(texts, n, similarity, bucket, tile)))
    sets = shingle_sets(docs.groupBy("node").agg(F.first("text").alias("text")).join(found.select("node"), "node", "left_semi"))
    rows = written(sets).join(texts, "node").join(found, "node").select("node", "wide", "sets", "shingles", F.lit(0).alias("band"), F.col("root").alias("key"))

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        node, wide, left, right, same = _sides(group)
        sets = [np.frombuffer(s, np.uint64) for s in group["sets"]]
        label, out = np.arange(len(node)), []
        for a, b in _near(wide, left, right, same, most_wide, most_first):
            for row in np.unique(a).tolist():
                own = b[a == row]
                for other in own[label[own] != label[row]].tolist():
                    if label[other] != label[row] and alike(sets[row], sets[other], similarity):
                        label[label == label[other]] = label[row]
                        out.append((node[row], node[other]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = _tile_pairs(rows, ["node", "wide", "sets"], "node", F.ceil(F.greatest(F.count("*") / F.lit(tile), F.sum("shingles") / F.lit(tile_shingles))))
    return dealt.groupBy("band", "key", "i", "j").applyInPandas(confirm, "a long, b long").distinct()


def _tile_pairs(rows: DataFrame, columns: list[str], node: str, tiles: Column) -> DataFrame:
    """Rows of buckets (band, key) that have two rows or more, dealt to pairs (i, j) of so many tiles; own is a row's tile."""
    sizes = written(rows.groupBy("band", "key").agg(tiles.cast("int").alias("tiles"), F.count("*").alias("n")).where("n > 1").drop("n"))
    own = F.pmod(F.xxhash64(node, "band"), F.col("tiles")).cast("int")
    dealt = (
        rows.join(sizes, ["band", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(*columns, "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    )
    # an exchange of their own spreads the tile pairs of one bucket over tasks
    return dealt.repartition("band", "key", "i", "j")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = WORDS_PER_SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash (xxhash64), simhash, component_id (smallest doc_id reachable), root
    (the component's own name: its root node, or a lone text's or fingerprint's; unlike doc_ids never null or shared).

    With a similarity, texts whose five-word shingles are that alike are linked besides. The last join is of two tables as read,
    so that Spark may split the partition of a fingerprint or text that very many rows share.
    """
    prints_of = fingerprints if similarity is None else wide_fingerprints
    base = written(prints_of(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), words_per_shingle).drop("text"))
    prints = base.groupBy("simhash").agg(F.min("doc_id").alias("first_id"), F.count_distinct("text_hash").alias("texts"))
    edges = links(prints.select("simhash"), prints.count(), radius)
    if similarity is None:
        nodes = written(connected_components(edges))
        ids = nodes.join(prints, nodes.node == prints.simhash).select("node", "root", "first_id")
        root_ids = written(ids.groupBy("root").agg(F.min("first_id").alias("component_id")))
        merged = nodes.join(root_ids, "root").select(F.col("node").alias("simhash"), "root", "component_id")
        final = written(prints.join(merged, "simhash", "left").select("simhash", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "simhash").alias("root")))
        return base.join(final, "simhash").select("doc_id", "text_hash", "simhash", "component_id", "root")
    texts = written(base.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.first("simhash").alias("simhash"), F.first("wide").alias("wide"), F.first("shingles").alias("shingles")))
    edges = written(edges)
    linked = edges.select(F.col("a").alias("simhash")).union(edges.select("b")).union(prints.where("texts > 1").select("simhash")).distinct()
    linked = written(linked)
    # texts and fingerprints are nodes of one graph; both are 64-bit hashes
    of_prints = texts.join(linked, "simhash").select(F.col("text_hash").alias("a"), F.col("simhash").alias("b"))
    sources = docs.select(F.xxhash64("text").alias("node"), "text")
    of_texts = wide_links(texts.select(F.col("text_hash").alias("node"), "wide", "shingles"), sources, texts.count(), similarity)
    nodes = written(connected_components(edges.union(of_prints).union(of_texts)))
    rooted = written(nodes.join(texts.select(F.col("text_hash").alias("node"), "first_id"), "node"))
    root_ids = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    merged = rooted.join(root_ids, "root").select(F.col("node").alias("text_hash"), "root", "component_id")
    final = written(texts.join(merged, "text_hash", "left").select("text_hash", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "text_hash").alias("root")))
    return base.join(final, "text_hash").select("doc_id", "text_hash", "simhash", "component_id", "root")


def deduplicated(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = WORDS_PER_SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document with the smallest doc_id (of repeated
    doc_ids the smallest text hash) stays, once."""
    found = near_duplicates(docs, radius, words_per_shingle, similarity)
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("k"))
    keep = written(keep.select(F.col("k.doc_id").alias("kept_id_"), F.col("k.text_hash").alias("kept_hash_"), "k.n"))
    kept = lambda which: docs.join(keep.where(which), F.col("doc_id").eqNullSafe(F.col("kept_id_")) & (F.xxhash64("text") == F.col("kept_hash_")))
    # only rows that stand there more than once are dealt anew to drop repeats
    return kept("n = 1").select(*docs.columns).union(kept("n > 1").dropDuplicates(["kept_id_", "kept_hash_"]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
