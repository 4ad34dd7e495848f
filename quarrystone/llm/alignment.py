"""Cross-tokenizer alignment by byte-owner arrays.

Both vocabularies encode the same bytes: a space and the text. ``np.repeat`` of token numbers over their bytes gives each byte's
owner in A and in B; where the pair of owners changes an overlap begins, and where both change at once both tokens end: a cut.
The tokens between two cuts are a group; every A token of a group is linked with every B token of it. Of two token ids the
count is the number of documents that hold them linked.

Texts are taken apart before single spaces and line feeds, where both vocabularies always begin a new token, so a cut is
there anyway; each distinct part of a slice is encoded and aligned once, and a document's links are its parts' links. Texts with
runs of white space, where that isn't so, are one part. A slice's distinct id pairs are rows of a table: summed by pair,
compared with the A id's highest, joined back to their slices, where the documents' sums are made. No table of pairs is held as a
whole, and none is sent to all tasks.

Defined cases: null and empty texts, and those whose joined tokens differ from space and text (U+2581 in a text reads as a
space), have no tokens, so zeros and '' as groups_sha256; strings of special tokens are plain text; repeated rows count as
documents of their own; an empty table gives an empty result; columns named as an added one are replaced, others pass
through, but for the text.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import read
from quarrystone.llm.terms import looked_up, numbered, sliced
from quarrystone.llm.tokens import _LETTERS, Encoder

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Of two ids the pair is a * PAIR + b.
PAIR = 1 << 20
#: Longer parts go to A's whole pipeline, not to its BPE model as words.
LONGEST = 64
#: White space, and texts that can't be taken apart: those with white space before a space or line feed, or at their ends.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHOLE = rf"^{_WHITE}|{_WHITE}[ \n]| $"
#: Bytes of text of a slice; its distinct words are Python objects, so it is smaller than elsewhere. So many are aligned at a time.
SLICE, STEP = 6 << 20, 20_000


class Parts:
    """What the distinct parts of some texts give, as arrays: numbers by part, the groups as text, and each part's linked pairs and
    how often, one part after another. Parts whose tokens don't join to them are not ``good`` and give nothing."""

    def __init__(self, n: int):
        self.good = np.zeros(n, bool)
        self.n_a, self.n_b, self.n_groups, self.n_links, self.n_pairs = (np.zeros(n, np.int64) for _ in range(5))
        self.pair = self.often = np.zeros(0, np.int64)
        self.groups: list[bytes] = [b""] * n


class Aligner:
    """Encodes and aligns the distinct parts of texts."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.a.added = []
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        letters = set(_LETTERS.values())
        self.bytes_a = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, k in vocabulary.items():
            self.bytes_a[k] = len(piece) if letters.issuperset(piece) else 0
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.pieces_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes_b = np.array([len(p) for p in self.pieces_b], np.int64)

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], int]:
        """The texts' parts in order, as numbers of distinct ones; each one's text; the distinct parts; and how many of these are
        parts proper, that is words without the space before them, or lines' first words with the line feed. The rest are texts
        that can't be taken apart."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        plain = np.flatnonzero(some & ~whole)
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
        local, names = numbered(lists.flatten())
        doc = np.repeat(plain, np.diff(lists.offsets.to_numpy()))
        rest, odd = numbered(texts.take(pa.array(np.flatnonzero(whole))))
        number, doc = np.concatenate([local, rest + len(names)]), np.concatenate([doc, np.flatnonzero(whole)])
        order = np.argsort(doc, kind="stable")
        return number[order], doc[order], names.to_pylist() + odd.to_pylist(), len(names)

    def aligned(self, parts: list[str], proper: int) -> Parts:
        """What the parts give, ``STEP`` of them at a time."""
        steps = [self._aligned(parts[a : a + STEP], min(max(proper - a, 0), STEP)) for a in range(0, len(parts), STEP)]
        out = Parts(0)
        if steps:
            for name in ("good", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "pair", "often"):
                setattr(out, name, np.concatenate([getattr(x, name) for x in steps]))
            out.groups = [g for x in steps for g in x.groups]
        return out

    def _aligned(self, parts: list[str], proper: int) -> Parts:
        out = Parts(len(parts))
        proper = min(proper, len(parts))
        # A's ids; parts proper go to the BPE model as tokens.py does
        enc = self.a
        enc.cuts.clear()
        enc.starts.clear()
        enc._learn({x for x in parts[:proper] if len(x) <= LONGEST and not x[:1].isspace() or x[:1] == "\n" and len(x) <= LONGEST})
        left = [k for k, x in enumerate(parts) if k >= proper or x not in enc.cuts]
        rest = dict(zip(left, enc.ids([x if k < proper and x[:1] == "\n" else " " + x for k, x in ((k, parts[k]) for k in left)])))
        raw = [rest[k] if k in rest else enc.cuts[x] for k, x in enumerate(parts)]
        ids_a, size_a = np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array([len(x) // 4 for x in raw], np.int64)
        # B puts a space before the first piece; before a line feed it is a token of its own, which goes
        ids = self.b.encode(parts, num_threads=1)
        line = [k for k in range(proper) if parts[k][:1] == "\n"]
        for k in line:
            del ids[k][0]
        ids_b, size_b = np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)
        text = [x.encode("utf-8", "surrogatepass") for x in parts]
        lengths = np.array([len(x) + 1 for x in text], np.int64)
        lengths[line] -= 1
        part_a, part_b = np.repeat(np.arange(len(parts)), size_a), np.repeat(np.arange(len(parts)), size_b)
        total = lambda of, ids, part: np.bincount(part, of[ids], len(parts)).astype(np.int64)
        good = (total(self.bytes_a, ids_a, part_a) == lengths) & (total(self.bytes_b, ids_b, part_b) == lengths)
        starts = np.zeros(len(parts), bool)
        starts[line] = True
        said = b"".join(map(self.pieces_b.__getitem__, ids_b[good[part_b]].tolist()))
        if said != b"".join([x if s else b" " + x for x, s, g in zip(text, starts.tolist(), good.tolist()) if g]):
            ends = np.cumsum(size_b)
            for k in np.flatnonzero(good).tolist():
                own = b"".join(map(self.pieces_b.__getitem__, ids_b[ends[k] - size_b[k] : ends[k]].tolist()))
                good[k] = own == (text[k] if starts[k] else b" " + text[k])
        out.good = good
        out.n_a, out.n_b = np.where(good, size_a, 0), np.where(good, size_b, 0)
        keep_a, keep_b = good[part_a], good[part_b]
        group(out, ids_a[keep_a], part_a[keep_a], ids_b[keep_b], self.bytes_a, self.bytes_b)
        return out


def group(out: Parts, ids_a: np.ndarray, part_a: np.ndarray, ids_b: np.ndarray, bytes_a: np.ndarray, bytes_b: np.ndarray) -> None:
    """Groups, links and pairs of parts by byte-owner arrays over all of them end to end; both sides' tokens cover the same bytes."""
    n = len(out.good)
    if not len(ids_a):
        return
    own_a, own_b = np.repeat(np.arange(len(ids_a)), bytes_a[ids_a]), np.repeat(np.arange(len(ids_b)), bytes_b[ids_b])
    # where both owners change at once a group begins; parts begin at such places
    cut = np.flatnonzero((np.diff(own_a, prepend=-1) != 0) & (np.diff(own_b, prepend=-1) != 0))
    first_a, first_b = own_a[cut], own_b[cut]
    size_a, size_b = np.diff(np.append(first_a, len(ids_a))), np.diff(np.append(first_b, len(ids_b)))
    part = part_a[first_a]
    group_a, group_b = np.repeat(np.arange(len(cut)), size_a), np.repeat(np.arange(len(cut)), size_b)
    out.n_groups, out.n_links = np.bincount(part, minlength=n), np.bincount(part, size_a * size_b, n).astype(np.int64)
    # distinct ids of each group and how often, then every pair of them; groups of a part can hold the same pair
    kinds_a, often_a = np.unique(group_a * PAIR + ids_a, return_counts=True)
    kinds_b, often_b = np.unique(group_b * PAIR + ids_b, return_counts=True)
    per_b = np.bincount(kinds_b // PAIR, minlength=len(cut))
    first = np.cumsum(per_b) - per_b
    times = per_b[kinds_a // PAIR]
    left = np.repeat(np.arange(len(kinds_a)), times)
    right = np.repeat(first[kinds_a // PAIR] - np.cumsum(times) + times, times) + np.arange(len(left))
    pair, often, of = (kinds_a % PAIR)[left] * PAIR + (kinds_b % PAIR)[right], often_a[left] * often_b[right], part[kinds_a[left] // PAIR]
    order = np.lexsort((pair, of))
    pair, often, of = pair[order], often[order], of[order]
    start = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    out.pair, out.often, out.n_pairs = pair[start], np.add.reduceat(often, start), np.bincount(of[start], minlength=n)
    # decimal ids, each with the mark behind it: A's of a group, then B's
    at_a, at_b = np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a], np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]
    flat, mark, of = (np.empty(len(ids_a) + len(ids_b), np.int64) for _ in range(3))
    last = lambda x: np.diff(x, append=-1) != 0
    flat[at_a], flat[at_b] = ids_a, ids_b
    mark[at_a], mark[at_b] = np.where(last(group_a), ord("|"), ord(",")), np.where(last(group_b), ord(";"), ord(","))
    of[at_a], of[at_b] = part_a, part[group_b]
    shown = np.zeros((len(flat), 8), np.uint8)
    width = np.ones(len(flat), np.int64) + sum((flat >= 10**k).astype(np.int64) for k in range(1, 7))
    for k in range(7):
        # the k-th digit from the left
        shift = np.maximum(width - 1 - k, 0)
        shown[:, k] = flat // 10**shift % 10 + ord("0")
    shown[np.arange(len(flat)), width] = mark
    said = shown[np.arange(8) <= width[:, None]].tobytes()
    ends = np.cumsum(np.bincount(of, width + 1, n).astype(np.int64)).tolist()
    out.groups = [said[i:j] for i, j in zip([0, *ends], ends)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner of two vocabulary files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_SLICE = T.StructType([*(T.StructField(x, T.LongType()) for x in _NUMBERS), T.StructField("groups_sha256", T.StringType()), T.StructField("parts_", T.BinaryType())])
_ADDED = T.StructType([*(T.StructField(x, T.LongType()) for x in (*_NUMBERS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])


def _planes(x: np.ndarray) -> bytes:
    """Small numbers byte by byte, so that files and shuffles store the high bytes, nearly all zero, in little space."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _kernel(path_a: str, path_b: str):
    """Of a slice: its documents' columns, its distinct pairs with the number of its documents that hold them (pair * 2**24 + n, as a
    term), and its parts' pairs as bytes."""

    def run(texts: pa.Array) -> tuple[dict[str, object], pa.Array, bytes]:
        sides = aligner(path_a, path_b)
        number, doc, names, proper = sides.parts(texts)
        parts = sides.aligned(names, proper)
        n = len(texts)
        # texts with a part that isn't good have no tokens at all
        fine = np.bincount(doc, ~parts.good[number], n) == 0
        number, doc = number[fine[doc]], doc[fine[doc]]
        sums = {x: np.bincount(doc, getattr(parts, x)[number], n).astype(np.int64) for x in _NUMBERS}
        ends = np.cumsum(np.bincount(doc, minlength=n)).tolist()
        said = list(map(parts.groups.__getitem__, number.tolist()))
        hashes = [hashlib.sha256(b"".join(said[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends)]
        # the more frequent parts get the smaller numbers
        order = np.argsort(-np.bincount(number, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        ranked = rank[number]
        columns = {**{x: pa.array(v) for x, v in sums.items()}, "groups_sha256": pa.array(hashes, pa.string()), "parts_": [_planes(ranked[i:j]) for i, j in zip([0, *ends], ends)]}
        kinds, kind = np.unique(parts.pair, return_inverse=True)
        first = np.cumsum(parts.n_pairs) - parts.n_pairs
        of = lambda own: np.repeat(first[own] - np.cumsum(parts.n_pairs[own]) + parts.n_pairs[own], parts.n_pairs[own]) + np.arange(int(parts.n_pairs[own].sum()))
        holders = np.zeros(len(kinds), np.int64)
        # of each document its distinct parts, and of these the distinct pairs, some documents at a time
        once = np.unique(doc * max(1, len(names)) + number)
        doc_of, own = np.divmod(once, max(1, len(names)))
        for a in range(0, len(own), 100_000):
            # a step ends where a document does
            i, j = (np.searchsorted(doc_of, doc_of[k], "left") if k < len(own) else len(own) for k in (a, a + 100_000))
            at = of(own[i:j])
            held = np.unique(np.repeat(doc_of[i:j], parts.n_pairs[own[i:j]]) * max(1, len(kinds)) + kind[at])
            holders += np.bincount(held % max(1, len(kinds)), minlength=len(kinds))
        payload = np.array([len(names), len(parts.pair)], "<u4").tobytes() + _planes(parts.n_pairs[order]) + _planes(kind[of(order)]) + parts.often[of(order)].astype("<i8").tobytes()
        terms = pa.StructArray.from_arrays([pa.array(kinds // PAIR, pa.int32()), pa.array(kinds % PAIR, pa.int32()), pa.array(holders)], names=["a", "b", "n"])
        return columns, terms, payload

    return run


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    (payload,) = [x for x in left.column("bytes_").to_pylist() if x is not None]
    docs = left.filter(pc.is_null(left.column("bytes_")))
    n_parts, n_pairs = np.frombuffer(payload[:8], "<u4").tolist()
    size, number = _numbers(payload[8 : 8 + 4 * n_parts]), _numbers(payload[8 + 4 * n_parts : 8 + 4 * (n_parts + n_pairs)])
    times = np.frombuffer(payload[8 + 4 * (n_parts + n_pairs) :], "<i8")
    count, best = np.zeros(len(right), np.int64), np.zeros(len(right), bool)
    at = right.column("at_").to_numpy()
    count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
    part = np.repeat(np.arange(n_parts), size)
    sums, bests = np.zeros(n_parts, np.int64), np.zeros(n_parts, np.int64)
    np.add.at(sums, part, count[number] * times)
    np.add.at(bests, part, best[number] * times)
    numbers = [_numbers(x) for x in docs.column("parts_").to_pylist()]
    return pa.table({**{n: docs.column(n) for n in (*_NUMBERS, "groups_sha256")}, "n_best": pa.array([int(bests[x].sum()) for x in numbers], pa.int64()), "count_sum": pa.array([int(sums[x].sum()) for x in numbers], pa.int64())})


def links(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """The written table of documents, slices and their pairs; and the pairs: a, b, count (documents), best (no pair of a has more)."""
    term = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])
    table = sliced(docs, _kernel(path_a, path_b), _SLICE, term, SLICE)
    pairs = table.where("term_ is not null").groupBy("term_.a", "term_.b").agg(F.sum("term_.n").alias("count"))
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    return table, pairs.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` without the text, with the numbers of tokens, groups and links, links that are their A id's best, the links'
    counts as a sum, and the groups' hash."""
    table, pairs = links(docs, path_a, path_b)
    slim = table.withColumn("term_", F.when(F.col("term_").isNotNull(), F.struct("term_.a", "term_.b")))
    added = {f.name for f in _ADDED} | {"parts_"}
    own = [c for c in docs.columns if c.lower() not in added and c != "text"]
    return looked_up(slim, pairs.select(F.struct("a", "b").alias("term_"), "count", "best"), _finish, _ADDED, own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
