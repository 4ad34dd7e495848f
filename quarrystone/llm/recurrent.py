"""Language-model scoring by a gated recurrent network with a class-factored output, in numpy.

Tokens are words (A-Z as a-z) and one end per document. Their counts over all training documents give the base score, an
add-0.1 unigram. The network knows the ``WORDS_KEPT`` most frequent tokens by themselves, dealt to classes of about equal
root-frequency mass; all others are one more class, in which a token has its add-0.1 share of that class's counts. So

    P(token | state) = P(class | state) * P(token | class, state)

is a distribution in the same sense as the base score's: all tokens that training never saw share one place. The output
starts as the unigram and the network learns from there.

Training reads every training document once a pass, in rounds that double in size. In a round each task goes on from the same
weights over its own documents, by truncated backpropagation: the state runs through whole documents, window by window, and every
window gives a gradient. The tasks' weights are then averaged, in tasks; the driver holds few of them. Tasks
are as many as the training tokens ask for; long documents stand side by side in tasks of their own. Scoring carries the state over windows too, so a text's score is that of the
whole text, however long.

Counts beyond the kept words are never held as a whole: slices of documents list their distinct rare words, which are joined
with the counts. Weights depend on how the rows of the table are dealt to tasks, base columns on nothing but the rows.

Defined cases: null and empty texts are the end alone; without training documents every score is 0; repeated rows count and
are scored one by one; rows without doc_id are held out; an empty table gives an empty result; columns named as an added
one are replaced, others pass through, but for the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import read, small_batches, written
from quarrystone.llm.terms import WORDS, gathered, looked_up, numbered, sliced, text_of, tokens

WORDS_KEPT, CLASSES, HIDDEN = 4096, 48, 16
SMOOTH = 0.1
#: The end of a document among the words; no word holds a line feed.
END = "\n"
#: Documents of a batch, least steps of a window (more where few documents are that long), step size.
BATCH, STEPS, RATE = 256, 16, 0.2
#: A task trains on about so many tokens; small corpora are passed over until about so many were read.
TASK_TOKENS, LEAST_TOKENS, MOST_PASSES = 2_000_000, 8_000_000, 6
#: Texts of so many bytes and more are dealt to tasks of their own, about a batch to each, as a step costs as much for few as for many.
LONG = 1 << 14
#: Rounds by the eighths of documents that train in them.
ROUNDS = ((0,), (1,), (2, 3), (4, 5, 6, 7))
#: Tokens whose outputs are held at a time, and those whose classes are.
WINDOW, PART = 1 << 15, 1 << 9
START = 1e-4


def _order(ids: np.ndarray, most: int) -> np.ndarray:
    """A stable order of numbers up to ``most``; numbers of 16 bits are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if most < 1 << 16 else ids, kind="stable")


def _exp(x: np.ndarray, wide: bool) -> np.ndarray:
    """Exponentials in the place of x; of a wide softmax, less each column's largest."""
    if wide:
        x -= x.max(axis=0)
    return np.exp(x, out=x)


def _above(x: np.ndarray, place: np.ndarray, share: np.float32, wide: bool) -> np.ndarray:
    """Each column's softmax, less one at its goal (``place`` in the whole of x), times ``share``; in the place of x."""
    x = _exp(x, wide)
    mass = np.dot(np.ones(len(x), np.float32), x)
    x.reshape(-1)[place] -= mass
    x *= share / mass
    return x


def _log_mass(x: np.ndarray, wide: bool) -> np.ndarray:
    """The logarithm of each column's sum of exponentials."""
    top = x.max(axis=0) if wide else 0
    return np.log(np.ones(len(x), np.float32) @ _exp(x, wide)) + top


def _runs(sizes: list[int]) -> list[tuple[slice, int, int]]:
    """Steps of as many texts that follow each other: their tokens, how many steps, how many texts."""
    out, at = [], 0
    for a, same in groupby(sizes):
        m = sum(1 for _ in same)
        out.append((slice(at, at + a * m), m, a))
        at += a * m
    return out


class Model:
    """Words by falling count, their classes, and the weights as arrays of one vector."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int, hidden: int = HIDDEN, classes: int = CLASSES):
        k = len(words)
        self.words, self.total, self.distinct, self.hidden = words, total, distinct, hidden
        self.end = words.index(END) if END in words else k
        self.base = np.log10((np.append(counts, 0).astype(float) + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        # the rare class: its tokens' counts, one more place for unseen ones
        self.rare_total = total - sum(counts) + SMOOTH * (distinct - k + 1)
        mass = np.sqrt(np.asarray(counts, float))
        bins = np.minimum((np.cumsum(mass) - mass) * classes / max(mass.sum(), 1e-9), classes - 1).astype(np.int64)
        self.first = np.append(np.flatnonzero(np.diff(bins, prepend=-1)), k)
        n = len(self.first) - 1
        self.kind = np.append(np.repeat(np.arange(n), np.diff(self.first)), n)
        shapes = {"emb": (k + 1, hidden), "inp": (hidden, 3 * hidden), "rec": (hidden, 3 * hidden), "gate": (3 * hidden,), "cls": (n + 1, hidden), "cls_bias": (n + 1,), "out": (k, hidden), "out_bias": (k,)}
        #: sums of squared gradients: by row of the large arrays, by element of the others
        sums = {f"{x}_sum": (s[0],) if x in ("emb", "out") else s for x, s in shapes.items()}
        self.shapes = shapes | sums
        self.state = np.zeros(sum(map(math.prod, self.shapes.values())), np.float32)
        self.bind()
        rng = np.random.default_rng(13)
        for name in ("emb", "inp", "rec"):
            self.__dict__[name][:] = rng.normal(0, 0.3 if name == "emb" else hidden**-0.5, shapes[name])
        for name in sums:
            self.__dict__[name][:] = START
        freq = np.append(counts, self.rare_total).astype(float)
        by_class = np.bincount(self.kind, freq, n + 1)
        self.cls_bias[:] = np.log(by_class / by_class.sum())
        self.out_bias[:] = np.log(freq[:k] / by_class[self.kind[:k]])

    def bind(self) -> None:
        """The arrays as views of the vector."""
        at = 0
        for name, shape in self.shapes.items():
            self.__dict__[name] = self.state[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self.shapes}

    def __setstate__(self, given: dict) -> None:
        self.__dict__.update(given)
        self.state = self.state.copy()
        self.bind()

    def ids(self, texts: pa.Array, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, pa.Array | None]:
        """Of a list of texts: all tokens' numbers (the kept words' count for any other), each text's first token and number of
        tokens; with ``places`` each token's number among the distinct words (-1: end), and these."""
        found, doc = tokens(texts, WORDS)
        local, names = numbered(found) if places else (None, found)
        known = pc.fill_null(pc.index_in(names, value_set=pa.array(self.words, pa.string())), len(self.words)).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.bincount(doc, minlength=len(texts)).astype(np.int64) + 1
        start = np.cumsum(n) - n
        ids, at = np.full(int(n.sum()), self.end, np.int64), np.arange(len(doc)) + doc
        if not places:
            ids[at] = known
            return ids, start, n, None, None
        ids[at], place = known[local], np.full(len(ids), -1, np.int64)
        place[at] = local
        return ids, start, n, place, names

    def _steps(self, zr: np.ndarray, c: np.ndarray, sizes: list[int], h: np.ndarray, kept: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """States after each step, behind a column of ones; ``zr`` and ``c`` hold the inputs' part of the gates, step by step, and
        are used up: the gates take its place. h goes on in place. ``kept`` gets the states before and their part of c's sum."""
        k, out = self.hidden, np.ones((len(c), self.hidden + 1), np.float32)
        # 1 / (1 + exp(-x)): the first two gates' sums are taken with a minus
        rec, rec_c = -self.rec[:, : 2 * k], self.rec[:, 2 * k :].copy()
        np.negative(zr, out=zr)
        one = np.ones(1, np.float32)
        for own, m, a in _runs(sizes):
            state = h[:a]
            before, parts = (v[own].reshape(m, a, k) for v in kept) if kept else ([None] * m,) * 2
            for g, new, to, old, part in zip(zr[own].reshape(m, a, 2 * k), c[own].reshape(m, a, k), out[own].reshape(m, a, k + 1)[:, :, 1:], before, parts):
                if old is not None:
                    old[:] = state
                u = np.dot(state, rec)
                u += g
                np.exp(u, out=u)
                np.add(u, one, out=u)
                np.reciprocal(u, out=g)
                new += np.dot(state, rec_c, out=part) * g[:, k:]
                np.tanh(new, out=new)
                state -= new
                state *= g[:, :k]
                state += new
                to[:] = state
        return out

    @staticmethod
    def _windows(start: np.ndarray, n: np.ndarray, least: int, most: int, want: int) -> Iterator[tuple[np.ndarray, list[int], int]]:
        """Windows over texts sorted by falling length, of ``least`` to ``most`` steps and about ``want`` tokens: the tokens'
        places step by step, how many texts are in each step, the first step."""
        in_step = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
        ends, t0 = np.append(0, np.cumsum(in_step)), 0
        while t0 < len(in_step):
            t1 = min(max(int(np.searchsorted(ends, ends[t0] + want)), t0 + least), t0 + most, len(in_step))
            sizes = in_step[t0:t1].tolist()
            yield np.concatenate([start[:a] + t for t, a in enumerate(sizes, t0)]), sizes, t0
            t0 = t1

    def log10(self, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each text the log10 probability of its tokens, but for the shares of rare ones in their class."""
        order = np.argsort(-n, kind="stable")
        start, n = start[order], n[order]
        fed = self.emb @ self.inp + self.gate
        zr, c = fed[:, : 2 * self.hidden].copy(), fed[:, 2 * self.hidden :].copy()
        total, h = np.zeros(len(n)), np.zeros((len(n), self.hidden), np.float32)
        k, kinds, words, wide = len(self.words), *self._outputs()
        with np.errstate(over="ignore"):
            for at, sizes, t0 in self._windows(start, n, 1, 1 << 12, WINDOW):
                prev = ids.take(at - 1, mode="clip")
                if not t0:
                    prev[: sizes[0]] = self.end
                states = self._steps(zr.take(prev, axis=0), c.take(prev, axis=0), sizes, h)
                # words of a class stand side by side, classes too
                goal = ids.take(at)
                by = _order(goal, k)
                goal, states = goal.take(by), states.take(by, axis=0)
                kind = self.kind.take(goal)
                cut = np.searchsorted(goal, self.first).tolist()
                rows = kinds.take(kind, axis=0)
                # the classes' and the words' part of the goal's logarithm at once
                rows[: cut[-1]] += words.take(goal[: cut[-1]], axis=0)
                logs = np.einsum("ij,ij->i", states, rows).astype(float)
                states = states.T.copy()
                for a in range(0, len(goal), PART):
                    logs[a : a + PART] -= _log_mass(np.dot(kinds, states[:, a : a + PART]), wide[-1])
                for a, b, s, e, far in zip(self.first.tolist(), self.first[1:].tolist(), cut, cut[1:], wide):
                    for s in range(s, e, PART):
                        logs[s : min(e, s + PART)] -= _log_mass(np.dot(words[a:b], states[:, s : min(e, s + PART)]), far)
                total += np.bincount(np.concatenate([np.arange(a) for a in sizes])[by], logs, len(n))
        out = np.empty(len(n))
        out[order] = total / math.log(10)
        return out if k else np.zeros(len(n))

    def _outputs(self) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Of classes and of words the bias before the weights; whether a softmax (of each class's words, then of the classes) may
        reach what exponentials of 32 bits don't hold. No state is beyond 1."""
        found, wide = [], []
        for value, bias, first in ((self.out, self.out_bias, self.first[:-1]), (self.cls, self.cls_bias, np.zeros(1, np.int64))):
            both = np.empty((len(value), self.hidden + 1), np.float32)
            both[:, 0], both[:, 1:] = bias, value
            found.append(both)
            if len(value):
                wide += (np.maximum.reduceat(np.abs(both) @ np.ones(self.hidden + 1, np.float32), first) > 80).tolist()
        return found[1], found[0], wide

    def _move(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        value, sums = self.__dict__[name], self.__dict__[f"{name}_sum"]
        if rows is None and sums.ndim == value.ndim:
            sums += grad * grad
            value -= RATE * grad / np.sqrt(sums)
            return
        more = np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        if rows is None:
            sums += more
            value -= grad * (RATE / np.sqrt(sums))[:, None]
        else:
            more += sums.take(rows)
            sums[rows] = more
            value[rows] = value.take(rows, axis=0) - grad * (RATE / np.sqrt(more))[:, None]

    def _learn(self, prev: np.ndarray, goal: np.ndarray, sizes: list[int], h: np.ndarray) -> None:
        """One window forward and back; every array moves against its gradient."""
        k, n = self.hidden, len(goal)
        x = self.emb.take(prev, axis=0)
        zr, c = np.dot(x, self.inp[:, : 2 * k]), np.dot(x, self.inp[:, 2 * k :])
        zr += self.gate[: 2 * k]
        c += self.gate[2 * k :]
        before, uc = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
        states = self._steps(zr, c, sizes, h, (before, uc))
        z, r = zr[:, :k].copy(), zr[:, k:]
        # words of a class stand side by side, classes too
        by = _order(goal, len(self.words))
        goal, states = goal.take(by), states.take(by, axis=0)
        kind, share = self.kind.take(goal), np.float32(1 / n)
        kinds, words, wide = self._outputs()
        first, cut = self.first.tolist(), np.searchsorted(goal, self.first).tolist()
        turned, d_cls, d_out = states.T.copy(), np.zeros_like(kinds), np.zeros_like(words)
        ds, own = np.empty((n, k), np.float32), np.zeros((n, k), np.float32)
        for s in range(0, n, PART):
            t = min(s + PART, n)
            e = _above(np.dot(kinds, turned[:, s:t]), kind[s:t] * (t - s) + np.arange(t - s), share, wide[-1])
            np.dot(e.T, self.cls, out=ds[s:t])
            d_cls += np.dot(e, states[s:t])
        # a class of one word takes no part
        place = (goal - self.first.take(kind)) * np.diff(cut, append=n).take(kind) + np.arange(n) - np.array(cut).take(kind)
        for a, b, s, t, far in zip(first, first[1:], cut, cut[1:], wide):
            if t > s and b - a > 1:
                e = _above(np.dot(words[a:b], turned[:, s:t]), place[s:t], share, far)
                np.dot(e.T, self.out[a:b], out=own[s:t])
                np.dot(e, states[s:t], out=d_out[a:b])
        ds += own
        own[by] = ds
        ds = own
        self._move("cls", d_cls[:, 1:])
        self._move("cls_bias", d_cls[:, 0])
        self._move("out", d_out[:, 1:])
        self._move("out_bias", d_out[:, 0])
        # what the chain through time doesn't change: the slopes of the gates' sums
        rest = 1 - z
        of_c = rest * (1 - c * c)
        slopes, du, back, rec = np.empty((n, 3, k), np.float32), np.empty((n, 3, k), np.float32), np.zeros_like(h), self.rec.T.copy()
        np.multiply((before - c) * z, rest, out=slopes[:, 0])
        np.multiply(of_c * uc, r * (1 - r), out=slopes[:, 1])
        np.multiply(of_c, r, out=slopes[:, 2])
        for run, m, a in reversed(_runs(sizes)):
            b = back[:a]
            views = ds[run].reshape(m, a, k), z[run].reshape(m, a, k), slopes[run].reshape(m, a, 3, k), du[run].reshape(m, a, 3, k), du[run].reshape(m, a, 3 * k), ds[run].reshape(m, a, 1, k)
            for dh, keep, slope, g, flat, wide in zip(*(v[::-1] for v in views)):
                dh += b
                np.multiply(wide, slope, out=g)
                np.multiply(dh, keep, out=b)
                b += np.dot(flat, rec)
        du = du.reshape(n, 3 * k)
        self._move("rec", np.dot(before.T, du))
        np.multiply(ds, of_c, out=du[:, 2 * k :])
        dx = np.dot(du, self.inp.T)
        self._move("inp", np.dot(x.T, du))
        self._move("gate", np.dot(np.ones(n, np.float32), du))
        by = _order(prev, len(self.words))
        prev = prev.take(by)
        ones = np.flatnonzero(np.diff(prev, prepend=-1))
        self._move("emb", np.add.reduceat(dx.take(by, axis=0), ones), prev.take(ones))

    def train(self, texts: pa.Array, passes: int = 1) -> int:
        """Truncated backpropagation over whole texts; the number of tokens."""
        ids, start, n, _, _ = self.ids(texts, False)
        order = np.argsort(-n, kind="stable")
        with np.errstate(over="ignore"):
            for _ in range(passes if self.words else 0):
                for a in range(0, len(order), BATCH):
                    part = order[a : a + BATCH]
                    h = np.zeros((len(part), self.hidden), np.float32)
                    for at, sizes, t0 in self._windows(start[part], n[part], STEPS, 8 * STEPS, BATCH * STEPS // 2):
                        prev = ids.take(at - 1, mode="clip")
                        if not t0:
                            prev[: sizes[0]] = self.end
                        self._learn(prev, ids.take(at), sizes, h)
        return len(ids)


def held_out() -> F.Column:
    """crc32 of the identifier as text, modulo 10, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def counted(docs: DataFrame) -> DataFrame:
    """term_, c: how often each token stands in the texts, END once a text; counted slice by slice, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            local, names = numbered(tokens(text_of(table), WORDS)[0])
            n = np.append(np.bincount(local, minlength=len(names)), table.num_rows)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.cast(pa.string()), pa.array([END])]), pa.array(n, pa.int64())], names=["term_", "c"])
        pa.default_memory_pool().release_unused()

    return small_batches(docs).select("text").mapInArrow(run, "term_ string, c long").groupBy("term_").agg(F.sum("c").alias("c"))


def _averaged(rows: DataFrame, size: int) -> np.ndarray | None:
    """The mean of weight vectors, weighted by tokens: summed in tasks, so the driver sees at most 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            for state, weight in zip(batch.column("state").to_pylist(), batch.column("n").to_pylist()):
                total += np.frombuffer(state, np.float32) * float(weight)
                n += weight
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()]), pa.array([n], pa.int64())], names=["state", "n"])

    got = written(rows).coalesce(32).mapInArrow(run, "state binary, n long").collect()
    n = sum(r["n"] for r in got)
    return sum(np.frombuffer(r["state"], np.float32) * (r["n"] / n) for r in got).astype(np.float32) if n else None


def _long() -> F.Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) >= LONG


def _eighth() -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(8))


def _dealt(docs: DataFrame, long: int, tasks: int | None = None) -> DataFrame:
    """All rows: the ``long`` long ones by the batch, the others where they stand, in ``tasks`` tasks at most."""
    short = docs.where(~_long())
    short = short.coalesce(tasks) if tasks else short
    return short.union(docs.where(_long()).repartition(-(-long // BATCH))) if long else short


def fitted(train: DataFrame, counts: DataFrame, kept: int = WORDS_KEPT, hidden: int = HIDDEN) -> Model:
    """A model of the training documents (doc_id, text) and their counts."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.where(F.col("term_") != END).orderBy(F.desc("c"), "term_").limit(kept - 1).collect()
    top += counts.where(F.col("term_") == END).collect()
    top.sort(key=lambda r: (-r["c"], r["term_"]))
    model = Model([r["term_"] for r in top], [r["c"] for r in top], sums["n"], sums["v"], hidden)
    if not top:
        return model
    passes = max(1, min(MOST_PASSES, LEAST_TOKENS // sums["n"]))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, sums["n"] // TASK_TOKENS)
    long = {r["eighth"]: r["n"] for r in train.where(_long()).groupBy(_eighth().alias("eighth")).agg(F.count("*").alias("n")).collect()}
    for eighths in ROUNDS:
        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            n = sum(model.train(text_of(table), passes) for table in gathered(batches))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([model.state.tobytes()]), pa.array([n], pa.int64())], names=["state", "n"])
            pa.default_memory_pool().release_unused()

        own = small_batches(train).where(_eighth().isin(*eighths)).select("text")
        part = _dealt(own, sum(long.get(x, 0) for x in eighths), tasks)
        state = _averaged(part.mapInArrow(run, "state binary, n long"), len(model.state))
        if state is not None:
            model.state[:] = state
    return model


_SLICE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare_", T.ArrayType(T.IntegerType()))])
_ADDED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def scored(docs: DataFrame, train: DataFrame, kept: int = WORDS_KEPT, hidden: int = HIDDEN) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score (log10); ``train``: doc_id, text."""
    counts = written(counted(train))
    model = fitted(train, counts, kept, hidden)
    k, unseen = len(model.words), model.total + SMOOTH * (model.distinct + 1)

    def kernel(texts: pa.Array) -> tuple[dict[str, object], pa.Array, None]:
        ids, start, n, place, names = model.ids(texts)
        doc = np.repeat(np.arange(len(n)), n)
        rare = (ids == k) & (place >= 0)
        kinds, number = np.unique(place[rare], return_inverse=True)
        ends = np.append(0, np.cumsum(np.bincount(doc[rare], minlength=len(n)))).astype(np.int32)
        known = np.bincount(doc, ids < k, len(n)).astype(np.int64)
        base = np.where((ids < k) | (place < 0), model.base[ids], 0.0)
        columns = {
            "n_tokens": pa.array(n), "n_known": pa.array(known), "base_score": pa.array(np.bincount(doc, base, len(n))),
            "score": pa.array(model.log10(ids, start, n)), "rare_": pa.ListArray.from_arrays(pa.array(ends), pa.array(number.astype(np.int32))),
        }
        return columns, names.take(pa.array(kinds)), None

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rare = left.column("rare_").combine_chunks()
        at = rare.flatten().to_numpy()
        doc = np.repeat(np.arange(len(left)), pc.list_value_length(rare).to_numpy(zero_copy_only=False).astype(np.int64))
        c = np.zeros(int(at.max(initial=-1)) + 1)
        c[right.column("at_").to_numpy()] = right.column("c").to_numpy()
        logs = np.log10(c + SMOOTH)[at]
        n = len(left)
        more = lambda name, of: left.column(name).to_numpy() + np.bincount(doc, logs - math.log10(of), n)
        return pa.table({
            "n_tokens": left.column("n_tokens"), "n_known": left.column("n_known").to_numpy() + np.bincount(doc, c[at] > 0, n).astype(np.int64),
            "train_tokens": np.full(n, model.total), "base_score": more("base_score", unseen), "score": more("score", model.rare_total),
        })

    added = {f.name for f in _ADDED} | {"rare_"}
    own = [c for c in docs.columns if c.lower() not in added and c != "text"]
    table = sliced(_dealt(docs, docs.where(_long()).count()), kernel, _SLICE, T.StringType())
    return looked_up(table, counts, finish, _ADDED, own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
