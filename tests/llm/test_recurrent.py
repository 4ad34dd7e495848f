import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarrystone.llm import recurrent
from quarrystone.llm.recurrent import END, Model


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", folded) if w] + [END]


def small(counts, kept, hidden=5, classes=3):
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:kept]
    return Model([w for w, _ in top], [c for _, c in top], sum(counts.values()), len(counts), hidden, classes)


TEXTS = ["the cat sat on the mat", "The CAT ate the rat\non the mat", "", None, "a\x0bb\x0cc d É é", " lead and trail ", "cat " * 300, "rare words only unseen", "the"]


def stepwise(model, text):
    """One token after another in 64 bits, with every probability written out."""
    p = {k: getattr(model, k).astype(float) for k in ("emb", "inp", "rec", "gate", "cls", "cls_bias", "out", "out_bias")}
    k, h, before, total = model.hidden, np.zeros(model.hidden), model.end, 0.0
    number = {w: i for i, w in enumerate(model.words)}
    mass = []
    for w in words(text):
        g, u = p["emb"][before] @ p["inp"] + p["gate"], h @ p["rec"]
        z, r = 1 / (1 + np.exp(-(g[:k] + u[:k]))), 1 / (1 + np.exp(-(g[k : 2 * k] + u[k : 2 * k])))
        h = (1 - z) * np.tanh(g[2 * k :] + r * u[2 * k :]) + z * h
        soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        by_class = soft(p["cls"] @ h + p["cls_bias"])
        own = np.concatenate([by_class[c] * soft(p["out"][a:b] @ h + p["out_bias"][a:b]) for c, (a, b) in enumerate(zip(model.first, model.first[1:]))])
        mass.append(own.sum() + by_class[-1])
        i = number.get(w, len(model.words))
        total += math.log10(own[i] if i < len(own) else by_class[-1])
        before = i
    assert np.allclose(mass, 1)
    return total


def test_scores_equal_a_stepwise_network_whatever_the_windows(monkeypatch):
    counts = Counter(w for t in TEXTS for w in words(t))
    model = small(counts, 8)
    model.train(pa.array(TEXTS), 3)
    want = [stepwise(model, t) for t in TEXTS]
    for window in (1, 7, 1 << 15):
        monkeypatch.setattr(recurrent, "WINDOW", window)
        ids, start, n, _, _ = model.ids(pa.array(TEXTS))
        assert np.allclose(model.log10(ids, start, n), want, rtol=1e-4, atol=1e-4)
    assert n.tolist() == [len(words(t)) for t in TEXTS]


def test_gradients_equal_differences():
    counts = Counter(w for t in TEXTS for w in words(t))
    model = small(counts, 9, 4)
    rng = np.random.default_rng(1)
    for name in ("emb", "inp", "rec", "cls", "out"):
        getattr(model, name)[:] = rng.normal(0, 0.5, model.shapes[name])
    ids, start, n, _, _ = model.ids(pa.array(TEXTS[:2]))
    order = np.argsort(-n, kind="stable")
    ((at, sizes, _),) = model._windows(start[order], n[order], 99, 99, 99)
    first = np.concatenate([np.full(sizes[0], 1), np.zeros(len(at) - sizes[0], int)]) == 1
    prev, goal = np.where(first, model.end, ids[np.maximum(at - 1, 0)]), ids[at]
    taken = {}
    model._move = lambda name, grad, rows=slice(None): taken.setdefault(name, np.zeros(model.shapes[name])).__setitem__(rows, grad)
    model._learn(prev, goal, sizes, np.zeros((2, 4), np.float32))
    loss = lambda: -model.log10(ids, start, n).sum() * math.log(10) / len(goal)
    for name, grad in taken.items():
        value = getattr(model, name)
        for place in rng.integers(0, value.size, 12):
            cell = np.unravel_index(place, value.shape)
            keep = value[cell]
            value[cell] = keep + 0.01
            up = loss()
            value[cell] = keep - 0.01
            down = loss()
            value[cell] = keep
            assert abs((up - down) / 0.02 - grad[cell]) < 2e-3, (name, cell)


def test_base_columns_equal_brute_force_and_clashing_names(spark, monkeypatch):
    rows = [(k, t, float(k)) for k, t in enumerate(TEXTS * 3)] + [(None, "the null", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4, "doc_id")
    train = [t for k, t, _ in rows if zlib.crc32(("" if k is None else str(k)).encode()) % 10]
    c = Counter(w for t in train for w in words(t))
    total, v = sum(c.values()), len(c)
    for kept in (4, 4096):
        got = {r["doc_id"]: r for r in recurrent.scored(docs, docs.where(~recurrent.held_out()), kept, 6).collect()}
        assert len(got) == len(TEXTS) * 3 + 1
        for k, t, _ in rows:
            r, own = got[k], words(t)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), total)
            assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in own)) < 1e-9 * len(own) + 1e-9
            assert r["score"] < 0
    monkeypatch.setattr(recurrent, "ROUNDS", ())
    # untrained, the network gives about the unigram
    plain = recurrent.scored(docs, docs.where(~recurrent.held_out()), 4, 6).where("doc_id = 0").first()
    assert abs(plain["score"] - plain["base_score"]) < 0.35 * abs(plain["base_score"])


def test_without_rows_or_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert recurrent.scored(none, none).collect() == []
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in recurrent.scored(docs, none).collect()) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_learns_more_than_frequencies(spark):
    """Held-out documents of the whole small table get more probability from the network than from the unigram."""
    got = recurrent.query(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.04


def test_long_texts_of_all_tasks_stand_side_by_side(spark):
    """A step costs as much for one text as for a batch: each task had its own long text alone in its last windows."""
    rows = [(k, None if k == 3 else "long " * 4000 if k % 10 == 0 else "a short one") for k in range(80)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    long = docs.where(recurrent._long()).count()
    assert long == 16
    for tasks in (None, 4):
        got = recurrent._dealt(docs, long, tasks).select("doc_id", F.octet_length("text").alias("n"), F.spark_partition_id().alias("task")).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(k for k, _ in rows)
        assert len({r["task"] for r in got if (r["n"] or 0) >= recurrent.LONG}) == 1
    assert recurrent._dealt(docs.where("doc_id % 10 > 0"), 0).count() == 144


def test_weights_that_exponentials_do_not_hold():
    counts = Counter(w for t in TEXTS for w in words(t))
    model = small(counts, 8)
    model.out[:] *= 0
    model.out_bias[:] = np.linspace(-300, 300, len(model.out_bias))
    model.cls_bias[:] = np.linspace(200, -200, len(model.cls_bias))
    assert any(model._outputs()[2])
    ids, start, n, _, _ = model.ids(pa.array(TEXTS[:2]))
    got = model.log10(ids, start, n)
    assert np.isfinite(got).all() and (got < 0).all()
    model.train(pa.array(TEXTS), 2)
    assert np.isfinite(model.state).all()


def test_tokens_for_training_equal_those_for_scores():
    model = small(Counter(w for t in TEXTS for w in words(t)), 8)
    for a, b in zip(model.ids(pa.array(TEXTS), False)[:3], model.ids(pa.array(TEXTS))[:3]):
        assert a.tolist() == b.tolist()
