import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from quarrystone.llm import divergence


def brute(rows):
    docs = [((la or ""), (so or ""), [w.translate(FOLD) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for t, la, so in rows]
    out = []
    for lang in sorted({d[0] for d in docs}):
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in held.items() if n >= 3}
        by = defaultdict(Counter)
        for _, s, ws in own:
            by[s].update(w for w in ws if w in kept)
        v = len(kept)
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v) for w in kept} for s, c in ((s, by[s]) for s in {d[1] for d in own})}
        whole = sum(by.values(), Counter())
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + v) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            found = {"pair": [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s], "term": [(f(p[s][w], q[w]), w) for w in kept if by[s][w] and p[s][w] > q[w]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < 200]
    return sorted(out)


FOLD = {c: c + 32 for c in range(65, 91)}
ROWS = [
    ("Ab ab cd", "en", "x"), ("ab ÉÈ cd1ef", "en", "y"), ("ab cd éè", "en", "z"), ("AB", "en", None), (None, "en", "w"), ("", "en", "w"), ("ab ab", None, "x"), ("one two", "de", "x"),
    ("one two", "de", "x"), ("one TWO three", "de", "y"), ("Ab ab cd", "en", "x"), ("ab cd " * 500, "en", "x"), ("日本 ab 日本", "en", "z"), ("日本 x", "en", "y"), ("日本", "en", "z"),
]


def test_equals_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(t, la, so, "lang", 3) for t, la, so in ROWS], "text string, lang string, source string, term string, value int").repartition(4)
    want = brute(ROWS)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want
    monkeypatch.setattr(divergence, "CELLS", 3)
    monkeypatch.setattr(divergence, "SENT", 0)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet'")
    assert sorted(map(tuple, divergence.query(spark, path).collect())) == sorted(con.sql(divergence.SQL).fetchall())


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(5)
    count, total = rng.integers(0, 10**14, 500), rng.integers(10**14, 9 * 10**15, 500)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]


def test_empty_table_and_languages_without_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    got = divergence.audit(spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], schema)).collect()
    assert sorted(map(tuple, got)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
