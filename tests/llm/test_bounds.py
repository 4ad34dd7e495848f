"""Results must not hang on how much is held at a time, and samples and indexes must be bounded."""

import numpy as np

from quarrystone.llm import decontaminate, language


def test_tiles_do_not_hang_on_how_many_pairs_are_held(monkeypatch):
    """Few different words repeat over and over, so runs of one length abound; the tiles must be the same however few pairs are held."""
    rng = np.random.default_rng(3)
    for turn in range(150):
        doc, item = (rng.integers(1, 3 + turn % 2, rng.integers(1, 60)).astype(np.uint64) for _ in range(2))
        monkeypatch.setattr(decontaminate, "MOST_PAIRS", 1 << 21)
        want = decontaminate.tiles(doc, item, 2 + turn % 4)
        for most in (0, 7, 100):
            monkeypatch.setattr(decontaminate, "MOST_PAIRS", most)
            assert decontaminate.tiles(doc, item, 2 + turn % 4) == want


def test_the_benchmark_index_is_small():
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("w%d" % x for x in rng.integers(0, 5000, 80))) for k in range(2000)]
    index = decontaminate.Index(rows, 5)
    held = sum(a.nbytes for _, h, i in index.seeds.values() for a in (h, i)) + sum(own.nbytes for _, own in index.items)
    assert held < 6 * sum(len(t) for _, t in rows)


def test_language_sample_is_bounded_whatever_the_identifiers(spark):
    docs = spark.range(6000).selectExpr("if(id % 2 = 0, id, null) AS doc_id", "concat('text number ', id) AS text", "if(id % 10 = 0, 'xx', 'yy') AS lang")
    docs = docs.unionByName(spark.range(3000).selectExpr("CAST(7 AS LONG) AS doc_id", "'the same text' AS text", "'yy' AS lang"))
    taken = []
    original = language.Model.fit
    language.Model.fit = classmethod(lambda cls, rows, labels, *a: taken.append(sorted(labels)) or original(rows, labels, *a))
    try:
        language.fitted(docs, 400)
    finally:
        language.Model.fit = original
    assert 100 < taken[0].count("xx") < 300 and 120 < taken[0].count("yy") < 300
