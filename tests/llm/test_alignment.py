import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from quarrystone.llm import alignment

A, B = public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE)
ODD = [
    None, "", " ", "  ", "a", "word", "two words", "two  spaces  here", " lead", "trail ", "line\nbreak", "\n", "a\n\nb", "a \nb", "tab\there", "a \tb", "don't won't", "<|endoftext|> plain <s> </s>",
    "▁underline ▁", "naïve café déjà", "日本語 テスト", "한국어", "😀 emoji😀", "é combining", "\x00nul \x07bell", "x" * 300, "0123456789" * 20, "a b", "The same words. The same words.", "Zürich\r\nBern", "1,234.56 €", "ab" * 2000,
]


def brute(texts):
    """Byte by byte, from the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = {v: k for k, v in alignment._LETTERS.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    docs = []
    for text in texts:
        groups = []
        if text:
            got_a = a.encode(" " + text, add_special_tokens=False).ids
            raw_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in got_a]
            got_b = b.encode(text)
            raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in got_b)]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
                    groups.append((got_a[i:k], got_b[j:m]))
                    i, j = k, m
        docs.append(groups)
    held = Counter(p for groups in docs for p in {(x, y) for xs, ys in groups for x in xs for y in ys})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        out.append((
            sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links),
            sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    texts = ODD + [r["text"] for r in docs] + [docs[0]["text"]] * 3
    table = spark.createDataFrame([(k, t, k % 3, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a int, slice_ string").repartition(5, "doc_id")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.scored(table, A, B).collect()}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want
    monkeypatch.setattr(alignment, "SLICE", 2000)
    again = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.scored(table, A, B).collect()}
    assert again == got


def test_owner_arrays_with_large_groups():
    """Tokens that never end together but at the end: one group, every pair linked."""
    lengths = np.array([0, 1, 2, 3])
    a, b = np.array([1, 2, 2, 2, 1]), np.array([2, 2, 2, 2])
    parts = alignment.Parts(1)
    alignment.group(parts, a, np.zeros(5, int), b, lengths, lengths)
    assert (parts.n_groups.tolist(), parts.n_links.tolist(), parts.groups) == ([1], [20], [b"1,2,2,2,1|2,2,2,2;"])
    assert parts.often.tolist() == [8, 12]


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored(none, A, B).collect() == []
    rows = alignment.scored(spark.createDataFrame([(None, "same text"), (None, "same text")], "doc_id long, text string"), A, B).collect()
    assert len(rows) == 2 and all(r["n_links"] == r["n_best"] and r["count_sum"] == 2 * r["n_links"] for r in rows)


def test_query_reads_the_whole_table(spark):
    got = alignment.query(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert dict(got.dtypes) == {"doc_id": "bigint", **{c: "bigint" for c in COLUMNS[:-1]}, "groups_sha256": "string"}
    assert got.agg(F.min("n_groups")).first()[0] >= 0
