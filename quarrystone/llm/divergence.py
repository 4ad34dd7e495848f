"""Source divergence audit: how far the term distributions of a language's sources lie apart, in exact whole numbers.

Terms are runs of letters (ASCII, folded, and everything beyond ASCII); a language keeps the terms of at least ``LEAST_DOCS``
documents. A group is a (lang, source) that occurs. Count columns are deduplicated: the kept terms with the same sparse
vector of counts by source are one column with a multiplicity; every pair of sources is evaluated once per distinct column,
where either source has a count, and the columns where neither has are one value times their number. Terms themselves are
ranked by their own contribution against the language.

Whole numbers everywhere: p = 1 + floor(10**9 (count + 1) / (N + V)), f = floor((p - q)**2 / q).

Counts are made in each task slice by slice, then summed by Spark; one row per group (the result has the square of that)
reaches the driver, never a term. Defined cases: null text, lang and source count as ''; a language without kept terms has
pairs of value 0 and no terms; equal values go by the item's UTF-8 bytes; repeated rows count as often as they occur; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import read, small_batches, written
from quarrystone.llm.terms import LETTERS, gathered, numbered, text_of, tokens

LEAST_DOCS, TOP = 3, 200
UNIT = 1_000_000_000
#: Cells of the matrices that a task holds at a time.
CELLS = 1 << 20
#: Rows of groups up to which their totals are sent to every task; more are joined by Spark.
SENT = 1 << 17


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / total), by long division in three steps, so that 64 bits are enough for totals below 9 * 10**15."""
    total = np.asarray(total, np.int64)
    out, left = np.divmod(np.asarray(count, np.int64) + 1, total)
    for _ in range(3):
        more, left = np.divmod(left * 1000, total)
        out = out * 1000 + more
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def counted(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Of every kept term of a language: lang, term, total, and entries, its counts by source (sorted structs source, n)."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            found, doc = tokens(text_of(table), LETTERS)
            term, names = numbered(found)
            lang, langs = numbered(text_of(table, "lang"))
            source, sources = numbered(text_of(table, "source"))
            width = max(1, len(names))
            # once per document and term, then per language, term and source
            pair, n = np.unique(doc * width + term, return_counts=True)
            doc, term = np.divmod(pair, width)
            key = (lang[doc] * width + term) * max(1, len(sources)) + source[doc]
            key, place = np.unique(key, return_inverse=True)
            n, d = np.bincount(place, n, len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
            head, source = np.divmod(key, max(1, len(sources)))
            first = np.flatnonzero(np.diff(head, prepend=-1))
            head, ends = head[first], np.append(first, len(key)).astype(np.int32)
            d = np.add.reduceat(d, first) if len(first) else d
            each = pa.StructArray.from_arrays([sources.take(pa.array(source)), pa.array(n)], names=["source", "n"])
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(head // width)), names.take(pa.array(head % width)), pa.array(d, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), each)],
                names=["lang", "term", "docs", "entries"],
            )
        pa.default_memory_pool().release_unused()

    kind = "array<struct<source:string,n:bigint>>"
    # rows of a term meet once; both groupings below keep that partitioning
    parts = small_batches(docs).mapInArrow(run, f"lang string, term string, docs long, entries {kind}").repartition("lang", "term")
    one = parts.select("lang", "term", "docs", F.posexplode("entries").alias("at", "e"))
    by_source = one.groupBy("lang", "term", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("entries"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def _pair_sums(groups: dict[str, tuple[list[str], np.ndarray, int]]):
    """Sums over distinct columns of f less its value where neither source has a count, for every two sources of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, langs = numbered(batch.column("lang"))
            entries = batch.column("entries")
            ends = entries.offsets.to_numpy()
            flat = entries.values
            source_of, names = numbered(flat.field("source"))
            n_of, weight_of = flat.field("n").to_numpy(), batch.column("weight").to_numpy()
            names = names.to_pylist()
            for x, name in enumerate(langs.to_pylist()):
                sources, totals, v = groups[name]
                number = {s: k for k, s in enumerate(sources)}
                here = np.array([number.get(s, -1) for s in names], np.int64)
                none = shares(np.zeros(len(sources), np.int64), totals + v)
                base = excess(none[:, None], none[None, :])
                out = sums.setdefault(name, np.zeros((len(sources),) * 2, np.int64))
                rows = np.flatnonzero(lang == x)
                step = max(1, CELLS // (len(sources) * max(1, int(np.diff(ends).max(initial=1)))))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    size = (ends[part + 1] - ends[part]).astype(np.int64)
                    row = np.repeat(np.arange(len(part)), size)
                    at = np.repeat(ends[part] - np.cumsum(size) + size, size) + np.arange(len(row))
                    s = here[source_of[at]]
                    p = shares(n_of[at], totals[s] + v)
                    all_p = np.tile(none, (len(part), 1))
                    counted = np.zeros(all_p.shape, bool)
                    all_p[row, s], counted[row, s] = p, True
                    weight = weight_of[part][row][:, None]
                    # the entry's source against every other; every source without a count against the entry's
                    np.add.at(out, s, (excess(p[:, None], all_p[row]) - base[s]) * weight)
                    back = (excess(all_p[row], p[:, None]) - base[:, s].T) * weight
                    back[counted[row]] = 0
                    np.add.at(out.T, s, back)
        for name, out in sums.items():
            sources = groups[name][0]
            k = len(sources)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (k * k)), pa.array(np.repeat(sources, k).tolist(), pa.string()), pa.array(sources * k, pa.string()), pa.array(out.reshape(-1))],
                names=["lang", "source", "item", "value"],
            )

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; every pair of sources of a language, and each group's
    ``top`` terms by value."""
    spark = docs.sparkSession
    kept = written(counted(docs, least_docs))
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    sizes = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    v_of = {r["lang"]: r["v"] for r in kept.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    # one row per group; the result has a row for every two of a language
    rows = plain.distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["n"]).orderBy("lang", "source").collect()
    groups: dict[str, tuple[list[str], np.ndarray, int]] = {}
    for name in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == name]
        groups[name] = ([r["source"] for r in own], np.array([r["n"] for r in own], np.int64), v_of.get(name, 0))
    sent = {k: g for k, g in groups.items() if g[2]}

    columns = kept.groupBy("lang", "entries").agg(F.count("*").alias("weight"))
    sums = columns.mapInArrow(_pair_sums(sent), "lang string, source string, item string, value long")

    whole = {k: int(g[1].sum()) + g[2] for k, g in groups.items()}
    table = [(r["lang"], r["source"], r["n"] + v_of.get(r["lang"], 0), whole[r["lang"]], v_of.get(r["lang"], 0)) for r in rows]
    params = spark.createDataFrame(table, "lang string, source string, own long, whole long, v long")
    if len(table) <= SENT:
        params = F.broadcast(params)
    share = lambda n, total: F.expr(f"1 + ((cast({n} + 1 as decimal(20, 0)) * {UNIT}) div {total})")
    gap = lambda p, q: F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")
    # where neither source has a count: one value, as often as there are kept terms
    none = F.when(F.col("v") > 0, share("0", "own")).alias("none")
    every = params.select("lang", "source", "v", none).join(params.select("lang", F.col("source").alias("item"), none.alias("other")), "lang").where("source <> item")
    bases = every.select("lang", "source", "item", F.when(F.col("v") > 0, gap("none", "other") * F.col("v")).otherwise(0).alias("value"))
    pairs = sums.where("source <> item").unionByName(bases).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    each = kept.select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    each = each.join(params, ["lang", "source"]).withColumns({"p": share("n", "own"), "q": share("total", "whole")}).where("p > q")
    terms = each.select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
found as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as total from found group by lang, term having count(distinct id) >= 3),
groups as (select distinct lang, source from docs),
counts as (select f.lang, f.source, f.term, count(*) as n from found f join kept k on f.lang = k.lang and f.term = k.term group by all),
v as (select g.lang, (select count(*) from kept k where k.lang = g.lang) as v, (select coalesce(sum(total), 0) from kept k where k.lang = g.lang) as whole
  from (select distinct lang from groups) g),
sizes as (select g.lang, g.source, coalesce(sum(c.n), 0) as own from groups g left join counts c on g.lang = c.lang and g.source = c.source group by all),
p as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.own + v.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.total + 1)) // (v.whole + v.v)::hugeint as q
  from sizes s join v on s.lang = v.lang join kept k on k.lang = s.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pair_values as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(pv.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pair_values pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (
  select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms)
where rank <= 200
"""
