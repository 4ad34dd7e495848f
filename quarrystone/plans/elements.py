"""Element queries (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import elements as E
from quarrystone.operators import inverted, rules
from quarrystone.operators.lineage import shared_folder
from quarrystone.operators import search as X
from quarrystone.plans.registry import SQL, query

_IDS = "SELECT e.global_id FROM elements e WHERE "
_HAS = "e.element_row IN (SELECT element_row FROM properties WHERE key = '{}' AND {})"


def _ids(name: str, condition: dict, where: str) -> None:
    query(name, _IDS + where)(lambda t: E.filtered(t.elements, t.properties, condition).select("global_id"))


_ids("a02_filter_all_any", {"@classFullName": "Customer", "$or": [{"@storey": "BUILDING"}, {"Acct.Balance": {"$lt": 0}}, {"$and": [{"@storey": "MACHINERY"}, {"Flag.Positive": False}]}]}, "class = 'Customer' AND (storey = 'BUILDING' OR " + _HAS.format("Acct.Balance", "value_number < 0") + " OR (storey = 'MACHINERY' AND " + _HAS.format("Flag.Positive", "value_boolean = false") + "))")
_ids("a02_filter_empty_all", {}, "true")
_ids("a03_root_eq", {"@classFullName": "Nation"}, "class = 'Nation'")
_ids("a03_root_ne", {"@storey": {"$ne": "BUILDING"}}, "storey <> 'BUILDING'")
_ids("a04_root_in", {"@id": {"$in": ["C1", "N3", "R0", "none"]}}, "global_id IN ('C1', 'N3', 'R0', 'none')")
_ids("a04_root_in_empty", {"@id": {"$in": []}}, "false")
_ids("a05_root_like", {"@label": {"$like": "customer#%_7"}}, "name ILIKE 'customer#%_7'")
_ids("a07_property_eq", {"Seg.Name": "BUILDING"}, _HAS.format("Seg.Name", "value_text = 'BUILDING'"))
_ids("a08_property_absent", {"Acct.Balance": {"$eq": None}}, "NOT " + _HAS.format("Acct.Balance", "true"))
_ids("a09_property_present", {"Seg.Name": {"$ne": None}}, _HAS.format("Seg.Name", "true"))
_ids("a10_property_ne", {"Mixed.Value": {"$ne": 12}}, _HAS.format("Mixed.Value", "true") + " AND NOT " + _HAS.format("Mixed.Value", "value_number = 12"))
_ids("a11_property_in", {"Mixed.Value": {"$in": [12, "v3", True]}}, _HAS.format("Mixed.Value", "(value_number = 12 OR value_text = 'v3' OR value_boolean = true)"))
_ids("a12_property_like", {"Seg.Name": {"$like": "%ild%"}}, _HAS.format("Seg.Name", "value_text ILIKE '%ild%'"))
_ids("a13_property_compare", {"Acct.Balance": {"$gte": 5000}}, _HAS.format("Acct.Balance", "value_number >= 5000"))
_ids("a14_two_bounds_two_rows", {"Acct.Balance": {"$gt": 100, "$lt": 2000}}, _HAS.format("Acct.Balance", "value_number > 100") + " AND " + _HAS.format("Acct.Balance", "value_number < 2000"))

_FILTER = {"@classFullName": "Customer", "Acct.Balance": {"$gt": 0}}
_MATCH = "SELECT * FROM elements e WHERE class = 'Customer' AND " + _HAS.format("Acct.Balance", "value_number > 0")


@query("a16_list_page", f"SELECT element_row, global_id, rn > 0 AND (SELECT count(*) FROM ({_MATCH}) WHERE element_row > 3000050) > 20 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY element_row) AS rn FROM ({_MATCH}) WHERE element_row > 3000050) WHERE rn <= 20")
def list_page(t):
    return E.page(E.filtered(t.elements, t.properties, _FILTER), 3000050, 20).select("element_row", "global_id", "has_more")


@query("a16_list_total", f"SELECT count(*) AS total FROM ({_MATCH})")
def list_total(t):
    return E.filtered(t.elements, t.properties, _FILTER).agg(F.count("*").alias("total"))


@query(
    "a17_element_details",
    """
WITH lastp AS (SELECT * FROM properties QUALIFY row_number() OVER (PARTITION BY element_row, key ORDER BY property_row DESC) = 1),
props AS (SELECT element_row, string_agg(key || '=' || coalesce(value_text, CAST(CAST(value_number AS DECIMAL(18,2)) AS VARCHAR), CAST(value_boolean AS VARCHAR)), ';' ORDER BY key) AS properties FROM lastp GROUP BY 1)
SELECT e.global_id, p.global_id AS parent_global_id, properties FROM elements e LEFT JOIN elements p ON e.parent_express_id = p.express_id LEFT JOIN props ON props.element_row = e.element_row""",
)
def details(t):
    return E.element_details(t.elements, t.properties).select("global_id", "parent_global_id", "properties")


_COLUMNS = ["source", "lang", "text"]
_FOLDED = "strip_accents(lower(coalesce({c}, '')))"


def _count(word: str) -> str:
    """Occurrences of a word, or of words in a row, in all columns, by regular expressions over spaced-out texts."""
    end = "[a-z0-9\u00aa-\uffff]*" if word.endswith("*") else ""
    one = "len(regexp_extract_all(' ' || regexp_replace(" + _FOLDED + ", '[^\\pL\\pN]+', '  ', 'g') || ' ', ' " + word.rstrip("*").replace(" ", "  ") + end + " '))"
    return " + ".join(one.format(c=c) for c in _COLUMNS)


def _search_sql(body: str, *words: str) -> str:
    length = " + ".join(f"len(regexp_extract_all({_FOLDED.format(c=c)}, '[\\pL\\pN]+'))" for c in _COLUMNS)
    counts = ", ".join(f"{_count(w)} AS h{k}" for k, w in enumerate(words))
    return f"WITH c AS (SELECT doc_id, {length} AS len, {counts} FROM documents) {body}"


@query("a18_search_tokens", "SELECT * FROM (VALUES (0, 'word', 'door'), (1, '+', ''), (2, '-', ''), (3, 'phrase', 'fire \"wall'), (4, '|', ''), (5, '(', ''), (6, 'prefix', 'win'), (7, 'word', 'a+b-c'), (8, ')', '')) t(place, kind, text)")
def search_tokens(t):
    found = X.tokenized(r'door + -"fire \"wall" | (win* a\+b-c)')
    return t.spark.createDataFrame([(k, *x) for k, x in enumerate(found)], "place int, kind string, text string")


@query("a19_search_any", _search_sql("SELECT doc_id FROM c WHERE h0 > 0 OR h1 > 0", "license", "passw*"))
def search_any(t):
    return X.search(t.read("documents"), "doc_id", _COLUMNS, "license passw*").select("doc_id")


@query("a19_search_groups", _search_sql("SELECT doc_id FROM c WHERE (h0 > 0 AND (h1 > 0 OR h2 > 0)) OR h3 > 0", "license", "mit", "apache", "token"))
def search_groups(t):
    return X.search(t.read("documents"), "doc_id", _COLUMNS, "license + (mit | apache) token").select("doc_id")


@query("a20_search_and_not", _search_sql("SELECT doc_id FROM c WHERE h0 > 0 AND h1 > 0 AND NOT h2 > 0", "license", "en", "mit"))
def search_and_not(t):
    return X.search(t.read("documents"), "doc_id", _COLUMNS, "license + en + -mit").select("doc_id")


@query("a20_search_render", """SELECT '(("license" AND ("a ""b" OR "c" *)) NOT "mit")' AS match""")
def search_render(t):
    return t.spark.createDataFrame([(X.rendered(X.parsed(r'license + ("a \"b" c*) + -mit')),)], "match string")


@query("a21_search_phrase", _search_sql("SELECT doc_id FROM c WHERE h0 > 0", "the mit license"))
def search_phrase(t):
    return X.search(t.read("documents"), "doc_id", _COLUMNS, '"the mit license"').select("doc_id")


def _bm25(k: int) -> str:
    return f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * h{k} * 2.2 / (h{k} + 1.2 * (0.25 + 0.75 * len / mean))"


@query(
    "a21_search_bm25",
    _search_sql(f", s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (h0 > 0) AS d0, count(*) FILTER (h1 > 0) AS d1, count(*) FILTER (h2 > 0) AS d2 FROM c) SELECT doc_id, round({_bm25(0)} + {_bm25(1)} + {_bm25(2)}, 6) AS score FROM c, s WHERE h0 + h1 + h2 > 0 ORDER BY round({_bm25(0)} + {_bm25(1)} + {_bm25(2)}, 6) DESC, doc_id LIMIT 50", "license", "password", "token"),
)
def search_ranked(t):
    found = X.search(t.read("documents"), "doc_id", _COLUMNS, "license password token").withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("score"), "doc_id").limit(50)


_INDEXES: dict[tuple[str, str], str] = {}


def _index(t):
    """The index of the documents, written once per session and input."""
    at = (t.spark.sparkContext.applicationId, t.sf_dir)
    if at not in _INDEXES:
        _INDEXES[at] = shared_folder(t.spark)
    return inverted.opened(t.read("documents"), "doc_id", _COLUMNS, _INDEXES[at])


_TOKENS = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all({_FOLDED.format(c=c)}, '[\\pL\\pN]+')) AS term FROM documents" for c in _COLUMNS)


@query("a21_index_terms", f"SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM ({_TOKENS}) GROUP BY term")
def index_terms(t):
    found = _index(t).table("postings")
    return found.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum(F.aggregate(F.col("entries.hits"), F.lit(0).cast("long"), lambda n, hits: n + hits)).alias("hits"))


@query("a21_index_top50", SQL["a21_search_bm25"])
def index_ranked(t):
    found = _index(t).search("license password token", top=50).withColumn("score", F.round("score", 6))
    return found.select(F.col("row").alias("doc_id"), "score")


@query("a21_index_phrase", SQL["a21_search_phrase"])
def index_phrase(t):
    return _index(t).search('"the mit license"').select(F.col("row").alias("doc_id"))


@query("a21_index_groups", _search_sql("SELECT doc_id FROM c WHERE (h0 > 0 AND (h1 > 0 OR h2 > 0) AND NOT h4 > 0) OR h3 > 0", "license", "mit", "apac*", "token", "en"))
def index_groups(t):
    return _index(t).search("license + (mit | apac*) + -en token").select(F.col("row").alias("doc_id"))


@query(
    "a21_index_updates",
    _search_sql(f", k AS (SELECT * FROM c WHERE doc_id % 7 <> 0 OR doc_id % 3 = 0), s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (h0 > 0) AS d0, count(*) FILTER (h1 > 0) AS d1 FROM k) SELECT doc_id, round({_bm25(0)} + {_bm25(1)}, 6) AS score FROM k, s WHERE h0 + h1 > 0", "license", "pass*"),
)
def index_updates(t):
    """Rows are added in two batches; between them some of the first go."""
    docs = t.read("documents")
    index = inverted.InvertedIndex.create(docs.where("doc_id % 3 <> 0"), "doc_id", _COLUMNS, shared_folder(t.spark))
    index.delete(docs.where("doc_id % 7 = 0").select("doc_id")).add(docs.where("doc_id % 3 = 0"))
    return index.search("license pass*").select(F.col("row").alias("doc_id"), F.round("score", 6).alias("score"))


@query("a22_word_parts", "SELECT global_id, CASE WHEN parts = t THEN t ELSE t || ' ' || parts END AS indexed FROM (SELECT global_id, t, regexp_replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS parts FROM (SELECT global_id, class || global_id AS t FROM elements))")
def parts(t):
    return t.elements.select("global_id", E.word_parts(F.concat("class", "global_id")).alias("indexed"))


_STATS = "count(value_number) AS count, round(min(value_number), 6) AS min, round(max(value_number), 6) AS max, round(avg(value_number), 6) AS avg, round(coalesce(sum(value_number), 0), 6) AS total, coalesce(string_agg(DISTINCT units, ',' ORDER BY units) FILTER (value_number IS NOT NULL), '') AS units"


def _flat(df):
    return df.withColumns({c: F.round(c, 6) for c in ("min", "max", "avg", "total")}).withColumn("units", F.array_join("units", ","))


@query("a23_aggregate", f"SELECT k.i AS ordinal, k.key, {_STATS} FROM (VALUES (0, 'Acct.Balance'), (1, 'Mixed.Value'), (2, 'No.Such')) k(i, key) LEFT JOIN (SELECT p.* FROM properties p WHERE element_row IN (SELECT element_row FROM ({_MATCH}))) p ON p.key = k.key GROUP BY 1, 2")
def aggregate(t):
    return _flat(E.aggregated(t.elements, t.properties, "Acct.Balance,Mixed.Value,No.Such", _FILTER))


@query("a24_group_counts_column", "SELECT storey AS group_text, CAST(NULL AS DOUBLE) AS group_number, CAST(NULL AS BOOLEAN) AS group_boolean, count(*) AS count FROM elements GROUP BY 1")
def counts_column(t):
    return E.checked_groups(E.group_counts(t.elements, t.properties, "@storey"))


@query("a24_group_counts_property", "SELECT value_text AS group_text, value_number AS group_number, value_boolean AS group_boolean, count(*) AS count FROM elements e LEFT JOIN (SELECT * FROM properties WHERE key = 'Mixed.Value') p ON p.element_row = e.element_row GROUP BY 1, 2, 3")
def counts_property(t):
    return E.checked_groups(E.group_counts(t.elements, t.properties, "Mixed.Value"))


@query(
    "a25_group_statistics",
    f"""
WITH m AS (SELECT e.element_row, storey AS group_text FROM ({_MATCH}) e),
w AS (SELECT DISTINCT group_text, k.key FROM m, (VALUES ('Acct.Balance'), ('No.Such')) k(key))
SELECT w.group_text, CAST(NULL AS DOUBLE) AS group_number, CAST(NULL AS BOOLEAN) AS group_boolean, w.key, {_STATS}
FROM w LEFT JOIN (SELECT m.group_text, p.* FROM m JOIN properties p ON p.element_row = m.element_row) v ON v.group_text IS NOT DISTINCT FROM w.group_text AND v.key = w.key GROUP BY ALL""",
)
def group_statistics(t):
    return _flat(E.group_statistics(t.elements, t.properties, "@storey", ["Acct.Balance", "No.Such"], _FILTER))


@query("a27_property_names", "SELECT DISTINCT key, CASE WHEN value_number IS NOT NULL THEN 'number' WHEN value_boolean IS NOT NULL THEN 'boolean' ELSE 'string' END AS type FROM properties")
def names(t):
    return E.property_names(t.properties)


@query("a28_index_status", "SELECT count(DISTINCT element_row) AS elements, count(*) AS property_rows, count(DISTINCT key) AS keys FROM properties")
def index_status(t):
    return E.property_statistics(t.properties)


@query("a29_tree_roots", "SELECT express_id, global_id, coalesce(name, class) AS label, EXISTS (SELECT 1 FROM elements c WHERE c.parent_express_id = e.express_id) AS has_children FROM elements e WHERE parent_express_id IS NULL")
def roots(t):
    return E.children(t.elements, None)


@query("a29_tree_children", "SELECT express_id, global_id, coalesce(name, class) AS label, EXISTS (SELECT 1 FROM elements c WHERE c.parent_express_id = e.express_id) AS has_children FROM elements e WHERE parent_express_id = 1000001")
def tree_children(t):
    return E.children(t.elements, 1000001)


@query(
    "a30_tree_path",
    """WITH RECURSIVE up AS (SELECT global_id AS start, express_id, parent_express_id, 0 AS step FROM elements
UNION ALL SELECT u.start, e.express_id, e.parent_express_id, u.step + 1 FROM up u JOIN elements e ON e.express_id = u.parent_express_id WHERE u.step < 63)
SELECT start, express_id, step FROM up""",
)
def tree_path(t):
    return E.paths(t.elements, t.elements.select("global_id"))


@query("a31_known_ids", "SELECT global_id FROM elements WHERE global_id IN (SELECT 'C' || (i * 7) FROM range(1000) t(i))")
def known_ids(t):
    asked = t.spark.range(1000).select(F.concat(F.lit("C"), F.col("id") * 7).alias("global_id"))
    return E.known_ids(t.elements, asked)


@query("a32_edit_properties", "SELECT element_row, key, CASE WHEN key = 'Seg.Name' AND value_text = 'BUILDING' THEN 'HOUSE' ELSE value_text END AS value_text, value_number, value_boolean FROM properties")
def edit_properties(t):
    changes = t.properties.where("key = 'Seg.Name' and value_text = 'BUILDING'").withColumn("value_text", F.lit("HOUSE"))
    return E.edited(t.properties, changes).select("element_row", "key", "value_text", "value_number", "value_boolean")


@query("a33_delete_insert", "SELECT express_id, global_id, class, name FROM elements WHERE global_id NOT IN ('C1', 'C2') UNION ALL SELECT max(express_id) + 1, 'P0', 'Proxy', 'new' FROM elements WHERE global_id NOT IN ('C1', 'C2')")
def delete_insert(t):
    gone = t.spark.createDataFrame([("C1",), ("C2",)], "global_id string")
    return E.with_proxy(E.without(t.elements, gone), "P0", "Proxy", "new").select("express_id", "global_id", "class", "name")


_MM = "CAST(round({} * 1000) AS BIGINT)"
_VERTICES = " || ',' || ".join(_MM.format(v + a) for v in "uvw" for a in "xyz")


@query("a34_mesh_hash", f"SELECT mesh_id, sha256(string_agg(h, '' ORDER BY h)) AS mesh_hash FROM (SELECT mesh_id, sha256({_VERTICES}) AS h FROM triangles) GROUP BY 1")
def mesh_hash(t):
    return E.mesh_hashes(t.triangles)


@query("a35_element_boxes", "SELECT mesh_id, round((min(least(ux,vx,wx)) + max(greatest(ux,vx,wx))) / 2, 6) AS x, round((min(least(uy,vy,wy)) + max(greatest(uy,vy,wy))) / 2, 6) AS y, round((min(least(uz,vz,wz)) + max(greatest(uz,vz,wz))) / 2, 6) AS z, round(sqrt(pow(max(greatest(ux,vx,wx)) - min(least(ux,vx,wx)), 2) + pow(max(greatest(uy,vy,wy)) - min(least(uy,vy,wy)), 2) + pow(max(greatest(uz,vz,wz)) - min(least(uz,vz,wz)), 2)) / 2, 6) AS radius FROM triangles GROUP BY 1")
def boxes(t):
    low = {a: F.min(F.least(*[v + a for v in "uvw"])) for a in "xyz"}
    high = {a: F.max(F.greatest(*[v + a for v in "uvw"])) for a in "xyz"}
    radius = F.sqrt(sum((F.pow(high[a] - low[a], 2) for a in "yz"), F.pow(high["x"] - low["x"], 2))) / 2
    return t.triangles.groupBy("mesh_id").agg(*[F.round((low[a] + high[a]) / 2, 6).alias(a) for a in "xyz"], F.round(radius, 6).alias("radius"))


@query("a36_translate_yaw", "SELECT point_id, round(x * cos(0.5) - y * sin(0.5) + 10, 6) AS x, round(x * sin(0.5) + y * cos(0.5) - 4, 6) AS y, round(z + 2, 6) AS z FROM points")
def translate_yaw(t):
    return E.placed(t.points, 0.5, (10, -4, 2)).select("point_id", *[F.round(a, 6).alias(a) for a in "xyz"])


@query("a37_rewrite_property", "SELECT element_row, key, CASE WHEN key = 'Flag.Positive' THEN NOT value_boolean ELSE value_boolean END AS value_boolean FROM properties")
def rewrite(t):
    return E.rewritten(t.properties, "Flag.Positive", boolean=~F.col("value_boolean")).select("element_row", "key", "value_boolean")


@query("a38_apply_edits", "SELECT element_row, key, CASE WHEN element_row = 3000007 AND key = 'Seg.Name' THEN 'X' ELSE value_text END AS value_text FROM properties WHERE element_row <> 3000009")
def apply_edits(t):
    own = t.elements, t.properties
    for edit in ({"kind": "set_property", "global_id": "C7", "key": "Seg.Name", "value": "X"}, {"kind": "delete", "global_id": "C9"}, {"kind": "rename", "global_id": "C1", "name": "first"}):
        own = E.applied_edit(*own, edit)
    return own[1].select("element_row", "key", "value_text")


@query("flagship", f"SELECT storey AS group_text, {_STATS} FROM ({_MATCH}) e JOIN properties p ON p.element_row = e.element_row AND p.key = 'Acct.Balance' GROUP BY 1")
def flagship(t):
    rows = E.group_statistics(t.elements, t.properties, "@storey", "Acct.Balance", _FILTER)
    return _flat(rows).drop("group_number", "group_boolean", "key")


#: Rules with the SQL of their two filters.
_RULES = [
    ({"name": "customers have a balance", "applies": {"@classFullName": "Customer"}, "requires": {"Acct.Balance": {"$ne": None}}}, "class = 'Customer'", _HAS.format("Acct.Balance", "true")),
    ({"name": "customers have names", "applies": {"@classFullName": "Customer"}, "requires": {"@label": {"$like": "customer#%"}}, "occurs": "required"}, "class = 'Customer'", "name ILIKE 'customer#%'"),
    ({"name": "buildings owe nothing", "applies": {"@storey": "BUILDING", "Acct.Balance": {"$ne": None}}, "requires": {"Flag.Positive": True}}, "storey = 'BUILDING' AND " + _HAS.format("Acct.Balance", "true"), _HAS.format("Flag.Positive", "value_boolean = true")),
    ({"name": "nations are few", "applies": {"@classFullName": "Nation"}, "requires": {"Acct.Balance": {"$lte": 200}}}, "class = 'Nation'", _HAS.format("Acct.Balance", "value_number <= 200")),
    ({"name": "a value of three", "applies": {"Mixed.Value": "v3"}, "occurs": "prohibited"}, _HAS.format("Mixed.Value", "value_text = 'v3'"), "false"),
    ({"name": "walls stand", "applies": {"@classFullName": "Wall"}, "requires": {"Seg.Name": {"$ne": None}}, "occurs": "required"}, "class = 'Wall'", _HAS.format("Seg.Name", "true")),
]
_CHECKED = " UNION ALL ".join(f"SELECT e.global_id, '{r['name']}' AS rule, coalesce({needs}, false) AS passed FROM elements e WHERE {where}" for r, where, needs in _RULES)
_NAMED = ", ".join(f"('{r['name']}', '{r.get('occurs', 'optional')}')" for r, _, _ in _RULES)


@query("a39_rule_verdicts", _CHECKED)
def rule_verdicts(t):
    return rules.verdicts(t.elements, t.properties, [r for r, _, _ in _RULES]).select("global_id", "rule", "passed")


@query("a39_rule_report", f"SELECT rule, occurs, applicable, passed, applicable - passed AS failed, applicable = passed AND (occurs <> 'required' OR applicable > 0) AS status FROM (SELECT n.rule, n.occurs, count(c.global_id) AS applicable, count(*) FILTER (c.passed) AS passed FROM (VALUES {_NAMED}) n(rule, occurs) LEFT JOIN ({_CHECKED}) c ON c.rule = n.rule GROUP BY 1, 2)")
def rule_report(t):
    return rules.report(t.elements, t.properties, [r for r, _, _ in _RULES])
