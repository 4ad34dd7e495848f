"""Personal data: fixed patterns, and candidates judged by gradient-boosted trees, in DataFrame functions only.

High-recall generators propose number-like, account-like, mail-like and spelled-out spans, which overlap the fixed patterns'
spans and each other. What is said of a candidate are its format (groups, separators, digits, brackets) and the words before
and after it; all features are binary. Boosted trees of depth two are fitted with Newton steps to made samples: personal data
that the fixed patterns don't know, and dates, versions, sums, ranges, serial numbers and the like, in context sentences of
several languages. A made sample says where its personal data stands, so labels don't depend on the fixed patterns. The same
column functions find the candidates of samples and documents; samples are grouped by feature values before they reach the
driver. The threshold is the lowest score from which held-out samples were right often enough. Trees are applied as SQL
expressions. Fixed patterns' spans stay; candidates overlapping one give way, and of accepted candidates that overlap each
other the leftmost, then longest, stays.

Defined cases: a null or empty text has no spans; texts are read whole; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns. Look-behinds and possessive groups change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])(?:[0-9]{7,19}+|\(?[0-9]{2,5}+\)?(?:[\x20.-]\(?[0-9]{2,5}+\)?){1,5}+)(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "mail": r"(?<![^\s@,;:<>()\[\]\"'])[^\s@,;:<>()\[\]\"']++@[^\s@,;:<>()\[\]\"']++",
    "spelled": r"(?<![0-9A-Za-z])[0-9A-Za-z._-]{1,40}+\x20[(\[]?(?i:at|arobase|arroba)[)\]]?\x20[0-9A-Za-z-]{1,40}+\x20[(\[]?(?i:dot|punkt|point|punto)[)\]]?\x20[A-Za-z]{2,10}(?![0-9A-Za-z])",
}
_GENERATOR_HINTS = {"number": r"[0-9]{2}", "account": r"[A-Z]{2}[0-9]{2}", "mail": "@", "spelled": r"(?i)(?:at|arobase|arroba)[)\]]?\x20"}
_SPAN = "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"
FEATURES = (
    "mail", "spelled", "account", "brackets", "dashes", "dots", "spaces", "digits7", "digits13", "groups3", "contact", "identity", "counted", "date", "phone_form", "number_form", "host_dot",
)
_CONTACT = r"(?i)(?:tel|phone|telefon|t\u00e9l\u00e9phone|tel\u00e9fono|fon|call|ring|mobile|handy|portable|m\u00f3vil|appelez|fax|mail|write|contact|kontakt|reach)[a-z]*[^A-Za-z0-9]{0,3}(?:[a-z]{1,4}[^A-Za-z0-9]{1,2}){0,2}$"
_IDENTITY = r"(?i)(?:ssn|social security|passport|pass|account|konto|compte|cuenta|iban|card|karte|carte|tax id)[a-z]*[^A-Za-z0-9]{0,3}(?:(?:is|no|nr|number)[^A-Za-z0-9]{1,3})?$"
_COUNTED = r"(?i)(?:isbn|version|ver|release|order|invoice|serial|ticket|build|part|page|pages|pp|seite|chapter|section|date|between|from|size|score|line|row|rows|id)[a-z]*[^A-Za-z0-9]{0,3}$"
_UNIT = r"(?i)^[^A-Za-z0-9]{0,2}(?:eur|usd|euros?|dollars?|km|kg|m|cm|mm|gb|mb|ms|percent|prozent|pages|seiten|people|years|jahre|ans|rows|units|%)(?![A-Za-z0-9])"
_DATE = r"^(?:(?:19|20)[0-9]{2}[-. ][0-9]{2}(?:[-. ][0-9]{2})?|[0-9]{2}[-. ][0-9]{2}[-. ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:19|20)?[0-9]{2})$"
_PHONE_FORM = r"^(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ .-][0-9]{2,5}(?:[ .-][0-9]{2,5}){0,4}|\(0[0-9]{1,4}\)[ .-].+)$"
ROUNDS, SHRINK, LEAST_PRECISION, LEAST_SEEN = 30, 0.3, 0.95, 20
#: So many made samples, and matches of a text that one array is built of at a time.
SAMPLES, CHUNK = 6000, 128


def spans(kind: str, pattern: str, hint: str) -> Column:
    """All matches of a pattern in ``text``: kind, start and end in code points, match, and up to 24 characters on either side.

    Arrays are built in chunks, so that the work doesn't grow with the square of a text's matches.
    """
    text = F.col("text")
    match, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    following = F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0)))
    steps = F.filter(F.arrays_zip(match.alias("m"), between.alias("b"), following.alias("f")), lambda s: s["m"].isNotNull())
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("done"), none.alias("out"))

    def add(acc: Column, s: Column) -> Column:
        first = acc["at"] + F.length(s["b"])
        last = first + F.length(s["m"])
        row = F.struct(F.lit(kind).alias("kind"), first.alias("start"), last.alias("end"), s["m"].alias("match"), F.right(s["b"], F.lit(24)).alias("before"), F.left(F.coalesce(s["f"], F.lit("")), F.lit(24)).alias("after"))
        full = F.size(acc["out"]) >= CHUNK
        done = F.when(full, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"])
        return F.struct(last.alias("at"), done.alias("done"), F.when(full, F.array(row)).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    present = F.contains(text, F.lit(hint)) if hint == "@" else F.rlike(text, F.lit(hint))
    every = F.aggregate(steps, start, add, lambda acc: F.concat(F.flatten(acc["done"]), acc["out"]))
    return F.when(present, every).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(s: Column) -> Column:
    """Whether a span of a fixed pattern passes its check."""
    digits = _digits(s["match"])
    n = F.length(digits)
    part = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(s["match"], r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    places = F.sequence(F.lit(1), F.least(n, F.lit(19)))
    at = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    luhn = F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i))) % 10 == 0
    card = F.when((n >= 13) & (n <= 19), luhn).otherwise(False)
    kind = s["kind"]
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise((n >= 9) & (n <= 15))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text and base: the valid spans of the fixed patterns, by kind, then start."""
    every = F.concat(*[spans(k, PATTERNS[k], HINTS[k]) for k in KINDS])
    return docs.select("doc_id", "text").withColumn("base", F.coalesce(F.filter(every, _valid), F.array().cast(_SPAN)))


def _told(s: Column) -> Column:
    """The features of a span as a number's bits."""
    match, digits, kind = s["match"], F.length(_digits(s["match"])), s["kind"]
    facts = [
        kind == "mail", kind == "spelled", kind == "account", F.contains(match, F.lit("(")), F.contains(match, F.lit("-")), F.contains(match, F.lit(".")), F.contains(match, F.lit(" ")),
        (digits >= 7) & (digits <= 12), (digits >= 13) & (digits <= 19), F.regexp_count(match, F.lit("[0-9]+")) >= 3, F.rlike(s["before"], F.lit(_CONTACT)), F.rlike(s["before"], F.lit(_IDENTITY)),
        F.rlike(s["before"], F.lit(_COUNTED)) | F.rlike(s["after"], F.lit(_UNIT)), F.rlike(match, F.lit(_DATE)), F.rlike(match, F.lit(_PHONE_FORM)), F.rlike(match, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        (kind == "mail") & F.rlike(match, F.lit(r"@[^@]*[^.@]\.[A-Za-z]")),
    ]
    bits = F.lit(0)
    for k, fact in enumerate(facts):
        bits = bits + F.when(fact, 1 << k).otherwise(0)
    return bits


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_candidates(base: DataFrame) -> DataFrame:
    """And candidates: kind, start, end, whether they overlap a base span, and the binary features as a number's bits."""
    every = F.concat(*[spans(k, p, _GENERATOR_HINTS[k]) for k, p in GENERATORS.items()])
    # base spans in chunks with the stretch each covers, so that a candidate is held against few of them
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / CHUNK).cast("int")), lambda g: F.slice("base", g * CHUNK + 1, F.lit(CHUNK)))
    tight = F.transform(chunks, lambda c: F.struct(F.array_min(F.transform(c, lambda x: x["start"])).alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end"), c.alias("own")))
    rows = base.withColumn("tight", F.when(F.size("base") > 0, tight))

    def told(s: Column) -> Column:
        overlaps = F.col("tight").isNotNull() & F.coalesce(F.exists("tight", lambda c: _meets(c, s) & F.exists(c["own"], lambda b: _meets(b, s))), F.lit(False))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), overlaps.alias("overlaps"), _told(s).alias("bits"))

    return rows.withColumn("candidates", F.coalesce(F.transform(every, told), F.array().cast("array<struct<kind:string,start:int,end:int,overlaps:boolean,bits:int>>")))


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, feature, values by the features' bits 00, 10, 01, 11), and the threshold."""

    prior: float
    trees: list[tuple[int, int, tuple[float, float, float, float]]]
    threshold: float = math.inf

    def margin(self, bits: int) -> float:
        return self.prior + sum(v[(bits >> a & 1) + 2 * (bits >> b & 1)] for a, b, v in self.trees)

    def expression(self, bits: Column) -> Column:
        """The margin as a SQL expression."""
        on = lambda k: bits.bitwiseAND(F.lit(1 << k)) != 0
        out = F.lit(self.prior)
        for a, b, v in self.trees:
            out = out + F.when(on(a), F.when(on(b), v[3]).otherwise(v[1])).otherwise(F.when(on(b), v[2]).otherwise(v[0]))
        return out


def boosted(table: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> Trees:
    """Fits to rows (features as bits, label, fold, count); fold 0 calibrates, the others train."""
    train = [(b, y, n) for b, y, fold, n in table if fold != 0]
    total, right = sum(n for *_, n in train), sum(n for _, y, n in train if y)
    if not right or right == total:
        return Trees(0.0, [])
    model = Trees(math.log(right / (total - right)), [])
    pairs = [(a, b) for a in range(len(FEATURES)) for b in range(a + 1, len(FEATURES))]
    margins = dict.fromkeys((b for b, _, _ in train), model.prior)
    for _ in range(rounds):
        slopes = []
        for bits, y, n in train:
            p = 1 / (1 + math.exp(-margins[bits]))
            slopes.append((bits, n * (y - p), n * p * (1 - p)))
        best = None
        for a, b in pairs:
            g, h = [0.0] * 4, [1.0] * 4
            for bits, slope, curve in slopes:
                leaf = (bits >> a & 1) + 2 * (bits >> b & 1)
                g[leaf] += slope
                h[leaf] += curve
            gain = sum(x * x / y for x, y in zip(g, h))
            if best is None or gain > best[0]:
                best = gain, a, b, tuple(max(-2.0, min(2.0, SHRINK * x / y)) for x, y in zip(g, h))
        model.trees.append(best[1:])
        margins = {bits: m + best[3][(bits >> best[1] & 1) + 2 * (bits >> best[2] & 1)] for bits, m in margins.items()}
    held = sorted(((model.margin(b), y, n) for b, y, fold, n in table if fold == 0), reverse=True)
    seen = good = 0
    for k, (margin, y, n) in enumerate(held):
        seen, good = seen + n, good + n * y
        if (k + 1 == len(held) or held[k + 1][0] < margin) and seen >= LEAST_SEEN and good >= LEAST_PRECISION * seen:
            model.threshold = margin
    return model


#: Sentences around made samples: those that only personal data or only other numbers stand in, and those of both.
_PERSONAL = ["Please call {} today.", "Tel.: {}", "phone {} or write", "Telefon: {} (abends)", "Handy {}", "You can reach me at {} until five.", "Appelez le {} demain", "T\u00e9l. {}", "mobile: {}", "contact {} for more", "Kontakt: {}", "Fax {}"]
_PAPERS = ["SSN: {}", "her passport {} was", "account number {}", "Konto {}", "IBAN {}", "compte {}", "card no. {}", "social security number is {}"]
_MAILS = ["write to {} soon", "mail: {}", "E-Mail {} (privat)", "contact {} please", "Kontakt: {}"]
_COUNTS = ["version {} is out", "order {} shipped", "invoice {}", "serial {}", "{} EUR in all", "about {} km away", "pages {} of it", "ISBN {}", "from {} on", "score {} at the end", "ticket {} is closed", "{} rows were read", "size {} mm", "build {}", "section {} says"]
_EITHER = ["The entry {} was added.", "and {} too", "{}", "then came {} as well", "Dann kam {} dazu.", "voil\u00e0 {} encore", "({})", "we saw {}, twice"]
_NAMES, _HOSTS = ["anna", "j.smith", "m_weber", "claire92", "lopez"], ["mailbox", "firma", "example", "posteo"]


def made_samples(n: int = SAMPLES, seed: int = 1) -> list[tuple[int, str, int, int]]:
    """(number, text, start, end) of made personal data; start and end are -1 in samples that hold none."""
    rng, out = random.Random(seed), []

    def digits(form: str) -> str:
        return "".join(str(rng.randint(1, 9)) if c == "9" else str(rng.randint(0, 9)) if c == "#" else c for c in form)

    year = lambda: str(rng.randint(1950, 2030))
    two = lambda most: f"{rng.randint(1, most):02d}"
    phones = lambda: digits(rng.choice(["(9##) 9##-####", "9##-9##-####", "9##.9##.####", "9## 9## ####", "09# #######", "09## ## ## ##", "0# ## ## ## ##", "(09#) ### ####", "09##-######"]))
    papers = lambda: digits(rng.choice(["9##-##-####", "9########", "9#########", "9##############"])) if rng.random() < 0.6 else "DE" + digits("## #### #### #### #### ##")
    mails = lambda: rng.choice([f"{rng.choice(_NAMES)} at {rng.choice(_HOSTS)} dot com", f"{rng.choice(_NAMES)} [at] {rng.choice(_HOSTS)} [dot] org", f"{rng.choice(_NAMES)} (at) {rng.choice(_HOSTS)} punkt de", f"{rng.choice(_NAMES)}@{rng.choice(['b\u00fccher', 'm\u00fcller', '\u00e9cole'])}.{rng.choice(['de', 'fr'])}"])
    others = [
        lambda: f"{year()}-{two(12)}-{two(28)}", lambda: f"{two(28)}.{two(12)}.{year()}", lambda: f"{year()}-{two(12)}", lambda: f"{year()}-{year()}", lambda: digits("9#.##"), lambda: digits("9##.##"), lambda: digits("9#.##.##"), lambda: digits("9# ### ###"),
        lambda: digits("9## ###"), lambda: digits("978-9-9#-######-#"), lambda: digits("9##-9##"), lambda: digits("99 99 99 99"), lambda: digits("9#-##"), lambda: digits("1#########"), lambda: digits("9##########"), lambda: digits("9###############"), lambda: digits("9######"),
        lambda: f"{rng.choice(['git', 'root', 'build'])}@{rng.choice(['server', 'localhost', 'node-7'])}", lambda: f"{rng.choice('xyz')}@{rng.randint(1, 9)}", lambda: f"look at {rng.choice(_HOSTS)} dot products",
        lambda: digits("ABX## #### 9#") if rng.random() < 0.5 else digits("9#.9#.9#"),
    ]
    for k in range(n):
        kind = rng.random()
        if kind < 0.25:
            piece, frame = phones(), rng.choice(_PERSONAL if rng.random() < 0.7 else _EITHER)
        elif kind < 0.35:
            piece, frame = papers(), rng.choice(_PAPERS)
        elif kind < 0.45:
            piece, frame = mails(), rng.choice(_MAILS if rng.random() < 0.7 else _EITHER)
        else:
            piece, frame = rng.choice(others)(), rng.choice(_COUNTS if rng.random() < 0.5 else _EITHER)
        text = frame.format(piece)
        at = text.index(piece)
        out.append((k, text, *((at, at + len(piece)) if kind < 0.45 else (-1, -1))))
    return out


def judged_samples(spark: SparkSession, samples: list[tuple[int, str, int, int]]) -> DataFrame:
    """Candidates of made samples: sample, bits, and label, whether they overlap the personal data that the sample holds."""
    shape = "array<struct<doc_id:bigint,text:string,start:int,end:int>>"
    rows = json.dumps([dict(zip(("doc_id", "text", "start", "end"), r)) for r in samples])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(rows), shape)).alias("s")).select("s.*")
    found = with_candidates(with_base(table.select("doc_id", "text"))).select("doc_id", F.explode("candidates").alias("c"))
    joined = found.join(table.select(F.col("doc_id").alias("sample"), "start", "end"), F.col("doc_id") == F.col("sample"))
    return joined.select("sample", "c.bits", ((F.col("c.start") < F.col("end")) & (F.col("start") < F.col("c.end"))).alias("label"))


def fitted(spark: SparkSession, n: int = SAMPLES) -> Trees:
    """Trees of made samples, grouped by feature values; samples whose number is divisible by three calibrate."""
    rows = judged_samples(spark, made_samples(n))
    table = rows.groupBy("bits", "label", F.least(F.col("sample") % 3, F.lit(1)).alias("fold")).agg(F.count("*").alias("n")).collect()
    return boosted(sorted((int(r["bits"]), int(r["label"]), int(r["fold"]), int(r["n"])) for r in table))


def detected(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, text, base, and spans: base and what the trees add, by kind, then start. A null text has none."""
    model = model or fitted(docs.sparkSession)
    rows = with_candidates(with_base(docs))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if math.isinf(model.threshold):
        return rows.select("doc_id", "text", "base", plain.alias("spans"))
    good = F.filter("candidates", lambda c: ~c["overlaps"] & (model.expression(c["bits"]) >= model.threshold))
    # ordered by start, then length; kept where the one before has ended
    good = F.array_sort(F.transform(good, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    shape = "array<struct<kind:string,start:int,end:int>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))
    keep = lambda a, s: F.struct((-s["back"]).alias("at"), F.concat(a["out"], F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end")))).alias("out"))
    added = F.aggregate(good, state, lambda a, s: F.when(s["start"] >= a["at"], keep(a, s)).otherwise(a), lambda a: a["out"])
    return rows.select("doc_id", "text", "base", F.when(F.size("candidates") > 0, F.concat(plain, F.array_sort(added))).otherwise(plain).alias("spans"))


def redacted(docs: DataFrame, model: Trees | None = None, mark: str = "[PII]") -> DataFrame:
    """doc_id and text with every stretch that spans cover replaced by a mark; null texts stay null."""
    found = detected(docs, model)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    between = lambda a, s: F.substring("text", a["at"] + 1, s["start"] - a["at"])
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], between(a, s), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    rest = lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text")))
    return found.select("doc_id", F.when(F.size("spans") > 0, F.aggregate(ordered, state, step, rest)).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(read(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
