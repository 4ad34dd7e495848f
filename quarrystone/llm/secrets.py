"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over printable ASCII are fitted from labelled samples: random strings (label 1) and identifiers
(label 0). In every maximal run of key characters the stretch with the largest sum of log-likelihood ratios over a threshold
per character is found; it is a secret if it is long enough and its mean ratio is over the threshold, so a key inside a long
path or assignment isn't averaged away. What is left on either side is searched again. The models are fitted to three
quarters of the samples, the threshold is set from the last quarter. Fixed patterns stay whatever the models say.

Labelled samples of the query: as many random strings as identifiers, made from hashes in the usual key alphabets;
identifiers are words of a bounded sample of the documents, taken from hash-chosen places of the whole texts and joined as
code joins them.

Defined cases: a null or empty text has no spans; a text is scanned whole, whatever its length; repeated rows give repeated
results; an empty table gives an empty result, with models of the made samples alone; other columns pass through, except
those named as an added one, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import append_columns, read

_A = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
#: Candidates of the models: stretches of key characters of at least so many.
MIN_RUN = 20
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "markov")
#: So many documents, about, give identifiers, from so many places of each; so many random strings are made.
SAMPLE_DOCS, SAMPLE_PLACES, SAMPLE_STRINGS = 2000, 20, 4000
_WORD = re.compile(r"[A-Za-z]{2,24}")
_SHIFT, _SIZE = 32, 96


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, each kind leftmost and without overlaps: (kind, start, end)."""
    out = []
    if _HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in _A.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _pairs(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8).astype(np.int64)
    codes = np.clip(codes - _SHIFT, 0, _SIZE - 1)
    return np.concatenate([[0], codes[:-1]]) * _SIZE + codes


class MarkovRatio:
    """The log-likelihood ratio of two character Markov models, with a threshold per character."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold

    @classmethod
    def fit(cls, samples: list[tuple[str, int]], smoothing: float = 0.1) -> MarkovRatio:
        """Every fourth sample of a label sets the threshold, the others the models."""
        counts, held = np.full((2, _SIZE * _SIZE), smoothing), ([], [])
        for label in (0, 1):
            for k, text in enumerate(t for t, y in samples if y == label and t):
                if k % 4 == 3:
                    held[label].append(text)
                else:
                    np.add.at(counts[label], _pairs(text), 1)
        logs = np.log(counts.reshape(2, _SIZE, _SIZE) / counts.reshape(2, _SIZE, _SIZE).sum(2, keepdims=True))
        model = cls((logs[1] - logs[0]).ravel(), 0.0)
        scores = [np.array([model.score(t) for t in own if len(t) >= MIN_RUN]) for own in held]
        # between all but one in a thousand identifiers and all but one in a hundred random strings
        low = np.quantile(scores[0], 0.999) if len(scores[0]) else 0.0
        high = np.quantile(scores[1], 0.01) if len(scores[1]) else low
        model.threshold = float(max(0.0, (low + high) / 2 if high > low else low))
        return model

    def score(self, text: str) -> float:
        """Log-likelihood ratio per character."""
        return float(self.ratio[_pairs(text)].sum() / max(1, len(text)))

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """The stretches of a run that are secrets, best first: (start, end)."""
        over = self.ratio[_pairs(run)] - self.threshold
        out, left = [], [(0, len(run))]
        while left:
            a, b = left.pop()
            if b - a < MIN_RUN:
                continue
            total = np.concatenate([[0.0], np.cumsum(over[a:b])])
            low = np.minimum.accumulate(total)
            end = int((total - low).argmax())
            start = int(total[: end + 1].argmin())
            if total[end] - total[start] <= 0:
                continue
            if end - start >= MIN_RUN:
                out.append((a + start, a + end))
            left += [(a, a + start), (a + end, b)]
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return [("markov", m.start() + a, m.start() + b) for m in _RUN.finditer(text) for a, b in self.stretches(m.group())]


def random_strings(n: int = SAMPLE_STRINGS) -> list[str]:
    """Strings of the usual key alphabets, made from hashes: hexadecimal, base 64 (both forms), base 32, letters and digits."""
    out = []
    for k in range(n):
        raw = hashlib.sha256(str(k).encode()).digest()
        length = 20 + raw[0] % 20
        kind = k % 5
        if kind == 0:
            text = raw.hex()
        elif kind == 1:
            text = base64.b64encode(raw).decode().rstrip("=")
        elif kind == 2:
            text = base64.urlsafe_b64encode(raw).decode().rstrip("=")
        elif kind == 3:
            text = base64.b32encode(raw).decode().rstrip("=")
        else:
            text = re.sub("[^A-Za-z0-9]", "", base64.b64encode(raw).decode())
        out.append(text[:length])
    return out


def identifiers(places: list[str]) -> list[str]:
    """Words of places (four words each) singly, and joined as identifiers are: snake, camel and kebab case, paths."""
    out = []
    for k, place in enumerate(places):
        words = _WORD.findall(place)
        out += words
        if len(words) >= 4:
            a, b, c, d = words[:4]
            forms = (f"{a}_{b}_{c}_{d}", a + b.capitalize() + c.capitalize() + d.capitalize(), f"{a}-{b}-{c}-{d}", f"{a}/{b}/{c}_{k % 100}", f"{a.upper()}_{b.upper()}_{c.upper()}", (a + b + c + d).lower())
            out += [forms[k % len(forms)], forms[(k + 1) % len(forms)]]
    return out


def fillers() -> list[str]:
    """Rulers and padding: one key character over and over, which is no secret either; four times, as one in four is held out."""
    return [chr(c) * 400 for c in range(0x21, 0x7F) if _RUN.fullmatch(chr(c) * MIN_RUN) for _ in range(4)]


def sample_places(docs: DataFrame, n: int = SAMPLE_DOCS, places: int = SAMPLE_PLACES) -> list[str]:
    """Four words each from ``places`` hash-chosen places of about n whole texts, chosen by a hash of the row; at most 4 * n
    texts. A bounded sample for fitting."""
    share = min(1.0, n / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").limit(4 * n)

    def kernel(texts):
        out = []
        for text in texts:
            words = _WORD.findall(text or "")
            last = max(1, len(words) - 3)
            at = {int.from_bytes(hashlib.sha256(f"{len(words)}:{k}".encode()).digest()[:8], "big") % last for k in range(places)}
            out.append([" ".join(words[a : a + 4]) for a in sorted(at)])
        return {"places_": out}

    found = append_columns(picked, kernel, T.StructType([T.StructField("places_", T.ArrayType(T.StringType()))])).select("places_").collect()
    return [p for r in sorted(r[0] for r in found) for p in r if p]


def fitted(docs: DataFrame) -> MarkovRatio:
    """Models of made random strings and of the documents' identifiers."""
    return MarkovRatio.fit([(t, 1) for t in random_strings()] + [(t, 0) for t in identifiers(sample_places(docs)) + fillers()])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scanned(docs: DataFrame, model: MarkovRatio) -> DataFrame:
    """``docs`` with secret_spans (array of kind, start, end in code points, end exclusive, in order)."""

    def kernel(texts):
        rows = [in_order(base_spans(t) + model.spans(t)) if t else [] for t in texts]
        return {"secret_spans": [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in rows]}

    return append_columns(docs, kernel, T.StructType([T.StructField("secret_spans", T.ArrayType(_SPAN))]))


def redacted_text(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: MarkovRatio | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; n_chars, where there is one, follows the text."""
    model = model or fitted(docs)
    columns = docs.columns

    def kernel(texts):
        return {"text_": [redacted_text(t, base_spans(t) + model.spans(t)) if t else t for t in texts]}

    done = append_columns(docs, kernel, T.StructType([T.StructField("text_", T.StringType())]))
    changed = {"text": F.col("text_"), "n_chars": F.when(F.col("text").eqNullSafe(F.col("text_")), F.col("n_chars")).otherwise(F.length("text_").cast("long"))} if "n_chars" in columns else {"text": F.col("text_")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scanned(docs, fitted(docs)).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
