"""Token ids of whole texts by the tokenizers library.

Texts are cut before single spaces and line feeds, where the vocabulary's byte-level pattern always begins a new piece, and
every distinct cut is encoded once per worker; a cut that is one word, or a word and marks after it, goes to the library's
BPE model as those pieces, any other cut to its whole pipeline. That changes no id and saves most of the work. Texts with
runs of white space where a cut could matter, and texts that hold an added token of the vocabulary (such as
``<|endoftext|>``, which the library makes one id), are encoded whole by the library.

Defined cases: null and empty texts have no ids; ids are those of the library with ``add_special_tokens=False``.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np

END_ID = 0
#: A worker keeps so many distinct cuts, of so many characters at most; then it starts anew. That many take about 200 MB.
CACHE, LONGEST_CUT = 900_000, 64
#: White space before a space or line feed: where a run of it is cut could matter.
_RUN = re.compile(r"[^\S\n ][ \n]")
_MARKS = ",.!?;:*#%$&|"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are their own letters, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, the end id appended to each."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cache = self.tokenizer.model, cache
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.end = np.uint32(END_ID).astype("<u4").tobytes()
        (self.line,) = self.ids(["\n"])

    def ids(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in got]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object of ids per text; null counts as empty."""
        collects = gc.isenabled()
        gc.disable()  # the many small objects of this hold no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cuts) > self.cache:
            self.cuts.clear()
        if len(self.starts) > self.cache // 4:
            self.starts.clear()
        plans, whole, new = [], [], set()
        get = self.cuts.get
        for text in texts:
            if not text:
                plans.append(())
            elif any(map(text.__contains__, self.added)) or text[0].isspace() or text[-1] == " " or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or _RUN.search(text):
                plans.append(None)
                whole.append(text)
            else:
                # the text after a line feed; cuts after spaces are held without the space
                cuts = ("\n" + text).replace("\n", " \n").split(" ")
                del cuts[0]
                found = list(map(get, cuts))
                if None in found:
                    new.update([x for x, y in zip(cuts, found) if y is None])
                    plans.append((cuts, None))
                else:
                    plans.append((None, found))
        self._learn(new)
        # cuts of texts without spaces may be whole lines; they serve this slice only
        long = [x for x in new if len(x) > LONGEST_CUT]
        wholes = iter(self.ids(whole))
        out, skip = [], len(self.line)
        for plan in plans:
            if plan is None:
                out.append(next(wholes) + self.end)
            elif not plan:
                out.append(self.end)
            else:
                cuts, found = plan
                out.append((b"".join(map(self.cuts.__getitem__, cuts) if found is None else found) + self.end)[skip:])
        for x in long:
            self.cuts.pop(x, None)
            self.cuts.pop(x.rstrip(_MARKS), None)
            self.starts.pop(x.rstrip(_MARKS)[1:], None)
        return out

    def _learn(self, new: set[str]) -> None:
        """Encodes cuts: those that begin with a line feed as they are, the others with the space before them."""
        cuts, starts, words, firsts, marked, other = self.cuts, self.starts, [], set(), [], []
        inner = set()
        for cut in new:
            if cut.isalpha():
                words.append(cut)
                continue
            core = cut.rstrip(_MARKS)
            if core.isalpha():
                marked.append((cut, core))
                if core not in cuts and core not in new:
                    inner.add(core)
            elif core[:1] == "\n" and core[1:].isalpha():
                marked.append((cut, core))
                if core[1:] not in starts:
                    firsts.add(core[1:])
            else:
                other.append(cut)
        words += inner
        cuts.update(zip(words, self._pieces(words, " ")))
        starts.update(zip(own := list(firsts), self._pieces(own, "")))
        marks = list({cut[len(core) :] for cut, core in marked if len(core) < len(cut)})
        ends = dict(zip(marks, self._pieces(marks, "")), **{"": b""})
        for cut, core in marked:
            base = self.line + starts[core[1:]] if core[0] == "\n" else cuts[core]
            cuts[cut] = base + ends[cut[len(core) :]]
        cuts.update(zip(other, self.ids([x if x[0] == "\n" else " " + x for x in other])))

    def _pieces(self, words: list[str], before: str) -> list[bytes]:
        """Encodes pieces of the pattern, all with the same text before them, by the library's BPE model."""
        tokenize = self.model.tokenize
        line = ("\0" + before).join(["", *words]).encode().decode("latin-1").translate(_LETTERS)
        return [array("I", [t.id for t in tokenize(piece)]).tobytes() for piece in line.split(_LETTERS[0])[1:]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache = cache
    return _encoders[path]
