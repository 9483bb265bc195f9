"""Token ids of whole texts for tokenizers that split texts into words and never merge across them.

A word's ids do not depend on its neighbours, so the distinct words of a batch
are encoded once by the tokenizers library and the ids are gathered by word
hash. Words are found with numpy over code points, by the split rule of the
tokenizer file; texts the rule cannot be trusted on (special tokens written
out, code points unknown to this Python) are encoded whole by the library.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from carthouse.llm import textops as X

#: The split rule this module implements; a file with another one is encoded whole.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SHORT = (("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l"))

#: Distinct words whose ids a worker keeps.
KEEP = 1 << 17

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, by its general category (white space apart)."""
    if not _CLASSES:
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                out[c] = LETTER
            elif kind[0] == "N":
                out[c] = NUMBER
            elif kind[0] == "Z":
                out[c] = SPACE
            elif kind == "Cn":
                out[c] = UNKNOWN
        out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def normal(text: str) -> str:
    """NFC, lower case letter by letter (no final-sigma rule)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class _NotClosed(Exception):
    """The library made more or fewer words than the split rule found."""


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        self.by_word = (steps[0].get("pattern", {}).get("Regex") == RULE and bool(suffix)
                        and (spec.get("normalizer") or {}).get("normalizers") == _NORMAL)
        if self.by_word:
            vocabulary = model["vocab"]
            self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.closes[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.hashes = np.empty(0, dtype=np.uint64)  # sorted; of the words kept
        self.at = np.empty(0, dtype=np.int64)  # where a word's ids start in ``ids``
        self.size = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not self.by_word or any(s in t for s in self.specials):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                plain.append(i)
        made = [normal(texts[i]) for i in plain]
        for a, b in X.passes(made):
            for i, ids in zip(plain[a:b], self._halves([texts[i] for i in plain[a:b]], made[a:b])):
                out[i] = ids
        return out

    def _halves(self, raw: list[str], texts: list[str]) -> list[np.ndarray]:
        """The ids of the texts of one pass; those that hold a word the library
        splits otherwise are found by halving and encoded whole."""
        try:
            return list(self._pass(raw, texts))
        except _NotClosed:
            if len(texts) == 1:
                return [np.array(self.whole.encode(raw[0], add_special_tokens=False).ids, dtype=np.uint32)]
            m = len(texts) // 2
            return self._halves(raw[:m], texts[:m]) + self._halves(raw[m:], texts[m:])

    def _pass(self, raw: list[str], texts: list[str]):
        points, first = X.code_points(texts)
        kind = classes()[points]
        starts, ends = _words(points, kind)
        h = X.hash_spans(points, starts, ends)
        known, where = np.unique(h, return_index=True)
        self._learn(known, starts[where], ends[where], points)
        slot = np.searchsorted(self.hashes, h)
        size = self.size[slot]
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.repeat(self.at[slot] - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, first)]
        odd = np.add.reduceat(kind == UNKNOWN, first[:-1]) if len(texts) else []
        for i in range(len(texts)):
            if odd[i]:
                yield np.array(self.whole.encode(raw[i], add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield flat[bounds[i]:bounds[i + 1]]

    def _learn(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> None:
        """Add the ids of new words; beyond KEEP words only this pass's are held."""
        at = np.searchsorted(self.hashes, h)
        new = np.ones(len(h), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != h[inside]
        n = int(new.sum())
        if not n:
            return
        if len(self.hashes) + n > 2 * KEEP:  # start again from this pass
            self.hashes, self.at, self.size, self.ids = (x[:0] for x in (self.hashes, self.at, self.size, self.ids))
            new[:] = True
            n = len(h)
        # Words joined by blanks: each one's ids end with a token that closes a word.
        length = ends[new] - starts[new]
        place = np.concatenate(([0], np.cumsum(length + 1)))
        joined = np.full(place[-1], 0x20, dtype=np.uint32)
        inner = np.arange(length.sum()) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])), length)
        joined[np.repeat(place[:-1], length) + inner] = points[np.repeat(starts[new], length) + inner]
        text = joined.tobytes().decode("utf-32-le", "surrogatepass")
        ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        stop = np.flatnonzero(self.closes[ids]) + 1
        if len(stop) != n:
            raise _NotClosed
        begin = np.concatenate(([0], stop[:-1]))
        hashes = np.concatenate((self.hashes, h[new]))
        order = np.argsort(hashes, kind="stable")
        self.at = np.concatenate((self.at, begin + len(self.ids)))[order]
        self.size = np.concatenate((self.size, stop - begin))[order]
        self.ids = np.concatenate((self.ids, ids))
        self.hashes = hashes[order]


def _words(points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words by RULE: letter runs, single numbers, runs of others,
    and a short English ending with the apostrophe that opens its run."""
    group = np.where(kind == UNKNOWN, OTHER, kind)
    change = np.empty(len(group), dtype=bool)
    if len(group):
        change[0] = True
        change[1:] = (group[1:] != group[:-1]) | (group[1:] == NUMBER)
    alone = np.flatnonzero((points == 0x27) & change)
    if len(alone):
        alone = alone[alone + 1 < len(points)]
        alone = alone[group[alone + 1] == LETTER]
        for ending in _SHORT:
            hit = alone[alone + len(ending) < len(points)]
            for i, c in enumerate(ending):
                hit = hit[points[hit + 1 + i] == ord(c)]
            change[hit + 1] = False
            after = hit + 1 + len(ending)
            after = after[after < len(points)]
            change[after] |= group[after] == LETTER
    starts = np.flatnonzero(change)
    ends = np.concatenate((starts[1:], [len(points)])).astype(np.int64) if len(starts) else starts
    keep = group[starts] != SPACE
    return starts[keep], ends[keep]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
