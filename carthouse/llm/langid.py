"""Operator 4, language identification of whole, possibly mixed, texts.

A word is a run of letters. The script of its letters narrows the candidate
languages to those seen in that script; the candidates are scored by the log
probabilities of the word's character n-grams; Viterbi with a penalty for every
switch labels the spans of one language. The text's language is the one whose
spans hold most letters, its score their share.

The n-gram counts come from a bounded sample of the labelled rows: the whole
texts of the ``sample_docs`` rows of each language with the smallest hash. A
model holds what each language has seen only, so it takes any number of them.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
a word in a script no learned language uses counts for no language, and a text
of such words alone gets the most frequent learned language with score 0;
without a labelled row nothing is learned and every text is ``und``; ties go
to the language that comes first by code point; repeated rows are predicted
alike; an empty table gives an empty result; ``keep_identified`` carries other
columns through untouched whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carthouse.llm import textops as X
from carthouse.llm.common import bounded_batches, hash_sample, packed, unpacked

UNDETERMINED = "und"
#: Hashed n-grams per order, and the orders.
SLOTS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Log probability lost by every change of language between two words.
SWITCH = 6.0
#: A language is a candidate in a script that holds this share of its sampled letters.
SCRIPT_SHARE = 0.01
#: Labelled rows per language that are learned from.
SAMPLE_DOCS = 1500
#: Texts decoded side by side hold about this many characters, fewer the more languages there are beyond WIDE.
PASS_CHARS = 1 << 20
WIDE = 8
#: Letters whose n-grams are held at once, and weights of n-grams added up at once.
PASS_LETTERS = 1 << 16
PASS_WEIGHTS = 1 << 18

#: The first and last code points of the scripts that are told apart.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"),
    (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"),
    (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"), (0x1100, 0x11FF, "Hangul"), (0x20000, 0x323AF, "Han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(s for _, _, s in SCRIPTS)) + ("other",)

_U = np.uint64
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, its script's number, and its lower-case form."""
    if not _TABLES:
        letter = np.zeros(0x110000, dtype=bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            letter[c] = unicodedata.category(chr(c))[0] == "L"
            small = chr(c).lower()
            if letter[c] and len(small) == 1:
                lower[c] = ord(small)
        script = np.full(0x110000, len(SCRIPT_NAMES) - 1, dtype=np.uint8)
        for a, b, name in SCRIPTS:
            script[a:b + 1] = SCRIPT_NAMES.index(name)
        _TABLES.update(letter=letter, script=script, lower=lower)
    return _TABLES["letter"], _TABLES["script"], _TABLES["lower"]


@dataclass
class Words:
    """The words of some texts: spans in ``points`` (lower case), script, and
    each text's first word and first position."""
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    first: np.ndarray
    edges: np.ndarray


def words_of(texts: list[str]) -> Words:
    points, edges = X.code_points(texts)
    letter, script, lower = _tables()
    starts, ends = X.spans(letter[points])
    return Words(lower[points], starts, ends, script[points[starts]], np.searchsorted(starts, edges), edges)


def stretches(w: Words) -> Iterator[Words]:
    """``w`` in stretches of words that hold about PASS_LETTERS letters each."""
    upto = np.cumsum(w.ends - w.starts)
    a = 0
    while a < len(upto):
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PASS_LETTERS)) + 1
        yield Words(w.points, w.starts[a:b], w.ends[a:b], w.script[a:b], w.first, w.edges)
        a = min(b, len(upto))


def gram_slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams (all orders, a word's edges included) of all words, and the word each belongs to."""
    length = w.ends - w.starts
    n = len(length)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    framed = length + 2  # edge, letters, edge
    begin = np.concatenate(([0], np.cumsum(framed)[:-1]))
    chars = np.zeros(int(framed.sum()), dtype=_U)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    chars[np.repeat(begin + 1, length) + inner] = w.points[np.repeat(w.starts, length) + inner].astype(_U) + _U(1)
    owner = np.repeat(np.arange(n), framed)
    place = np.arange(len(chars)) - np.repeat(begin, framed)
    left = np.repeat(framed, framed) - place
    slots, owners = [], []
    h = np.zeros(len(chars), dtype=_U)
    for k in range(max(ORDERS)):
        h[:len(chars) - k] = h[:len(chars) - k] * _U(0x9E3779B97F4A7C15) + chars[k:] + _U(k + 1)
        if k + 1 not in ORDERS:
            continue
        ok = left > k
        if k == 0:
            ok &= chars > 0
        mixed = X.mix(h[ok])
        slots.append((mixed >> _U(20)).astype(np.int64) % SLOTS + ORDERS.index(k + 1) * SLOTS)
        owners.append(owner[ok])
    return np.concatenate(slots), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    floor: np.ndarray  # orders x languages, log probability of an n-gram never seen
    first: np.ndarray  # the weights of each slot, from .. on; one more closes the last
    language: np.ndarray  # the language of each weight
    weight: np.ndarray  # what its n-gram's log probability exceeds the floor by
    allowed: np.ndarray  # scripts x languages
    common: int  # the most frequent language


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams seen (their slots, and how often), and letters per script, of some texts of one language."""
    grams, letters = np.zeros(SLOTS * len(ORDERS)), np.zeros(len(SCRIPT_NAMES))
    for a, b in X.passes(texts):
        w = words_of(texts[a:b])
        for some in stretches(w):
            grams += np.bincount(gram_slots(some)[0], minlength=len(grams))
        letters += np.bincount(w.script, weights=(w.ends - w.starts), minlength=len(letters))
    seen = np.flatnonzero(grams)
    return seen.astype(np.int32), grams[seen], letters


def learn(counted: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], rows: dict[str, int]) -> Model | None:
    """A model from each language's n-gram and script counts; ``rows`` are its labelled rows. Every n-gram counts half
    a time more than seen."""
    languages = sorted(counted)
    if not languages:
        return None
    letters = np.stack([counted[x][2] for x in languages], axis=1)
    floor = np.empty((len(ORDERS), len(languages)))
    for i, x in enumerate(languages):
        totals = np.bincount(counted[x][0] // SLOTS, weights=counted[x][1], minlength=len(ORDERS))
        floor[:, i] = np.log(0.5 / (totals + 0.5 * SLOTS)) / len(ORDERS)
    slot = np.concatenate([counted[x][0] for x in languages])
    language = np.repeat(np.arange(len(languages), dtype=np.int32), [len(counted[x][0]) for x in languages])
    weight = np.concatenate([np.log(2 * counted[x][1] + 1) / len(ORDERS) for x in languages])
    order = np.argsort(slot, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=SLOTS * len(ORDERS)))))
    share = letters / np.maximum(1, letters.sum(axis=0))
    return Model(languages, floor, first, language[order], weight[order].astype(np.float32),
                 share >= SCRIPT_SHARE, max(range(len(languages)), key=lambda i: (rows.get(languages[i], 0), -i)))


def word_scores(m: Model, w: Words) -> np.ndarray:
    """words x languages; a language that is no candidate in the word's script gets -inf, a word of none zeros."""
    width = len(m.languages)
    if not len(w.starts):
        return np.zeros((0, width), dtype=np.float32)
    h = X.hash_spans(w.points, w.starts, w.ends)
    _, where, back = np.unique(h, return_index=True, return_inverse=True)
    some = Words(w.points, w.starts[where], w.ends[where], w.script[where], w.first, w.edges)
    return np.concatenate([_distinct_scores(m, x) for x in stretches(some)])[back]


def _distinct_scores(m: Model, some: Words) -> np.ndarray:
    """The scores of a stretch of distinct words; what a word gets does not depend on the others."""
    width, words = len(m.languages), len(some.starts)
    slots, owner = gram_slots(some)
    held = np.bincount(owner * len(ORDERS) + slots // SLOTS, minlength=words * len(ORDERS))
    scores = held.reshape(words, len(ORDERS)) @ m.floor
    order = np.argsort(owner, kind="stable")  # so that a part of the n-grams adds to a stretch of the words
    slots, owner = slots[order], owner[order]
    n = m.first[slots + 1] - m.first[slots]
    upto = np.cumsum(n)
    a = 0
    while a < len(slots):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PASS_WEIGHTS, side="right")))
        if b < len(slots):  # whole words, but for one that holds more weights than a pass
            begun = int(np.searchsorted(owner, owner[b]))
            b = begun if begun > a else b
        at = np.arange(int(n[a:b].sum())) + np.repeat(m.first[slots[a:b]] - (upto[a:b] - n[a:b] - (upto[a - 1] if a else 0)), n[a:b])
        lo, hi = owner[a], owner[b - 1] + 1
        cell = np.repeat(owner[a:b] - lo, n[a:b]) * width + m.language[at]
        scores[lo:hi] += np.bincount(cell, weights=m.weight[at], minlength=(hi - lo) * width).reshape(hi - lo, width)
        a = b
    allowed = m.allowed[some.script]
    scores[~allowed] = -np.inf
    scores[~allowed.any(axis=1)] = 0
    return scores.astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The label of each word; texts (words first[i]:first[i + 1]) are decoded side by side."""
    counts = np.diff(first)
    labels = np.zeros(len(scores), dtype=np.int32)
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], first[:-1][order]
    if not len(counts) or not counts[0]:
        return labels
    languages = scores.shape[1]
    number = np.int16 if languages < 1 << 15 else np.int32
    came = np.zeros(scores.shape, dtype=number)
    state = np.zeros((len(counts), languages), dtype=np.float64)
    stay = np.arange(languages, dtype=number)
    live = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # texts with more than t words
    for t in range(int(counts[0])):
        n = live[t]
        at = begin[:n] + t
        s = state[:n]
        if t:
            top = s.argmax(axis=1)
            best = s[np.arange(n), top] - penalty
            switch = best[:, None] > s
            came[at] = np.where(switch, top[:, None].astype(number), stay)
            s = np.where(switch, best[:, None], s)
        state[:n] = s + scores[at]
    now = state.argmax(axis=1)
    for t in range(int(counts[0]) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        labels[at] = now[:n]
        now[:n] = came[at, now[:n]]
    return labels


def predict(m: Model | None, texts: list[str | None], penalty: float = SWITCH, spans: bool = False):
    """(language, score, spans) of each text; spans are (start, end, language) in code points."""
    whole = [t or "" for t in texts]
    for a, b in X.passes(whole, PASS_CHARS * WIDE // max(WIDE, len(m.languages) if m else 0)):
        if m is None:
            yield from ((UNDETERMINED, 0.0, []) for _ in range(a, b))
            continue
        w = words_of(whole[a:b])
        scores = word_scores(m, w)
        labels = viterbi(scores, w.first, penalty)
        length = np.where(m.allowed[w.script].any(axis=1), w.ends - w.starts, 0)
        for i in range(b - a):
            lo, hi = w.first[i], w.first[i + 1]
            held = np.bincount(labels[lo:hi], weights=length[lo:hi], minlength=len(m.languages))
            total = held.sum()
            best = int(held.argmax()) if total else m.common
            marks = _spans(m, w, labels, lo, hi, w.edges[i]) if spans and lo < hi else []
            yield (UNDETERMINED if lo == hi else m.languages[best]), float(held[best] / total) if total else 0.0, marks


def _spans(m: Model, w: Words, labels: np.ndarray, lo: int, hi: int, edge: int) -> list[dict]:
    """Runs of words of one language."""
    cut = np.concatenate(([lo], np.flatnonzero(np.diff(labels[lo:hi])) + lo + 1, [hi]))
    return [{"start": int(w.starts[a] - edge), "end": int(w.ends[b - 1] - edge), "lang": m.languages[labels[a]]}
            for a, b in zip(cut[:-1], cut[1:])]


def fit(df: DataFrame, text_col: str, lang_col: str, id_col: str, use: Column | None = None,
        sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from the rows of ``df`` with a language for which ``use`` holds."""
    known = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = df.where(known if use is None else known & use).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = hash_sample(rows, "lang", "id", counts, sample_docs).select("lang", "text")

    def count(table: pa.Table) -> pa.Table:  # at most sample_docs rows
        slots, times, letters = count_grams(table.column("text").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "slots": [slots.tobytes()], "times": [times.tobytes()],
                         "letters": [letters.tobytes()]})

    got = sample.groupBy("lang").applyInArrow(count, "lang string, slots binary, times binary, letters binary").collect()
    return learn({x["lang"]: (np.frombuffer(x["slots"], np.int32), np.frombuffer(x["times"]), np.frombuffer(x["letters"]))
                  for x in got}, counts)


def _answers(df: DataFrame, model: Model | None, text: Column, others: list[Column], penalty: float, spans: bool) -> DataFrame:
    """``others`` with lang_pred and score (and the labelled spans)."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most SLOTS x ORDERS weights a language, from its bounded sample
    rows = df.select(*others, text.alias("text_to_label"))
    kept = rows.schema.fieldNames()[:-1]
    schema = rows.drop("text_to_label").schema.add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", "array<struct<start:int,end:int,lang:string>>")

    def label(batches):
        m = shared.value
        for b in batches:
            answers = list(predict(m, b.column("text_to_label").to_pylist(), penalty, spans))
            columns = [b.column(c) for c in kept] + [pa.array([x[0] for x in answers], pa.string()),
                                                     pa.array([x[1] for x in answers], pa.float64())]
            if spans:
                columns.append(pa.array([x[2] for x in answers], pa.list_(pa.struct(
                    [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=kept + ["lang_pred", "score"] + ["spans"] * spans)

    return rows.mapInArrow(label, schema)


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = SWITCH, spans: bool = False) -> DataFrame:
    """id_col, lang_pred and score of every row, and its labelled spans when asked for."""
    return _answers(df, model, F.col(text_col), [F.col(id_col)], penalty, spans)


def keep_identified(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is not ``und``, however many languages share its letters."""
    full = packed(df)
    answered = _answers(full, model, F.col("row").getField(text_col), [F.col("row")], SWITCH, False)
    return unpacked(answered.where(F.col("lang_pred") != UNDETERMINED), df.columns)
