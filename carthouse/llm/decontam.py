"""Operator 12, benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z
are lower-cased) joined by single spaces. A benchmark item gives a window for
every ten consecutive words, or one window of all its words when it has fewer.
The distinct windows form one automaton, broadcast to the tasks; every document
is normalised and scanned once, whole, and matches are mapped back to words and
to code point offsets of the original text. No document is shuffled.

The broadcast is bounded: windows of more than ``part_chars`` characters
together are dealt by their hash into several automata, and the documents pass
through them one after the other (staged between passes), keeping the union of
their hits. Results do not depend on the number of passes.

Defined cases: a null or wordless document has no words and is clean; an item
without words has no window; items are told apart by item_id as text (repeated
rows of one id are one item, a null id reads as the empty text); an empty
benchmark leaves every document clean; repeated documents are scanned each;
other columns, whatever their names, do not take part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carthouse.llm.common import packed, stage, unpacked
from carthouse.llm.textops import spans

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Characters of the windows in one automaton (about 60 bytes of memory each in a worker).
PART_CHARS = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
              for b in range(256))
_FOUND = "n_words long, n_hit long, items array<string>, runs array<struct<first:int,last:int>>, " \
         "spans array<struct<start:int,end:int>>"
_AUTOMATA: dict = {}


def windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: ``words`` joined by spaces, ``n`` words, ``items`` holding them."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    split = items.select(name.alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = split.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), size).alias("w"))
    return (each.groupBy(F.array_join("w", " ").alias("words")).agg(
        F.first(F.size("w")).alias("n"), F.sort_array(F.collect_set("item")).alias("items")))


def _automaton(name: str, patterns: list):
    """The automaton of a broadcast list of windows, built once per worker."""
    import ahocorasick

    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for i, (words, _, _) in enumerate(patterns):
            # UTF-8 bytes as characters, closed by spaces so that only whole words match.
            made.add_word(f" {words} ".encode().decode("latin-1"), i)
        if len(made):
            made.make_automaton()
        _AUTOMATA[name] = made if len(made) else None
    return _AUTOMATA[name]


def _hits(raw: bytes, automaton, patterns, runs, items):
    """Words, and of a document with hits: hit words, items, runs of hit words, their spans in code points."""
    folded = raw.translate(_FOLD)
    words = folded.split()
    ends, which = [], set()
    if automaton is not None and words:
        line = b" " + b" ".join(words) + b" "
        for end, i in automaton.iter(line.decode("latin-1")):
            ends.append((end, patterns[i][1]))
            which.add(i)
    if not ends and not runs:
        return len(words), 0, items, [], []
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for run in runs:
        covered[run["first"]] += 1
        covered[run["last"] + 1] -= 1
    if ends:
        blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
        last = np.searchsorted(blanks, [e for e, _ in ends])  # the blank after word k is number k + 1
        np.add.at(covered, last - [n for _, n in ends], 1)
        np.add.at(covered, last, -1)
    hit = np.cumsum(covered[:-1]) > 0
    first, after = spans(hit)
    starts, stops = spans(np.frombuffer(folded, dtype=np.uint8) != 0x20)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    items = sorted(set(items).union(*(patterns[i][2] for i in which)))
    return (len(words), int(hit.sum()), items,
            [{"first": int(a), "last": int(b) - 1} for a, b in zip(first, after)],
            [{"start": int(points[starts[a]]), "end": int(points[stops[b - 1]])} for a, b in zip(first, after)])


def _scan(batches: Iterator[pa.RecordBatch], name: str, broadcast, schema: pa.Schema,
          keep: list[str]) -> Iterator[pa.RecordBatch]:
    patterns = broadcast.value
    automaton = _automaton(name, patterns)
    for batch in batches:
        texts = batch.column("text_bytes")
        before = zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist())
        found = [_hits(t.as_py() or b"", automaton, patterns, runs, items) for t, (runs, items) in zip(texts, before)]
        new = list(zip(*found)) or [()] * 5
        names = ["n_words", "n_hit", "items", "runs", "spans"]
        columns = {n: pa.array(list(v), type=schema.field(n).type) for n, v in zip(names, new)}
        yield pa.RecordBatch.from_arrays([batch.column(n) if n in keep else columns[n] for n in schema.names],
                                         schema=pa.schema([batch.schema.field(n) if n in keep else schema.field(n)
                                                           for n in schema.names]))


def _annotated(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, carry: list[str],
               size: int, part_chars: int) -> DataFrame:
    """``row`` (the carried columns) with what the scan finds."""
    spark = docs.sparkSession
    made = stage(windows(items, item_col, item_text_col, size), "decontam-windows")
    chars = made.agg(F.sum(F.length("words") + 2)).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    rows = packed(docs.select(*[F.col(f"`{c}`") for c in carry])).schema["row"].dataType.simpleString()
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text_bytes"),
        F.array().cast("array<struct<first:int,last:int>>").alias("runs"), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        # One automaton's windows: bounded by part_chars.
        mine = made.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        broadcast = spark.sparkContext.broadcast([(r.words, r.n, list(r.items)) for r in mine.collect()])
        keep = ["row"] if part == parts - 1 else ["row", "text_bytes"]
        kept = f"row {rows}" + ("" if part == parts - 1 else ", text_bytes binary")
        fields = pa.schema([pa.field(n, pa.null()) for n in keep] + [
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
            ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        found = found.mapInArrow(partial(_scan, name=uuid.uuid4().hex, broadcast=broadcast, schema=fields, keep=keep),
                                 f"{kept}, {_FOUND}")
        if part < parts - 1:
            found = stage(found, "decontam-pass")
    return found


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
               part_chars: int = PART_CHARS) -> DataFrame:
    """One row per document: id_col, n_words, n_hit (words inside a window), items (ids whose windows occur, sorted),
    spans (start and end, in code points, of each run of hit words)."""
    found = _annotated(docs, items, text_col, item_col, item_text_col, [id_col], size, part_chars)
    return found.select(F.col("row").getField(id_col).alias(id_col), "n_words", "n_hit", "items", "spans")


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", size: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found = _annotated(docs, items, text_col, item_col, item_text_col, docs.columns, size, part_chars)
    return unpacked(found.where(F.col("n_hit") == 0), docs.columns)
