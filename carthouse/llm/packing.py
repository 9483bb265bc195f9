"""Operator 9, best-fit packing planned on the histogram of lengths.

Texts become token ids once; longer ones are cut into pieces of the capacity.
The driver sees one count per length (never more than the capacity) and runs
best-fit decreasing over counts: runs of equal pieces go into runs of equally
filled sequences, so the plan's size depends on the capacity, not on the
documents. Pieces are then numbered within their length and look their slot up
in the plan.

Defined cases: a null text is empty, its document holds the closing id alone;
repeated rows are packed each on its own; a document of exactly the capacity
is one piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carthouse.llm import wordbpe
from carthouse.llm.common import bounded_batches, numbered, stage

CAPACITY = 4096
#: The id after each document.
CLOSING = 1

_PIECES = "id long, piece int, start long, length long, crc long, ids array<int>"


def cut_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY,
               closing: int = CLOSING, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc[, ids]) of every document's pieces."""
    names = ["id", "piece", "start", "length", "crc"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def cut(batches):
        encode = wordbpe.encoder(tokenizer).encode
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(texts)):
                full = np.empty(len(ids) + 1, dtype="<u4")
                full[:-1], full[-1] = ids, closing
                for i, a in enumerate(range(0, len(full), capacity)):
                    part = full[a:a + capacity]
                    rows.append((doc, i, a, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32))[:len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    kept = _PIECES if keep_ids else _PIECES.rpartition(",")[0]
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, kept)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, first, sequence, per, offset): the pieces of ``length`` from
    rank ``first`` on fill ``per`` places of each sequence from ``sequence``
    on, starting at ``offset``, until the next row of that length.
    """
    room: list[int] = []  # residuals that some sequences have, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # residual: runs of (first sequence, how many)
    plan, next_ = [], 0

    def put(residual: int, first: int, n: int) -> None:
        if n and residual:
            if residual not in runs:
                runs[residual] = []
                insort(room, residual)
            runs[residual].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(room, length)
            if at < len(room):
                residual = room[at]
                first, n = runs[residual].pop()
                if not runs[residual]:
                    del runs[residual], room[at]
            else:
                residual, first, n = capacity, next_, -(-left // (capacity // length))
                next_ += n
            per = residual // length  # a sequence just filled is the best fit for the next equal piece
            full, rest = min(n, left // per), 0
            if full < n:
                rest = left - full * per
            plan.append((length, rank, first, per, capacity - residual))
            put(residual - per * length, first, full)
            if full < n:
                put(residual - rest * length, first + full, 1 if rest else 0)
                begun = full + (1 if rest else 0)
                put(residual, first + begun, n - begun)
            rank += full * per + rest
            left -= full * per + rest
    return plan


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         closing: int = CLOSING, keep_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id and offset of every
    piece, and its ids when asked for."""
    bounded_batches(df.sparkSession)
    pieces = stage(cut_pieces(df, id_col, text_col, tokenizer, capacity, closing, keep_ids), "pack-pieces")
    counts = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sorted(plan_slots(counts, capacity))
    length, first, sequence, per, offset = (np.array(c, dtype=np.int64) for c in zip(*plan)) if plan else [np.empty(0)] * 5
    wide = np.int64(1) << 48  # ranks are below
    key = length * wide + first

    def row_of(lengths: pa.Array, ranks: pa.Array):
        n, r = np.asarray(lengths), np.asarray(ranks)
        at = np.searchsorted(key, n * wide + r, side="right") - 1
        return n, r - first[at], at

    @F.arrow_udf("long")
    def sequence_of(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        _, r, at = row_of(lengths, ranks)
        return pa.array(sequence[at] + r // per[at])

    @F.arrow_udf("long")
    def offset_of(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r, at = row_of(lengths, ranks)
        return pa.array(offset[at] + n * (r % per[at]))

    ranked = numbered(pieces, ["length"], ["id", "piece", "crc"], "rank")
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                         sequence_of("length", "rank").alias("sequence_id"), offset_of("length", "rank").alias("offset"),
                         *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence holds at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
