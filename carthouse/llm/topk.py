"""Operator 10, exact top-k search by distributed histogram selection.

Queries are scored against every row; a histogram of the scores of each query
is summed over all tasks, and the bin that holds its k-th largest score is
refined until little more than k rows lie above its lower edge. One last pass
emits only those rows, and ties go to the smaller id.

Defined cases: vectors that are null, or hold a null or non-finite component,
and rows without an id take no part, neither as query nor as candidate; a
missing trailing component counts as zero; a query never meets rows of its
own id; repeated rows are separate candidates; an empty table gives an empty
result; fewer than k candidates are all returned. Scores are exact: products are
summed as doubles while no score can reach 2**53 (the largest squared norm bounds
them all), else as 64-bit integers; where a score could leave 64 bits an error
says so. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carthouse.llm.common import scratch_path, stage

#: Components become floor(SCALE * x).
SCALE = 1024
#: Histogram bins per query and refinement.
BINS = 256
#: Refinement of a query stops when at most SLACK * k rows lie above its bin's lower edge.
SLACK = 8
#: One block of queries, sent to every task, holds at most this many bytes, and its histograms as many twice over.
BLOCK_BYTES = 16 << 20
#: The largest double below 2**63: no score may be larger.
MOST = 2.0 ** 63 - 1024
#: Cells of the score matrix computed at once.
CELLS = 1 << 21


def int_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part; components are whole numbers."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    whole = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("id"), v.alias("v")))


def _matrix(col: pa.Array, dims: int, kind) -> np.ndarray:
    """A list column as a dense matrix of ``dims`` columns."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    sizes = np.asarray(col.value_lengths())
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=kind)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, n in enumerate(sizes):
        out[i, :min(n, dims)] = flat[at[i]:at[i] + min(n, dims)]
    return out


def _scores(batch: pa.RecordBatch, q: np.ndarray, qid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (row ids, scores rows x queries, whether a score counts: not against a query's own id).

    ``q`` holds doubles or 64-bit integers (see ``exact_top_k``).
    """
    ids = np.asarray(batch.column(0))
    m = _matrix(batch.column(1), q.shape[1], q.dtype)
    step = max(1, CELLS // max(1, len(q)))
    for a in range(0, len(ids), step):
        s = (m[a:a + step] @ q.T).astype(np.int64, copy=False)
        yield ids[a:a + step], s, ids[a:a + step, None] != qid[None, :]


def _blocks(queries: DataFrame, dims: int, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, BLOCK_BYTES of them at a time; each block is one bounded fetch."""
    rows = max(1, min(BLOCK_BYTES // (8 * max(1, dims)), BLOCK_BYTES // (4 * BINS)))
    n = queries.count()
    parts = max(1, -(-n // rows))
    cut = stage(queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), "topk-queries") \
        if parts > 1 else queries.withColumn("part", F.lit(0))
    for p in range(parts):
        got = cut.where(F.col("part") == p).select("id", "v").toArrow()
        if got.num_rows:
            m = _matrix(got.column("v").combine_chunks(), dims, kind)
            order = np.argsort(np.asarray(got.column("id")), kind="stable")
            yield np.asarray(got.column("id"))[order], m[order]


def _distance(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high - low of longs that may lie more than a long apart."""
    return high.astype(np.uint64) - low.astype(np.uint64)


def _select(spark, vectors: DataFrame, q: np.ndarray, qid: np.ndarray, k: int, top: float) -> DataFrame:
    """(query_id, vec_id, score) rows that hold each query's k best."""
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    # No score lies outside; a bound is a little more than the product of the norms, and never more than a long.
    bound = np.minimum(np.ceil(norms * top * (1 + 1e-9)) + 2, MOST).astype(np.int64)
    low, high = -bound, bound
    above = np.zeros(len(q), dtype=np.int64)  # rows over the interval [low, high)
    floor = low.copy()
    open_ = np.ones(len(q), dtype=bool)
    sc = spark.sparkContext
    while open_.any():
        width = _distance(high, low) // np.uint64(BINS) + np.uint64(1)
        at = np.flatnonzero(open_)
        shared = sc.broadcast((q[at], qid[at], low[at], high[at], width[at]))

        def count(batches, shared=shared):
            qs, ids, lo, hi, w = shared.value
            total = np.zeros(len(qs) * BINS, dtype=np.int64)
            base = np.arange(len(qs)) * BINS
            for b in batches:
                for _, s, counts in _scores(b, qs, ids):
                    inside = counts & (s >= lo) & (s < hi)
                    cell = (_distance(np.where(inside, s, lo), lo) // w).astype(np.int64) + base
                    total += np.bincount(cell[inside], minlength=len(total))
            hit = np.flatnonzero(total)
            for a in range(0, len(hit), 1 << 16):
                h = hit[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(h // BINS), pa.array(h % BINS), pa.array(total[h])],
                                                 names=["q", "bin", "n"])

        hist = vectors.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(at), BINS), dtype=np.int64)  # one block of queries, BINS bins each
        got = hist.toArrow()
        counts[np.asarray(got.column("q")), np.asarray(got.column("bin"))] = np.asarray(got.column("n"))
        down = above[at][:, None] + counts[:, ::-1].cumsum(axis=1)  # rows at or over each bin, from the top
        reached = down >= k
        first = np.where(reached.any(axis=1), reached.argmax(axis=1), BINS - 1)
        b = BINS - 1 - first
        over = down[np.arange(len(at)), first]
        step = width.astype(np.int64)
        new_low = low[at] + b * step[at]
        new_high = np.where(_distance(high[at], new_low) < width[at], high[at], new_low + step[at])
        above[at] = over - counts[np.arange(len(at)), b]
        floor[at] = np.where(reached.any(axis=1), new_low, low[at])
        low[at], high[at] = new_low, new_high
        open_[at] = reached.any(axis=1) & (over > SLACK * k) & (width[at] > 1)
        shared.unpersist()
    final = sc.broadcast((q, qid, floor))

    def emit(batches):
        qs, ids, lo = final.value
        for b in batches:
            for rows, s, counts in _scores(b, qs, ids):
                r, c = np.nonzero(counts & (s >= lo))
                if not len(r):
                    continue
                v = s[r, c]
                order = np.lexsort((rows[r], -v, c))  # a block's own k best hold its share of the k best
                r, c, v = r[order], c[order], v[order]
                first = np.concatenate(([0], np.flatnonzero(np.diff(c)) + 1))
                rank = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate((first, [len(c)]))))
                keep = rank < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[c[keep]]), pa.array(rows[r[keep]]), pa.array(v[keep])],
                    names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(emit, "query_id long, vec_id long, score long")


def exact_top_k(df: DataFrame, id_col: str, vec_col: str, k: int, is_query) -> DataFrame:
    """Each query's k highest integer inner products over all rows.

    ``is_query`` is a condition on the column ``id``. Returns query_id, rank
    (from 1), vec_id and score. The queries may grow with the table: they are
    taken in blocks of BLOCK_BYTES, each scored in passes over the table.
    """
    spark = df.sparkSession
    vectors = stage(int_vectors(df, id_col, vec_col), "topk-vectors")
    shape = vectors.agg(F.max(F.size("v")).alias("d"),
                        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s")).first()
    if not shape["d"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if shape["s"] * (1 + 1e-9) + 2 > MOST:
        raise ValueError("vectors too long: an inner product may not fit a long")
    kind = np.float64 if shape["s"] < 2.0 ** 52 else np.int64
    queries, top = vectors.where(is_query).dropDuplicates(["id", "v"]), float(np.sqrt(shape["s"]))
    path, made = scratch_path(spark, "topk-found"), False
    for qid, q in _blocks(queries, int(shape["d"]), kind):
        # Written block by block: the plan does not grow with the queries.
        _select(spark, vectors, q, qid, k, top).write.mode("append").parquet(path)
        made = True
    if not made:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
