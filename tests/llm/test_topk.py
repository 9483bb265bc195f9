"""Operator 10 against brute force: ties, hot vectors, invalid vectors, blocks of queries."""

import math
import random

from pyspark.sql import functions as F

from carthouse.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id string, score int"


def brute(rows, k):
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e, *_ in rows
         if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = {}
    for qi, q in v:
        if qi % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in v if ci != qi)[:k]
            out[qi] = [(r + 1, ci, -x) for r, (x, ci) in enumerate(s)]
    return out


def vectors(n, dims=6):
    rnd = random.Random(5)
    f32 = lambda x: __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]
    hot = [f32(rnd.uniform(-1, 1)) for _ in range(dims)]
    rows = [(i, hot if i % 3 == 0 else [f32(rnd.uniform(-1, 1)) for _ in range(dims)], "x", i) for i in range(n)]
    rows += [(n, None, None, None), (n + 1, [1.0, None], None, None), (n + 2, [float("nan")] * dims, None, None),
             (n + 3, [float("inf")] * dims, None, None), (None, hot, None, None)]
    return rows


def got(df, k):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_equals_brute_force_with_ties(spark):
    rows = vectors(400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(topk.exact_top_k(df, "vec_id", "embedding", 7, F.col("id") % 10 == 0), 7) == brute(rows, 7)


def test_blocks_of_queries_and_fewer_candidates_than_k(spark, monkeypatch):
    rows = vectors(25)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 48)  # one query a block
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(topk.exact_top_k(df, "vec_id", "embedding", 40, F.col("id") % 10 == 0), 40) == brute(rows, 40)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(df, "vec_id", "embedding", 3, F.col("id") % 10 == 0).count() == 0


def test_large_components_are_exact(spark):
    """Components near 1e6: scores near 2**62, of which doubles would lose the last digits."""
    rnd = random.Random(8)
    near = [(i, [1e6 - rnd.randint(0, 40) / 1024 for _ in range(6)]) for i in range(300)]
    mixed = [(300 + i, [rnd.uniform(-1e6, 1e6) for _ in range(rnd.randint(1, 6))]) for i in range(100)]
    pad = lambda e: e + [0.0] * (6 - len(e))
    df = spark.createDataFrame(near + mixed, "vec_id long, embedding array<double>").repartition(4)
    want = brute([(i, pad(e)) for i, e in near + mixed], 10)
    assert max(s for r in want.values() for _, _, s in r) > 2 ** 62
    assert got(topk.exact_top_k(df, "vec_id", "embedding", 10, F.col("id") % 10 == 0), 10) == want


def test_scores_beyond_a_long_are_refused(spark):
    import pytest
    df = spark.createDataFrame([(0, [1e9]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="may not fit a long"):
        topk.exact_top_k(df, "vec_id", "embedding", 10, F.col("id") % 10 == 0)


def test_repeated_ids_with_other_vectors(spark):
    rnd = random.Random(9)
    rows = [(i // 3, [rnd.randint(-9, 9) / 8 for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in topk.exact_top_k(df, "vec_id", "embedding", 5, F.col("id") % 10 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score))
    for qid, best in found.items():  # an id's vectors are queried together
        scores = [sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(q, c))
                  for i, q in rows if i == qid for j, c in rows if j != qid]
        assert [s for _, s in sorted(best)] == sorted(scores, reverse=True)[:5]
