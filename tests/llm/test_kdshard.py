"""Operator 5: near equal bytes, gapless slots, equal texts together, hot groups, defined cases."""

import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from carthouse.llm import kdshard

SCHEMA = "doc_id long, text string, source string, shard int, node string"


def dims():
    return {"source": kdshard.category(F.col("source")), "n": F.length("text"), "id": F.col("doc_id")}


def check(rows, got, shards):
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r[1])
    slots = defaultdict(list)
    for r in got:
        assert any(r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
                   for t in by_id[r.doc_id])
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_equal_and_equal_texts_together(spark):
    rnd = random.Random(4)
    rows = [(i, "w" * rnd.randint(1, 400) + str(i // 2), rnd.choice(["a", "a", "b", None]), 1, "x") for i in range(4000)]
    rows += [(10_000 + i, "hot text " * 20, "a", 1, "x") for i in range(2000)]  # a third of all rows
    got = kdshard.kd_shards(spark.createDataFrame(rows, SCHEMA), 8, dims()).collect()
    check(rows, got, 8)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    text, where = {r[0]: r[1] for r in rows}, defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if not t.startswith("hot")) and len(where["hot text " * 20]) > 1


def test_defined_cases(spark):
    rows = [(1, None, None, None, None), (2, "", "a", 1, "x"), (None, "no id", "a", 1, "x"), (3, "é" * 100_000, "b", 1, "x"),
            (4, "twice", "a", 1, "x"), (4, "twice", "a", 1, "x")]
    check(rows, kdshard.kd_shards(spark.createDataFrame(rows, SCHEMA), 3, dims()).collect(), 3)
    assert kdshard.kd_shards(spark.createDataFrame([], SCHEMA), 3, dims()).count() == 0
    one = kdshard.kd_shards(spark.createDataFrame(rows[:1], SCHEMA), 40, dims())
    assert one.count() == 1


def test_pairs_of_a_small_table_stay_together(spark):
    """A group is split by its bytes only: two rows of a few hundred are no hot group, nor are many short copies."""
    rnd = random.Random(5)
    rows = [(i, "w" * rnd.randint(50, 90) + str(i // 2), rnd.choice("abc"), 1, "x") for i in range(400)]
    rows += [(1000 + i, f"long {i} " * 4000, "a", 1, "x") for i in range(40)]
    rows += [(2000 + i, "short", "b", 1, "x") for i in range(60)]  # an eighth of the rows, well below 1/16 of a shard
    got = kdshard.kd_shards(spark.createDataFrame(rows, SCHEMA), 4, dims()).collect()
    check(rows, got, 4)
    text, where = {r[0]: r[1] for r in rows}, defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


def sizes(got, shards):
    out = [0] * shards
    for r in got:
        out[r.shard] += r.size
    return out


def test_repeated_rows_are_dealt_like_others(spark):
    """A third of the rows are one row again and again, above a shard together: no shard takes them all."""
    rnd = random.Random(6)
    rows = [(i, "w" * rnd.randint(1, 200) + str(i), "a", 1, "x") for i in range(4000)] + [(7, "hot text " * 12, "a", 1, "x")] * 2000
    got = kdshard.kd_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), 8, dims()).collect()
    check(rows, got, 8)
    held = sizes(got, 8)
    assert max(held) < 1.03 * sum(held) / 8 and min(held) > 0.97 * sum(held) / 8


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Groups of 0.1 to 0.9 of a shard each, and single documents as large: all whole, shards near equal all the same."""
    rnd = random.Random(7)
    rows = [(i, "w" * rnd.randint(1, 300) + str(i), rnd.choice("ab"), 1, "x") for i in range(6000)]
    share = sum(len(t) + 16 for _, t, *_ in rows) * 2 / 8
    for g, part in enumerate((0.9, 0.7, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)):
        n = rnd.randint(2, 60)
        rows += [(10_000 + 100 * g + i, f"group {g} " + "g" * int(part * share / n - 24), "a", 1, "x") for i in range(n)]
    rows += [(20_000 + i, "d" * int(0.25 * share) + str(i), "b", 1, "x") for i in range(12)]
    got = kdshard.kd_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), 8, dims()).collect()
    check(rows, got, 8)
    text, where = {r[0]: r[1] for r in rows}, defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    held = sizes(got, 8)
    assert max(held) < 1.03 * sum(held) / 8 and min(held) > 0.97 * sum(held) / 8
