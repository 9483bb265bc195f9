"""Operator 2: targets, the flow against brute force, and the mix on edge rows."""

import itertools
import random

from pyspark.sql import functions as F

from carthouse.llm import mixing as M


def test_targets_reshare_what_a_source_cannot_give():
    got = M.targets({"a": 10, "b": 100, "c": 1000}, {"a": 1, "b": 2, "c": 3})
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0}
    assert M.targets({}, {}) == {}
    assert M.targets({"a": 0, "b": 10}, {"a": 5, "b": 1}) == {"a": 0.0, "b": 10.0}


def test_route_reaches_quotas_at_least_cost():
    """All ways to route small whole numbers: none meets more, and none that
    meets as much repeats less."""
    rnd = random.Random(3)
    for _ in range(12):
        names = ["a", "b"]
        patterns = [(p, rnd.randint(0, 2)) for p in (("a",), ("b",), ("a", "b"))]
        quotas = {s: rnd.randint(0, 5) for s in names}
        best = None
        for take in itertools.product(*[range(3 * w + 1) for _, w in patterns]):
            (a, b, ab) = take
            for to_a in range(ab + 1):
                if a + to_a > quotas["a"] or b + ab - to_a > quotas["b"]:
                    continue
                cost = sum(max(0, t - w * r) and min(w, t - w * r) * r for t, (_, w) in zip(take, patterns) for r in range(3))
                best = max(best or (-1, 0), (sum(take), -cost))
        got = M.route(patterns, quotas)
        cost = sum(max(0, t - w * r) and min(w, t - w * r) * r for t, (_, w) in zip(got, patterns) for r in range(3))
        assert (sum(got), -cost) == best


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice("aab"), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pid string")
    plan = M.plan_mix(df, "doc_id", "text", F.col("source"), M.repeating_weights)
    got = {r.id: r.taken for r in M.taken(plan).collect()}
    size = {i: len(t.split()) for i, t, _, _ in rows}
    assert all(got[i] % max(1, size[i]) == 0 and got[i] <= 3 * size[i] for i in got) and len(got) == 600
    for s in "ab":
        assert abs(sum(got[i] for i, _, x, _ in rows if x == s) - plan.targets[s]) <= 2
    again = M.plan_mix(df.repartition(3), "doc_id", "text", F.col("source"), M.repeating_weights)
    assert {r.id: r.taken for r in M.taken(again).collect()} == got
    copies = M.mixed(df, plan, "doc_id", "text", F.col("source"))
    assert copies.columns == df.columns
    n = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert all(n.get(i, 0) * size[i] == got[i] for i in got)


def test_overlapping_sources(spark):
    rows = [(i, "a b c d", ["x"] if i % 3 == 0 else ["y"] if i % 3 == 1 else ["x", "y"]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    plan = M.plan_mix(df, "doc_id", "text", F.col("tags"), lambda s: {"x": 1, "y": 3})
    assert plan.sizes == {"x": 80, "y": 80}
    taken = sum(r.taken for r in M.taken(plan).collect())
    assert abs(taken - sum(plan.targets.values())) <= 6


def test_defined_cases(spark):
    schema = "doc_id long, text string, source string, size int"
    rows = [(1, "a b c", None, 1), (2, None, "x", 1), (None, "q w", None, 1), (2, "", "x", 1), (3, "one", "y", None),
            (3, "one", "y", None)]
    df = spark.createDataFrame(rows, schema)
    plan = M.plan_mix(df, "doc_id", "text", F.col("source"), M.repeating_weights)
    got = sorted(((r.id or 0, r.size, r.source_size, r.taken) for r in M.taken(plan).collect()))
    assert [g[:3] for g in got] == [(0, 2, 5), (1, 3, 5), (2, 0, 0), (2, 0, 0), (3, 1, 2), (3, 1, 2)]
    assert got[4][3] in (0, 1, 2, 3) and got[5][3] in (0, 1, 2, 3)  # repeated rows go one by one
    empty = df.limit(0)
    plan = M.plan_mix(empty, "doc_id", "text", F.col("source"), M.repeating_weights)
    assert M.taken(plan).count() == 0 and M.mixed(empty, plan, "doc_id", "text", F.col("source")).columns == df.columns


def test_repeated_rows_are_taken_one_by_one(spark):
    """400 equal rows among 600 of a source: as many of them as the target asks for, in the plan and in the mix."""
    rows = [(i, " ".join(["w"] * (20 + i % 30)), "a") for i in range(200)] + [(7000, "the same words " * 20, "a")] * 400
    rows += [(10_000 + i, "b " * (10 + i % 7), "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = M.plan_mix(df, "doc_id", "text", F.col("source"), M.repeating_weights)
    got = M.taken(plan).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    size = {i: len(t.split()) for i, t, _ in rows}
    for s, low in (("a", 0), ("b", 10_000)):
        words = sum(r.taken for r in got if (r.id >= 10_000) == (s == "b"))
        assert abs(words - plan.targets[s]) <= 60
    again = M.taken(M.plan_mix(df.repartition(2), "doc_id", "text", F.col("source"), M.repeating_weights)).collect()
    assert sorted((r.id, r.taken) for r in again) == sorted((r.id, r.taken) for r in got)
    copies = M.mixed(df, plan, "doc_id", "text", F.col("source"))
    n = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    for i in size:
        assert n.get(i, 0) * size[i] == sum(r.taken for r in got if r.id == i)
