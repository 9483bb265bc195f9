"""Operator 11: the search against a plain dynamic program, whole results against a recomputation, also in blocks."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from carthouse.llm import repair
from carthouse.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FULL = {"u": "user", "a": "assistant"}


def plan(rows):
    """(cost, audit, repaired lines) by a forward table of (cost, audit, lines) per state."""
    at = {"": (0, "", ())}

    def offer(table, state, label):
        if state not in table or label[:2] < table[state][:2]:
            table[state] = label

    def inserted(table):
        for _ in range(3):
            for state, (c, a, lines) in list(table.items()):
                for r in "ua":
                    if r in STEP[state]:
                        offer(table, r, (c + 5, a + "I", lines + (FULL[r] + ":",)))
        return table

    at = inserted(at)
    for role, text, fault in rows:
        new = {}
        for state, (c, a, lines) in at.items():
            offer(new, state, (c + 2, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            c += 5 if fault == "truncated" else 0
            if role[:1] in STEP[state]:
                offer(new, role[:1], (c, a + "K", lines + (f"{role}:{text}",)))
            for r in "ua":
                if r in STEP[state]:
                    offer(new, r, (c + 1, a + "R", lines + (f"{FULL[r]}:{text}",)))
        at = inserted(new)
    return min(at[s] for s in ("", "a") if s in at)


def brute(damaged, names):
    out = []
    for conv in names:
        rows = sorted((r for r in damaged if r[0] == conv and (r[0] is None) == (conv is None)),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha256(r[3].encode()).hexdigest()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, _, role, text in rows:
            shown = text.strip(SPACE)
            fault = ("blank" if not shown else "duplicate" if (role, text) in seen else
                     "truncated" if shown[-1] not in ".!?" else None)
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = {r[1] for r in rows if r[1] is not None}
        cost, audit, lines = plan(marked)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"],
                    counts["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


TEXTS = ["Fine.", "Yes!", "Really?", "cut off", "", " \t\n", "dots... end.  ", "é日本。", None, "." * 3, "x" * 5000 + "."]


def rows(seed=5, conversations=160):
    rnd = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(rnd.randint(1, 9)):
            if rnd.random() < 0.9:
                role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
                out.append((c, rnd.choice([t, t, t, t - 2, None]), role, rnd.choice(TEXTS) if rnd.random() < 0.5 else f"t{c} {t}."))
    out += [(1000, i, "user" if i % 2 else "assistant", f"line {i}" + ".!?x"[i % 4]) for i in range(700)]  # over several blocks
    out += [(1001, i // 3, ("user", "assistant", "system")[i * i % 3], "again." if i % 5 else f"n{i}") for i in range(600)]
    out += [(2000, 1, "user", "The same row.")] * 900  # a third of all rows: equal
    out += [(None, None, "user", "a."), (None, 3, None, "b."), (None, 4, "assistant", None), (3000, 1, "user", "u" * 300_000)]
    out += [(-c, 9, "user", "lone.") for c in range(1, 60)]  # some lose their only row
    return out


SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int, present string"


def table(spark, data):
    return spark.createDataFrame([(*r, "x", 1, "no") for r in data], SCHEMA)


def test_search_equals_dynamic_program():
    rnd = random.Random(11)
    for _ in range(1500):
        marked = [(rnd.choice(["system", "user", "assistant", "tool"]), "t", rnd.choice([None, None, None, "blank", "truncated"]))
                  for _ in range(rnd.randint(0, 12))]
        symbols = "".join(repair.symbol(r, f == "blank", False, f == "truncated") for r, _, f in marked)
        assert repair.search(symbols) == plan(marked)[:2]


@pytest.mark.parametrize("rows_max", [repair.BLOCK_ROWS, 2])
def test_equals_recomputation(spark, rows_max):
    data = damaged(rows())
    got = repair.repair(table(spark, data).repartition(5), present=None, rows_max=rows_max).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(data, {r[0] for r in data})


def test_many_partitions(spark):
    """Every conversation cut by partition bounds comes out whole."""
    data = damaged(rows(6, 60))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = repair.repair(table(spark, data).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted([tuple(r) for r in got], key=repr) == brute(data, {r[0] for r in data})


def test_query(spark, tmp_path):
    for n, data in enumerate((rows(), [])):
        table(spark, data).write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        got = QUERIES["op11_repair"](spark, f"{tmp_path}/{n}")
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(damaged(data), {r[0] for r in data})
