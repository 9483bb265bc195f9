"""Operator 12 against brute force: shared passages, short items, overlaps, several automata, edge rows."""

import hashlib
import re

import pytest

from carthouse.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(0x41, 0x5B)}


def words(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(UPPER))]


def brute(docs, items, size=10):
    wins = set()
    for item, text in items:
        w = [x for x, _, _ in words(text)]
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.add(("" if item is None else str(item), tuple(w[i:i + size])))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(x for x, _, _ in w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(name)
        spans, run = [], None
        for i in sorted(hit):
            if run is not None and i == run[1] + 1:
                run[1] = i
            else:
                run = [i, i]
                spans.append(run)
        out.append((doc, len(w), len(hit), sorted(names), [(w[a][1], w[b][2]) for a, b in spans]))
    return sorted(out, key=repr)


ITEM = "What is the Capital of the old kingdom, and who ruled it in 1204? Answer: Élan-Vital the Third!"
ITEMS = [(3, ITEM), (21, "one two three"), (100, None), (101, " ... "), (102, ITEM[9:]), (3, "a b c d e f g h i j k l"),
         (None, "nameless item words"), (7, "b c d e f g h i j k l m"), (8, "é è日本 ٣ ß")]
DOCS = [(1, "nothing here at all"), (2, "xx " + ITEM.upper().replace("ÉLAN", "Élan") + " yy"), (3, None), (4, ""),
        (5, "a b c d e f g h i j k l m n a b c d e f g h i j"), (6, "ONE, two... three one two three four"),
        (7, "one two threefold"), (8, "x" * 300_000 + " one-two-three " + "y z " * 50_000), (9, "b c d e f g h i j"),
        (10, "nameless\titem\nwords " + ITEM[20:]), (None, "One two three"), (6, "ONE, two... three one two three four"),
        (11, "é È日本 é è日本 ٣ ß ende"), (12, "\x00one\x7ftwo@three[one]")]
SCHEMA = "doc_id long, text string, items array<string>, n int, row string"


def table(spark, docs):
    return spark.createDataFrame([(i, t, ["x"], 1, "r") for i, t in docs], SCHEMA)


@pytest.mark.parametrize("part_chars", [decontam.PART_CHARS, 150])
def test_equals_brute_force(spark, part_chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_leaks(table(spark, DOCS).repartition(3), items, part_chars=part_chars).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.items), [(s.start, s.end) for s in r.spans]) for r in got],
                  key=repr) == brute(DOCS, ITEMS)
    clean = decontam.drop_leaks(table(spark, DOCS), items, part_chars=part_chars)
    assert clean.columns == ["doc_id", "text", "items", "n", "row"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d[0] for d in brute(DOCS, ITEMS) if not d[2])


def test_many_rows_of_one_passage(spark):
    docs = [(i, f"copy {i % 2} " + ITEM) for i in range(400)] + [(1000 + i, f"own text {i}") for i in range(400)]
    got = decontam.find_leaks(table(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.items), [(s.start, s.end) for s in r.spans]) for r in got],
                  key=repr) == brute(docs, ITEMS)


def test_empty_tables(spark):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(table(spark, []), items).count() == 0
    assert {(r.n_hit, len(r.items)) for r in decontam.find_leaks(table(spark, DOCS), none).collect()} == {(0, 0)}


def test_query_digest(spark, tmp_path):
    from carthouse.llm.queries import QUERIES
    table(spark, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op12_decontamination"](spark, str(tmp_path)).collect()
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i, _ in brute(DOCS, ITEMS)]
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)
