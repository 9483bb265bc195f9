"""Operator 6 against brute force on families of near copies, and its parts."""

import random

import numpy as np

from carthouse.llm import minhash, textops
from carthouse.llm.components import components, merged

SCHEMA = "doc_id long, text string, node string, label int, n string"


def sets(text, k):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k):
    made = [sets(r[1], k) for r in rows]
    near = list(range(len(rows)))

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(made[i] & made[j])
            if made[i] and made[j] and 100 * both >= 80 * (len(made[i]) + len(made[j]) - both):
                near[find(i)] = find(j)
    order = lambda x: (x is None, x or 0)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r[0]), r[0], key=order)
    return sorted((str(r[0]), len(made[i]), str(best[find(i)])) for i, r in enumerate(rows))


def families():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for f in range(12):
        base = [word() for _ in range(120)]
        for c in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, 9)):  # links, and many pairs just below them
                copy[rnd.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy), "x", 1, None))
            n += 1
    return rows


def test_components_equal_brute_force(spark):
    rows = families()
    got = minhash.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), k=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4)


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "x", 1, "y"), (2, "", "x", 1, "y"), (3, " \t\n", None, None, None), (4, "one two", "x", 1, "y"),
            (5, "ONE\ttwo", "x", 1, "y"), (6, "one two three four", "x", 1, "y"), (7, "one two three four five", "x", 1, "y"),
            (8, long, "x", 1, "y"), (9, long + " end", "x", 1, "y"), (None, "one two", "x", 1, "y"),
            (10, "again and again and again", "x", 1, "y"), (10, "again and again and again", "x", 1, "y"),
            (11, "Été été", "x", 1, "y"), (12, "été été", "x", 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = minhash.near_groups(df, k=4)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute(rows, 4)
    kept = minhash.drop_near_copies(df, k=4)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 10, 11, 12]
    empty = df.limit(0)
    assert minhash.near_groups(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = ["alpha beta " + "x" * 50 + " gamma", "", "beta alpha"]
    want, first = textops.space_words(texts)
    assert list(first) == [0, 4, 4, 6] and want[0] == want[5] and want[1] == want[4]
    monkeypatch.setattr(textops, "_BLOCK", 16)
    textops._POWERS.clear()
    got, _ = textops.space_words(texts)
    textops._POWERS.clear()
    assert (got == want).all()


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 62, 1000, dtype=np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])
    agree = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(agree - 0.8) < 0.15


def test_components_and_later_links(spark):
    pair = lambda *p: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in p], "a binary, b binary")
    chain = components(pair(*[(i, i + 1) for i in range(1, 40)], (50, 51)))
    assert {bytes(r.node)[0]: bytes(r.label)[0] for r in chain.collect()} == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50}
    more = merged(chain, pair((40, 51), (60, 61)))
    assert {bytes(r.node)[0]: bytes(r.label)[0] for r in more.collect()} == {
        **{i: 1 for i in range(1, 41)}, 50: 1, 51: 1, 60: 60, 61: 60}
