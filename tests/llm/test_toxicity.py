"""Operator 8: exact neighbours against brute force, the isotonic fit, quality on held-out rows, defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from carthouse.llm import toxicity as T
from carthouse.llm.common import crc32_text

SF = "/root/testdata/sf0.1"


def test_block_max_search_equals_all_cosines():
    rnd = np.random.default_rng(3)
    idf = 1 + rnd.random(12)
    examples = []
    for i in range(500):
        terms = np.sort(rnd.choice(12, rnd.integers(0, 5), replace=False)).astype(np.int64)
        examples.append((i * 3, int(rnd.random() < 0.4), terms, rnd.integers(1, 4, len(terms)).astype(float)))
    index = T.build_index(examples, {0: 2.0, 1: 1.0}, idf, 9)
    full = {e[0]: e for e in examples}
    for _ in range(40):
        terms = np.sort(rnd.choice(12, rnd.integers(1, 5), replace=False)).astype(np.int64)
        v = index.vector(terms, rnd.integers(1, 4, len(terms)).astype(float))
        near, similar = index.nearest(terms, v, 9)
        q = np.zeros(12)
        q[terms] = v
        want = []
        for i, e in full.items():
            if len(e[2]):
                x = np.zeros(12)
                x[e[2]] = index.vector(e[2], e[3])
                s = round(float(x @ q), 9)
                if s > 0:
                    want.append((-s, i))
        assert [(-s, int(index.ids[n])) for s, n in zip(similar, near)] == sorted(want)[:9]


def test_isotonic_fit_is_monotone_and_pools():
    x, y = T.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert list(x) == [1, 1, 2, 3, 4, 4] and list(y) == [0, 0, 0.5, 0.5, 1, 1]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = crc32_text(F.col("doc_id")) % 3 == 1
    every, index = T.fit(docs, labels, "doc_id", "text", "toxic", ~held)
    got = T.scores(every, index).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where(held)
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_defined_cases(spark):
    rnd = random.Random(6)
    words = lambda: " ".join(rnd.choice("sea walk tree hill road lake wind door lamp book".split()) for _ in range(12))
    rows = [(i, words() + (" Nitwit, " if i % 2 else " ") + words(), "x", 0.5) for i in range(200)]
    rows += [(500, None, None, None), (501, "", "x", 1.0), (502, "12 34", "x", 1.0), (None, "nitwit", "x", 1.0),
             (503, "nitwit " * 30_000, "x", 1.0), (504, "Nitwit!", "x", 1.0), (504, "Nitwit!", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    marks = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(3, 0, 1), (None, 1, 1), (500, None, 1), (900, 1, 1)],
                                  "doc_id long, toxic int, quality int")
    every, index = T.fit(docs, marks, "doc_id", "text", "toxic")
    got = T.scores(every, index).collect()
    assert len(got) == len(rows)
    score = {r.id: (r.score, r.predicted) for r in got}
    assert all(score[i][1] == i % 2 for i in range(200))
    assert score[503][1] == 1 and score[504][1] == 1 and score[None][1] == 1
    assert score[500] == score[501] == score[502] and score[500][1] == 0
    evidence = next(r.evidence for r in got if r.id == 504)
    assert evidence and all(e.label == 1 for e in evidence)
    # No labels, one label, no rows.
    every, index = T.fit(docs, marks.limit(0), "doc_id", "text", "toxic")
    assert {r.score for r in T.scores(every, index).collect()} == {0.0}
    every, index = T.fit(docs, marks.where("toxic = 1"), "doc_id", "text", "toxic")
    assert {r.score for r in T.scores(every, index).collect()} == {1.0}
    every, index = T.fit(docs.limit(0), marks, "doc_id", "text", "toxic")
    assert T.scores(every, index).count() == 0


def _fresh(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(7)) for _ in range(n))


def test_a_rare_copy_finds_its_example(spark):
    """Words of one example only, and no word that marks a label: the copy of the example is found."""
    rnd = random.Random(8)
    common = "sea walk tree hill road lake wind door lamp book".split()
    rows = [(i, _fresh(rnd, 12) + " " + " ".join(rnd.choice(common) for _ in range(8)) + (" nitwit" if i % 2 and i > 20 else ""))
            for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(1, 21)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    every, index = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), marks, "doc_id", "text", "toxic")
    got = {r.id: r for r in T.scores(every, index).collect()}
    for i in range(1, 21):
        r = got[1000 + i]
        assert r.evidence[0].id == i and abs(r.evidence[0].similarity - 1) < 1e-6 and r.predicted == i % 2
    assert all(r.evidence for r in got.values())


def test_ten_examples_a_label(spark):
    """No bar that depends on the sample's size: what is learned from few examples is used."""
    rnd = random.Random(9)
    rows = [(i, _fresh(rnd, 10) + (" you nitwit " if i < 10 else " kind friend ") + _fresh(rnd, 10)) for i in range(20)]
    rows += [(100 + i, t) for i, t in rows] + [(200, _fresh(rnd, 10) + " you nitwit"), (201, _fresh(rnd, 10) + " kind friend")]
    marks = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, toxic int")
    every, index = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), marks, "doc_id", "text", "toxic")
    score = {r.id: r.score for r in T.scores(every, index).collect()}
    assert all(score[100 + i] > 0.8 for i in range(10)) and all(score[100 + i] < 0.2 for i in range(10, 20))
    assert score[200] > 0.7 and score[201] < 0.3


def test_scores_equal_brute_force(spark):
    """Whole result: plain TF-IDF cosines of all pairs, marks, votes, calibration and near copies in dense matrices."""
    rnd = random.Random(12)
    common = "sea walk tree hill road lake wind door lamp book".split()
    rows = [(i, " ".join([rnd.choice(common) for _ in range(rnd.randint(1, 9))] + _fresh(rnd, 2).split() +
                         ["nitwit"] * (i % 3 == 0 and rnd.random() < 0.8))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, "zzz"), (301, None)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    every, index = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), marks, "doc_id", "text", "toxic")
    got = {r.id: r for r in T.scores(every, index, k=20).collect()}
    text = {i: (t or "").split() for i, t in rows}
    words = sorted({w for i in range(120) for w in text[i]})
    count = np.array([[text[i].count(w) for w in words] for i in text], dtype=float)
    idf = np.log((1 + len(text)) / (1 + (count > 0).sum(axis=0))) + 1
    v = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    y = np.array([int(i % 3 == 0) for i in range(120)])
    kin = T.families(spark.createDataFrame([(i, int(y[i]), rows[i][1]) for i in range(120)], "id long, label int, text string"))
    alone = np.array([kin[i] == i for i in range(120)])  # a family counts once
    held = np.array([(count[:120][alone & (y == c)] > 0).sum(axis=0) for c in (0, 1)])
    mark = T.word_marks(held[1], held[0], (alone & (y == 1)).sum(), (alone & (y == 0)).sum())
    cosine, part = v @ v[:120].T, (v * mark) @ v[:120].T
    base = y.mean()
    for at, i in enumerate(text):
        near = [e for e in sorted(range(120), key=lambda e: (-round(cosine[at, e], 9), e)) if cosine[at, e] > 1e-9][:20]
        assert [(e.id, round(e.similarity, 6)) for e in got[i].evidence] == [(e, round(cosine[at, e], 6)) for e in near[:3]]
        if not near:
            assert got[i].score == base
            continue
        s = cosine[at, near]
        w = s * (part[at, near] / s) ** T.MARKED
        p = index.calibrated(((w * y[near]).sum() + T.PRIOR * base) / (w.sum() + T.PRIOR))
        alike = (np.maximum(0, s - T.ALIKE) / (1 - T.ALIKE)) ** T.SHARPNESS
        if alike.any():
            p = (T.VOTE * p + alike.max() * (alike * y[near]).sum() / alike.sum()) / (T.VOTE + alike.max())
        assert abs(got[i].score - p) < 1e-4, (i, got[i].score, p)


def test_a_posting_is_met_once_and_counted_without_a_copy():
    """Bounds of blocks skipped next to nothing here and cost more than the postings; bincount copies other types."""
    index = T.Index(np.arange(3), np.ones(3), np.ones(3), np.ones(500), 0.5, 0.5)
    index.post([(np.arange(i, 500, 2), np.full(len(range(i, 500, 2)), 0.1)) for i in (0, 1, 0)])
    assert index.example.dtype == np.intp and index.dense.shape == (400, 3)
    assert index.first[-1] == len(index.example) == 100 and len(index.first) == 501
