"""Operator 8, toxicity by the nearest labelled examples.

Every text becomes a TF-IDF vector over all words of a bounded labelled sample
(document frequencies are counted over all documents). An inverted index of
the sample finds each text's nearest examples by exact cosine; words that most
examples hold are dense rows. A neighbour's vote
weighs its similarity, more the larger the part of it that rests on words that
surely occur more often under label 1, and how many labelled rows an example
stands for. The votes become a probability through an isotonic fit of the
examples' own leave-one-out votes, for which those words are learned from the
other folds; near copies of an example then follow its label. The nearest
examples are returned as evidence.

Sample: per label the ``sample`` labelled ids with the smallest hash. The driver
and every task hold its distinct words and its vectors.

Defined cases: a null, empty or wordless text, and any text without a word of
the sample, scores what such labelled examples average; without labelled rows
every score is 0; an id labelled more than once counts with its largest label,
an id or label that is null is ignored, of texts that share a labelled id the
least is the example; repeated rows are scored alike; ties between examples go
to the smaller id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carthouse.llm import textops as X
from carthouse.llm.common import bounded_batches, hash_sample, stage
from carthouse.llm.langid import words_of

#: Labelled ids per label.
SAMPLE = 4000
#: A word marks label 1 by z^2 / (DOUBT + z^2), z being the z score of its log odds towards it. A vote weighs the
#: similarity times this power of the share of the similarity that marks make up.
DOUBT = 10.0
MARKED = 1.5
#: Folds of near-copy families: an example's own vote uses marks learned from the others.
FOLDS = 5
#: Neighbours, and the weight of the prior against a full vote.
NEIGHBOURS = 400
PRIOR = 0.05
EVIDENCE = 3
#: Words kept as dense rows: those most examples hold. Texts scored over them at once.
HEAD = 400
TOGETHER = 64
#: Near copies: a similarity above ALIKE counts, to this power; the weight of the calibrated vote against an exact copy.
ALIKE = 0.9
SHARPNESS = 4
VOTE = 0.25
#: Answers a task remembers for equal texts.
REMEMBERED = 1 << 12


def word_hashes(texts: list[str | None]):
    """(hashes of the words, first word of each text) pass by pass, as (from, to, hashes, first)."""
    full = [t or "" for t in texts]
    for a, b in X.passes(full):
        w = words_of(full[a:b])
        yield a, b, X.hash_spans(w.points, w.starts, w.ends), w.first


def _owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def vocabulary(sample: DataFrame) -> np.ndarray:
    """The sorted hashes of all words of the sampled texts."""
    def distinct(batches):
        for b in batches:
            for _, _, h, _ in word_hashes(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["word"])

    words = sample.select("text").mapInArrow(distinct, "word long").distinct().toArrow()
    return np.sort(words.column("word").to_numpy().view(np.uint64))


def word_marks(pos: np.ndarray, neg: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """How surely, from 0 to 1, words in ``pos`` and ``neg`` examples of either label mark label 1; all do with one label."""
    if not positives or not negatives:
        return np.ones(len(pos))
    a, b = pos + 0.5, neg + 0.5
    z = np.maximum(0, np.log(a / (positives + 1) / (b / (negatives + 1)))) / np.sqrt(1 / a + 1 / b)
    return z * z / (DOUBT + z * z)


def families(sample: DataFrame) -> dict[int, int]:
    """The family of every sampled text (id, label, text): the smallest id of those of its label that share its least
    three-word shingle hash, as near copies mostly do."""
    def key(batches):
        for b in batches:
            keys = np.zeros(b.num_rows, dtype=np.uint64)
            for lo, hi, h, first in word_hashes(b.column(2).to_pylist()):
                for i in range(hi - lo):
                    w = h[first[i]:first[i + 1]]
                    if len(w):
                        s = X.mix(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7)) if len(w) > 2 else w
                        keys[lo + i] = s.min()
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(keys.view(np.int64))], names=["id", "label", "family"])

    keyed = sample.select("id", "label", "text").mapInArrow(key, "id long, label int, family long")
    least = F.min("id").over(Window.partitionBy("label", "family"))  # of a bounded sample
    return {x["id"]: x["least"] for x in keyed.select("id", least.alias("least")).collect()}


def vectors(df: DataFrame, id_col: str, text_col: str, words: np.ndarray) -> DataFrame:
    """(id, terms, counts): which of ``words`` each whole text holds, and how often."""
    def count(batches):
        width = max(1, len(words))
        for b in batches:
            for lo, hi, h, first in word_hashes(b.column(1).to_pylist()):
                at = np.searchsorted(words, h)
                hit = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == h) if len(words) else np.empty(0, np.int64)
                cells, times = np.unique(_owners(first)[hit] * width + at[hit], return_counts=True)
                cut = pa.array(np.searchsorted(cells, np.arange(hi - lo + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array((cells % width).astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32)))], names=["id", "terms", "counts"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, "id long, terms array<int>, counts array<int>")


def _lists(terms, counts) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of two Arrow list columns without nulls as numpy arrays."""
    t, c = terms.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)
    at, ac = terms.offsets.to_numpy(), counts.offsets.to_numpy()
    return [(t[at[i]:at[i + 1]].astype(np.int64), c[ac[i]:ac[i + 1]].astype(float)) for i in range(len(terms))]


def frequencies(every: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """Rows of ``every``, and how many of them hold each word."""
    def count(batches):
        rows, held = 0, np.zeros(words + 1, dtype=np.int64)
        for b in batches:
            rows += b.num_rows
            held[:words] += np.bincount(b.column(1).flatten().to_numpy(zero_copy_only=False), minlength=words)[:words]
        held[words] = rows  # the last number stands for the rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "n"])

    got = every.select("id", "terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(words + 1)
    held[got.column("term").to_numpy()] = got.column("n").to_numpy()  # at most one row per word
    return int(held[words]), held[:words]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    n = end - begin
    return np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)


@dataclass
class Index:
    """The examples. ``dense`` are words with a row each over all examples;
    the others have postings: the examples that hold them and their weights there."""
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    idf: np.ndarray
    alone: float  # probability of a text without a word of the sample
    base: float  # share of label 1
    steps: tuple[np.ndarray, np.ndarray] | None = None
    row: np.ndarray | None = None  # of each word in dense, or -1
    dense: np.ndarray | None = None
    first: np.ndarray | None = None  # of each word's postings, one more closes the last
    example: np.ndarray | None = None
    value: np.ndarray | None = None
    marks: np.ndarray | None = None  # of every word, learned from all examples

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF weights of a text's terms."""
        v = (1 + np.log(counts)) * self.idf[terms]
        return v / np.sqrt((v * v).sum())

    def post(self, units: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fill the postings with the (terms, weights) of the examples in order."""
        n, width = len(units), len(self.idf)
        term = np.concatenate([t for t, _ in units] or [np.empty(0, np.int64)])
        value = np.concatenate([v for _, v in units] or [np.empty(0)])
        example = np.repeat(np.arange(n), [len(t) for t, _ in units])
        held = np.bincount(term, minlength=width)
        head = np.argsort(-held, kind="stable")[:HEAD]
        self.row = np.full(width, -1)
        self.row[head] = np.arange(len(head))
        self.dense = np.zeros((len(head), n))
        some = self.row[term] >= 0
        self.dense[self.row[term[some]], example[some]] = value[some]
        term, example, value = term[~some], example[~some], value[~some]
        order = np.lexsort((example, term))
        # Of the type bincount counts in: it would copy any other for every text.
        term, self.example, self.value = term[order], example[order].astype(np.intp), value[order]
        self.first = np.searchsorted(term, np.arange(width + 1))

    def head_scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """text x example: the part of the cosine that the dense words make up."""
        q = np.zeros((len(texts), len(self.dense)))
        for i, (terms, v) in enumerate(texts):
            some = self.row[terms] >= 0
            q[i, self.row[terms[some]]] = v[some]
        return q @ self.dense

    def nearest(self, terms: np.ndarray, v: np.ndarray, k: int, but: int = -1, score: np.ndarray | None = None,
                marks: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(examples, similarities) of the k nearest that share a term, exact; ties to the smaller id.

        With ``marks`` also the part of each similarity that marking words make
        up, each by its mark. ``score`` and ``part`` are what the dense words
        give (``head_scores``), where known."""
        n = len(self.ids)
        score = self.head_scores([(terms, v)])[0] if score is None else score
        if but >= 0:
            score[but] = -1e9
        begin, end = self.first[terms], self.first[terms + 1]
        p = _ranges(begin, end)
        example, value = self.example[p], self.value[p]
        score = score + np.bincount(example, weights=np.repeat(v, end - begin) * value, minlength=n)
        least = np.partition(score, n - k)[n - k] if n > k else 0.0
        found = np.flatnonzero((score >= least - 2e-9) & (score > 0))
        similar = np.round(score[found], 9)
        best = np.lexsort((self.ids[found], -similar))[:k]
        best = best[similar[best] > 0]
        if marks is None:
            return found[best], similar[best]
        v = v * marks[terms]
        part = self.head_scores([(terms, v)])[0] if part is None else part
        near = np.zeros(n, dtype=bool)
        near[found[best]] = True
        some = np.flatnonzero(near[example])  # only the neighbours' postings
        part = part + np.bincount(example[some], weights=np.repeat(v, end - begin)[some] * value[some], minlength=n)
        return found[best], similar[best], part[found[best]]

    def vote(self, examples: np.ndarray, similarity: np.ndarray, marked: np.ndarray) -> float:
        w = self.weights[examples] * similarity * (marked / similarity) ** MARKED
        return float(((w * self.labels[examples]).sum() + PRIOR * self.base) / (w.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        return vote if self.steps is None else float(np.interp(vote, *self.steps))

    def probability(self, examples: np.ndarray, similarity: np.ndarray, marked: np.ndarray) -> float:
        """The calibrated vote, and the label of near copies the more alike they are."""
        p = self.calibrated(self.vote(examples, similarity, marked))
        alike = (np.maximum(0, similarity - ALIKE) / (1 - ALIKE)) ** SHARPNESS
        if not alike.any():
            return p
        w = self.weights[examples] * alike
        share, most = float((w * self.labels[examples]).sum() / w.sum()), float(alike.max())
        return (VOTE * p + most * share) / (VOTE + most)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y on x (pool adjacent violators), as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for i in order:
        pools.append([float(y[i]), float(w[i]), float(x[i]), float(x[i])])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return (np.array([v for p in pools for v in (p[2], p[3])]), np.array([p[0] for p in pools for _ in (0, 1)]))


def learn_marks(examples: list[tuple[int, int, np.ndarray, np.ndarray]], family: dict[int, int],
                words: int) -> tuple[np.ndarray, np.ndarray]:
    """(marks, fold of each example): row f of the marks is learned without fold f, the last from all examples.

    A family of near copies counts once and lies in one fold."""
    kin = np.array([family.get(e[0], e[0]) for e in examples], dtype=np.int64)
    fold = (X.mix(kin.view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    held, parts = np.zeros((FOLDS, 2, words), dtype=np.float32), np.zeros((FOLDS, 2), dtype=np.int64)
    for (i, y, terms, _), at, f in zip(examples, kin, fold):
        if i == at:
            held[f, y, terms] += 1
            parts[f, y] += 1
    every, all_parts = held.sum(axis=0), parts.sum(axis=0)
    marks = np.empty((FOLDS + 1, words), dtype=np.float32)
    for f in range(FOLDS + 1):
        h, n = (every - held[f], all_parts - parts[f]) if f < FOLDS else (every, all_parts)
        marks[f] = word_marks(h[1], h[0], n[1], n[0])
    return marks, fold


def build_index(examples: list[tuple[int, int, np.ndarray, np.ndarray]], weight: dict[int, float], idf: np.ndarray,
                k: int = NEIGHBOURS, family: dict[int, int] | None = None) -> Index:
    """Index (id, label, terms, counts) examples; ``weight`` says how many labelled rows one of a label stands for."""
    full = [e for e in examples if len(e[2])]
    every = np.array([weight[e[1]] for e in examples])
    y = np.array([e[1] for e in examples], dtype=float)
    base = float((every * y).sum() / every.sum()) if len(every) else 0.0
    blank = np.array([not len(e[2]) for e in examples], dtype=bool)
    alone = float((every[blank] * y[blank]).sum() / every[blank].sum()) if blank.any() else base
    index = Index(np.empty(0), np.empty(0), np.empty(0), idf, alone, base)
    units = [index.vector(e[2], e[3]) for e in full]
    # Similar examples side by side, by their strongest term: a text's neighbours lie close together.
    order = sorted(range(len(full)), key=lambda i: (int(full[i][2][units[i].argmax()]), -float(units[i].max()), full[i][0]))
    index.post([(full[i][2], units[i]) for i in order])
    index.ids = np.array([full[i][0] for i in order], dtype=np.int64)
    index.labels = np.array([full[i][1] for i in order], dtype=float)
    mean = float(every.mean()) if len(every) else 1.0
    index.weights = np.array([weight[full[i][1]] / mean for i in order])
    marks, fold = learn_marks(full, family or {}, len(idf))
    index.marks = marks[FOLDS]
    if len(full) > 1:
        votes = [index.vote(*index.nearest(full[i][2], units[i], k, but=at, marks=marks[fold[i]])) for at, i in enumerate(order)]
        index.steps = isotonic(np.array(votes), index.labels, index.weights)
    return index


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column | None = None,
        sample: int = SAMPLE) -> tuple[DataFrame, Index]:
    """(vectors of every document, index of the sampled examples). ``use`` picks the label rows to learn from."""
    spark = df.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if use is None else use))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    totals = {x["label"]: x["n"] for x in known.where("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = stage(hash_sample(known.where("label in (0, 1)"), "label", "id", totals, sample).select("id", "label"), "toxic-sample")
    # At most 2 * sample ids.
    texts = stage(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                  .join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "toxic-texts")
    words = vocabulary(texts)
    label = {x["id"]: x["label"] for x in texts.select("id", "label").collect()}
    family = families(texts)
    examples = []
    for b in vectors(texts, "id", "text", words).toArrow().to_batches():
        examples += [(i, label[i], *e) for i, e in zip(b.column(0).to_pylist(), _lists(b.column(1), b.column(2)))]
    examples.sort(key=lambda e: e[0])
    every = stage(vectors(df, id_col, text_col, words), "toxic-vectors")
    rows, frequency = frequencies(every, len(words))
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    sizes = [sum(y == z for z in label.values()) for y in (0, 1)]
    weight = {y: totals[y] / max(1, sizes[y]) for y in totals}
    return every, build_index(examples, weight, idf, family=family)


def scores(every: DataFrame, index: Index, k: int = NEIGHBOURS, threshold: float = 0.7) -> DataFrame:
    """id, score, predicted and evidence (the nearest examples' id, label and similarity) of every document."""
    shared = every.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def score(batches):
        ix = shared.value
        seen: dict = {}

        def answer(near, similar, marked):
            return ix.probability(near, similar, marked), [{"id": int(ix.ids[i]), "label": int(ix.labels[i]), "similarity": float(s)}
                                                   for i, s in zip(near[:EVIDENCE], similar)]

        for b in batches:
            texts = _lists(b.column(1), b.column(2))
            keys = [t.tobytes() + c.tobytes() if len(t) and len(ix.ids) else b"" for t, c in texts]
            if len(seen) > REMEMBERED:
                seen.clear()
            seen[b""] = ix.alone, []
            todo = [i for key, i in dict(zip(keys, range(len(keys)))).items() if key not in seen]
            for a in range(0, len(todo), TOGETHER):
                some = todo[a:a + TOGETHER]
                units = [(texts[i][0], ix.vector(*texts[i])) for i in some]
                parts = ix.head_scores([(t, v * ix.marks[t]) for t, v in units])
                for i, unit, head, part in zip(some, units, ix.head_scores(units), parts):
                    seen[keys[i]] = answer(*ix.nearest(*unit, k, score=head, marks=ix.marks, part=part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([seen[x][0] for x in keys], pa.float64()),
                 pa.array([seen[x][1] for x in keys], pa.list_(pa.struct(
                     [("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())])))],
                names=["id", "score", "evidence"])

    found = every.select("id", "terms", "counts").mapInArrow(
        score, "id long, score double, evidence array<struct<id:long,label:int,similarity:double>>")
    return found.select("id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
