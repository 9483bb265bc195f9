"""Operator 6, near-duplicate detection by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum, so
half as many hash evaluations fill the same number of bands. Texts with the
same shingle set are one node. In every bucket of a band the members are
compared, on their full sets, with two centres: one chosen by a hash (another
one in every band) and the member that shares most buckets with others. Nodes
joined by shared buckets are a family; where a family then still has several
components, every member outside its largest one is compared with the others
of like size, block by block and on full sets. No cap drops a candidate.

Two sets with Jaccard similarity J share a band with probability 1 - (1 -
J**ROWS)**BANDS or a little more; at J = 0.8 that misses fewer than one pair
in a million.

Defined cases: a null text and a text without words have no shingles, are
linked with nothing and are their own component; a text of fewer words than a
shingle has its whole sequence as its only one; a null id comes after all
others; repeated rows (same id, same text) are one node; an empty table gives
an empty result; ``drop_near_copies`` carries other columns through untouched
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carthouse.llm import textops as X
from carthouse.llm.common import bounded_batches, join_by_class, packed, stage, unpacked
from carthouse.llm.components import components, merged

SHINGLE = 5
SIMILARITY = 80  # per cent
#: Two permutations make a band: their minima and maxima.
ROWS, BANDS = 4, 32
PERMUTATIONS = ROWS * BANDS // 2
#: Exhaustive comparison: expected residents of a block, and visitors at once; columns of one matrix product.
BLOCK = 512
COLUMNS = 4096

_U = np.uint64
_MULTIPLIERS = X.mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_C1, _C2 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of a text's shingles of k words, sorted."""
    n = len(words)
    if n == 0:
        return words
    if n < k:  # the whole sequence; its length tells it from longer ones
        h = np.full(1, n, dtype=_U)
        for w in words:
            h = X.mix(h * _C1 + w)
        return h
    h = words[:n - k + 1]
    for i in range(1, k):
        h = h * _C1 + words[i:n - k + 1 + i]
    return np.unique(X.mix(h ^ _C2))


def text_sets(texts: list[str | None], k: int):
    """The shingle set of each text, in order."""
    full = [t or "" for t in texts]
    for a, b in X.passes(full):
        words, first = X.space_words(full[a:b])
        for i in range(b - a):
            yield shingles(words[first[i]:first[i + 1]], k)


def signature(s: np.ndarray) -> np.ndarray:
    """min, max, min, max, ... under each permutation, 32 bits each."""
    low = np.full(PERMUTATIONS, ~_U(0))
    high = np.zeros(PERMUTATIONS, dtype=_U)
    for a in range(0, len(s), 2048):
        m = _MULTIPLIERS[:, None] * s[None, a:a + 2048]
        np.minimum(low, m.min(axis=1), out=low)
        np.maximum(high, m.max(axis=1), out=high)
    out = np.empty(2 * PERMUTATIONS, dtype=_U)
    out[0::2], out[1::2] = low, high
    return (X.mix(out) & _U(0xFFFFFFFF)).astype(np.uint32)


_SKETCH = "id long, row long, n long, node binary, sig binary"


def _sketches(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per row: id, row (a hash of id and text), set size, node (digest of the set) and signature."""
    def sketch(batches):
        for b in batches:
            sizes, nodes, sigs = [], [], []
            for s in text_sets(b.column(2).to_pylist(), k):
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(sigs, pa.binary())], names=["id", "row", "n", "node", "sig"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row"),
                     F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, _SKETCH)


def row_key(id_col, text):
    return F.xxhash64(id_col, text, F.length(text))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(band, key, node) for every node and band."""
    def bands(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32).reshape(b.num_rows, BANDS, ROWS)
            key = np.zeros((b.num_rows, BANDS), dtype=_U)
            for i in range(ROWS):
                key = X.mix(key * _C1 + sig[:, :, i].astype(_U) + _U(1))
            band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
            node = b.column("node").take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(key.reshape(-1).view(np.int64)), node],
                                             names=["band", "key", "node"])

    return nodes.select("node", "sig").mapInArrow(bands, "band int, key long, node binary")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def check(batches):
        held: OrderedDict = OrderedDict()  # sets of the last few centres
        for b in batches:
            a_nodes, b_nodes = b.column("a").to_pylist(), b.column("b").to_pylist()
            missing = {}
            for node, text in zip(a_nodes, b.column("a_text")):
                if node not in held and node not in missing:
                    missing[node] = text.as_py()
            held.update(zip(missing, text_sets(list(missing.values()), k)))
            good = []
            for i, s in enumerate(text_sets(b.column("b_text").to_pylist(), k)):
                t = held[a_nodes[i]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= similarity * (len(s) + len(t) - both):
                    good.append(i)
            while len(held) > 16:
                held.popitem(last=False)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(good, pa.int64())),
                                              b.column("b").take(pa.array(good, pa.int64()))], names=["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(check, "a binary, b binary")


def _texts(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted node."""
    keys = nodes.join(wanted, "node", "left_semi").select("node", F.col("pick").alias("row"))
    rows = df.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return stage(rows.join(keys, "row").dropDuplicates(["node"]), "near-texts")


def _crossing(members: DataFrame, family: DataFrame, labels: DataFrame, texts: DataFrame, total: int, k: int,
              similarity: int) -> DataFrame:
    """The links between different components of a family (nodes joined by shared buckets), on full sets.

    Members are dealt into size classes (similar sets differ in size by less
    than a class) and blocks; a member outside the family's largest component
    visits the blocks of its own and the adjacent classes. What the largest
    component holds is never compared with itself, and tasks emit links only."""
    tagged = stage(members.join(family.withColumnRenamed("label", "family"), "node").join(labels, "node", "left").select(
        "node", "n", "family", F.coalesce("label", "node").alias("label")), "near-tagged")
    shares = tagged.groupBy("family", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = stage(shares.groupBy("family").agg(F.sum("m").alias("size"), F.max(F.struct("m", "label")).alias("main"))
                  .where(F.col("main.m") < F.col("size")).select("family", "size", F.col("main.label").alias("main")), "near-mixed")
    step = float(np.log(100 / similarity)) * 1.0001  # a little wider: rounding must not part similar sets
    own = stage(join_by_class(tagged, mixed, "family", "size", total).select(
        "family", "node", "label", (F.col("label") != F.col("main")).alias("other"),
        F.floor(F.log("n") / F.lit(step)).cast("int").alias("class")), "near-own-class")
    goes = own.where("other").select("family", "node", "label", F.explode(F.array(
        F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    blocks = own.groupBy("family", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
                                                F.count(F.lit(1)).alias("residents"))
    chunks = goes.groupBy("family", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"),
                                                 F.count(F.lit(1)).alias("visitors"))
    cells = stage(blocks.join(chunks, ["family", "class"]).withColumn("cell", F.xxhash64("family", "class")), "near-cells")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    at, chunk = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    keyed = lambda df: stage(df.select("node", "label", F.xxhash64("family", "class").alias("cell")), "near-keyed")
    stays = join_by_class(keyed(own), cells.select("cell", "blocks", "chunks", "residents"), "cell", "residents", total).select(
        "cell", "node", "label", F.lit(False).alias("visits"), at.cast("int").alias("i"), every("chunks").alias("j"))
    visits = join_by_class(keyed(goes), cells.select("cell", "blocks", "chunks", "visitors"), "cell", "visitors", total).select(
        "cell", "node", "label", F.lit(True).alias("visits"), every("blocks").alias("i"), chunk.cast("int").alias("j"))
    columns = ("cell", "i", "j", "visits", "node", "label", "set")

    def compare(batches):
        group, rows = None, []
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in columns]):
                if r[:3] != group:
                    yield from _links(rows, similarity)
                    group, rows = r[:3], []
                rows.append(r[3:])
        yield from _links(rows, similarity)

    met = stays.unionByName(visits).join(_sets(texts, k), "node")
    tasks = met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "visits", "node")
    return tasks.select(*columns).mapInArrow(compare, "a binary, b binary").distinct()


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, set): the shingle hashes of the texts."""
    def sets(batches):
        for b in batches:
            made = [s.tobytes() for s in text_sets(b.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(sets, "node binary, set binary")


def _links(rows: list[tuple], similarity: int):
    """The links of residents and visitors (rows: visits, node, label, set; residents first)."""
    first = sum(not r[0] for r in rows)
    if not first or first == len(rows):
        return
    sets = [np.frombuffer(r[3], dtype=_U) for r in rows]
    size = np.array([len(s) for s in sets])
    numbers = {x: i for i, x in enumerate(dict.fromkeys(r[2] for r in rows))}
    label = np.array([numbers[r[2]] for r in rows])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), size)
    both = np.zeros((first, len(rows) - first), dtype=np.float64)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for a in range(0, int(word[-1]) + 1, COLUMNS):  # shared shingles, some columns of the incidence matrix at a time
        lo, hi = np.searchsorted(word, (a, a + COLUMNS))
        m = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        m[owner[lo:hi], word[lo:hi] - a] = 1
        both += m[:first] @ m[first:].T
    union = size[:first, None] + size[None, first:] - both
    i, j = np.nonzero((100 * both >= similarity * union) & (label[:first, None] != label[None, first:]))
    if len(i):
        pairs = [sorted((rows[x][1], rows[first + y][1])) for x, y in zip(i, j)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()),
                                          pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                similarity: int = SIMILARITY) -> DataFrame:
    """Per input row: id, row (its key), n_shingles, component_id (the smallest
    id of its component; null only if all are) and pick (the row that stays)."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = stage(_sketches(df, id_col, text_col, k), "near-sketches")
    some = rows.where(F.col("node").isNotNull())
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))
    # One row per distinct set: partial aggregation, so copies in thousands are no skew.
    nodes = stage(some.groupBy("node").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"),
                                           F.min("sig").alias("sig"), F.min("n").alias("n"))
                  .select("node", F.col("f.id").alias("id"), F.col("f.row").alias("pick"), "copies", "sig", "n"), "near-nodes")
    total = nodes.count()
    all_ = stage(_buckets(nodes), "near-buckets") if total else None
    if total:
        sizes = stage(all_.groupBy("band", "key").agg(
            F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("band", "node"), F.col("node"))).alias("c"),
            F.min("node").alias("first")).where("size > 1")
            .select("band", "key", "size", F.col("c.node").alias("centre"), "first"), "near-sizes")
        keyed = all_.withColumn("bucket", F.xxhash64("band", "key"))
        known = sizes.select(F.xxhash64("band", "key").alias("bucket"), "size", "centre", "first")
        members = stage(join_by_class(keyed, known, "bucket", "size", total * BANDS), "near-members")
        shared = members.groupBy("node").agg(F.sum("size").alias("shared"))
        ranked = members.select("bucket", "size", "node").join(shared, "node")
        hubs = stage(ranked.groupBy("bucket").agg(F.max(F.struct("shared", "node")).alias("h"), F.first("size").alias("size"))
                     .select("bucket", "size", F.col("h.node").alias("hub")), "near-hubs")
        met = join_by_class(members.drop("size"), hubs, "bucket", "size", total * BANDS)
        ends = F.explode(F.array("centre", "hub")).alias("end")
        pairs = stage(met.select("node", ends).where(F.col("node") != F.col("end")).select(
            F.greatest("node", "end").alias("b"), F.least("node", "end").alias("a")).distinct(), "near-pairs")
        texts = _texts(df, id_col, text_col, nodes, members.select("node").distinct())
        links = stage(_confirm(pairs, texts, k, similarity), "near-links")
        labels = components(links)
        # A bucket's members hang on its first node, which most buckets of a family have in common.
        family = components(members.select(F.col("first").alias("a"), F.col("node").alias("b")))
        found = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n")
        labels = merged(labels, _crossing(found, family, labels, texts, total, k, similarity))
        own = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        own = nodes.withColumn("label", F.col("node"))
    own = stage(own.select("node", "label", "id", "pick", "copies"), "near-own")
    best = own.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("pick"))).alias("f"),
                                    F.count(F.lit(1)).alias("size"))
    best = stage(best.select("label", "size", F.col("f.id").alias("component_id"), F.col("f.pick").alias("stays")), "near-best")
    final = stage(join_by_class(own.select("node", "label", "copies"), best, "label", "size", total)
                  .select("node", "copies", "component_id", "stays"), "near-final")
    slim = rows.select("id", "row", "n", "node")
    linked = join_by_class(slim, final, "node", "copies", rows.count()).select("id", "row", "n", "component_id", "stays")
    alone = slim.where(F.col("node").isNull()).select("id", "row", "n", F.col("id").alias("component_id"), F.col("row").alias("stays"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "row", F.col("n").alias("n_shingles"),
                                            "component_id", (F.col("row") == F.col("stays")).alias("stays"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                     similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay, one of every component, with all their columns."""
    stay = near_groups(df, id_col, text_col, k, similarity).where("stays").select("row").withColumnRenamed("row", "key")
    field = F.col("row").getField
    full = packed(df).withColumn("key", row_key(field(id_col), field(text_col)))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))  # repeated rows; no further shuffle
    return unpacked(full.join(stay, "key", "left_semi").select("row", nth.alias("nth")).where("nth = 1"), df.columns)
