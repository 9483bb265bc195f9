"""Operator 13 against a plain recomputation of the whole tree, at several chunk sizes."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from carthouse.llm import merkle
from carthouse.llm.common import numbered
from carthouse.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, idx long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, at=None):
    """The last node, and the sibling lists of node ``at`` on the way."""
    proof = []
    while len(nodes) > 1:
        if at is not None:
            run = nodes[at // 16 * 16:at // 16 * 16 + 16]
            proof += [(run[:at % 16], run[at % 16 + 1:])]
            at //= 16
        nodes = [H(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], proof


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots = [climb([leaf(r) for r in groups[s]])[0] for s in names]
    root = climb(subroots)[0]
    out = []
    for g, s in enumerate(names):
        leaves = [leaf(r) for r in groups[s]]
        upper = climb(subroots, g)[1]
        for i, r in enumerate(groups[s]):
            proof = climb(leaves, i)[1] + upper
            new = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                new = (r[0], lower(r[1]), *r[2:])
            node = leaf(new)
            for left, right in proof:
                node = H(*left, node, *right)
            out.append((r[0], leaves[i], subroots[g], root, H(*(d for a, b in proof for d in a + b)), node, node == root))
    return sorted(out, key=repr)


def rows():
    out = [(i, f"Text {i} of the hot Source", "en", "hot", i) for i in range(700)]
    out += [(5, "the same Row", "en", "copies", 3)] * 600  # a third of the rows: equal
    out += [(1000 + i, f"T{i}", None, f"s{i % 37:02d}", None) for i in range(80)]
    out += [(i, "Exactly sixteen", "de", "sixteen", 1) for i in range(16)]
    out += [(i, "Seventeen", "de", "seventeen", 1) for i in range(17)]
    out += [(None, None, None, None, None), (None, "No Id", "fr", None, 5), (10, "", "", "", 0), (15, "É" + "A" * 100_000, "x", "é", 2),
            (20, "One leaf", "en", "lone", 8), (25, None, "en", "lone two", 8), (25, "lower", "en", "lone two", 8)]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, "x", 7) for r in data], SCHEMA)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equals_a_plain_tree(spark, levels):
    want = brute(rows())
    docs = table(spark, rows()).repartition(5)
    # Operator names must not clash with the table's own grp and idx.
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", tampered,
                                 {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")},
                                 siblings=True, levels=levels).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got],
                  key=repr) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)
    one = next(r for r in got if r.doc_id == 20)  # the proof itself leads from leaf to root
    node = one.leaf
    for s in one.siblings:
        node = H(s.left, node, s.right)
    assert node == one.root and H(*(s.left + s.right for s in one.siblings)) == one.proof_sha256


def test_query_and_small_tables(spark, tmp_path):
    for n, data in enumerate((rows(), [(1, "A", "en", "s", 1)], [])):
        folder = f"{tmp_path}/{n}"
        table(spark, data).write.parquet(f"{folder}/documents.parquet")
        got = QUERIES["op13_merkle"](spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                                           "verified").collect()
        assert sorted([tuple(r) for r in got], key=repr) == (brute(data) if data else [])


def test_nodes_are_numbered_across_partitions(spark):
    """A hot group and equal rows spread over range partitions keep a gapless number."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7))).alias("grp"),
                                      (F.col("id") % 2).alias("id"))
        got = numbered(df.repartition(6), ["grp"], ["id"], "idx", "m").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for r in got:
        groups.setdefault(r.grp, []).append((r.idx, r.id, r.m))
    for nodes in groups.values():
        assert [i for i, _, _ in sorted(nodes)] == list(range(len(nodes))) and {m for _, _, m in nodes} == {len(nodes)}
        assert [k for _, k, _ in sorted(nodes)] == sorted(k for _, k, _ in nodes)
