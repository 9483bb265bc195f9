"""The pipeline's stages, each on the one before, against brute force; and the SQL of the numbered queries."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from carthouse.llm import mixing, queries
from carthouse.llm.common import stage

from test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    columns, seen = docs.columns, []
    for _, apply in P.STAGES:
        docs = stage(apply(spark, docs, SF), "test-stage")
        seen.append(docs.collect())
        if len(seen) < 5:
            assert docs.columns == columns
    language, exact, near, mix, packed = seen
    letters = [r for r in spark.read.parquet(SF + "/documents.parquet").collect() if re.search(r"[^\W\d_]", r.text or "")]
    assert sorted(r.doc_id for r in language) == sorted(r.doc_id for r in letters)
    keys = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in exact]
    assert len(set(keys)) == len(keys) and set(keys) == {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in language}
    want = brute([(r.doc_id, r.text) for r in exact], 5)
    assert sorted(str(r.doc_id) for r in near) == sorted({c for _, _, c in want})
    sizes = Counter()
    for r in near:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    goal = mixing.targets(dict(sizes), mixing.repeating_weights(list(sizes)))
    took = Counter()
    for r in mix:
        took[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for s in sizes:
        largest = max(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in near if r.source == s)
        assert abs(took[s] - goal[s]) <= largest / 2  # a source has about ten documents here
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    pieces = Counter()
    for r in mix:
        ids = t.encode(r.text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            pieces[r.doc_id, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(np.array(ids[k:k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = ", ".join(sorted(df.columns))
    assert Counter(map(tuple, df.select(*sorted(df.columns)).collect())) == Counter(
        con.sql(f"SELECT {cols} FROM ({queries.ORACLE_SQL[name]})").fetchall())
