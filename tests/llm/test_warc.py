"""Operator 1: exact round trip, determinism, rolling, commit after a crash, defined cases."""

import hashlib
import os

import pytest

from pyspark.sql import functions as F

from carthouse.llm import warc

SCHEMA = "page_id long, url string, html string, shard string, kind int"
BIG = "é" * 600  # 1200 bytes

ROWS = [
    (1, "http://a.test/1", BIG, "x", 1), (5, "http://a.test/5", BIG, None, None), (3, None, BIG, "x", 0),
    (2, "http://a.test/two words\r\nX: y", "short", "x", 1), (4, "http://a.test/4", "short", "x", 1),
    (6, "http://a.test/6", None, "x", 1), (7, "http://a.test/7", "", "x", 1), (None, "http://a.test/n", BIG, "x", 1),
    (5, "http://a.test/5", BIG, None, None), (8, "http://a.test/8", "z" * 300_000, None, 2),
]


def digest(text):
    return hashlib.sha1((text or "").encode()).hexdigest()


def test_round_trip_with_nulls_copies_and_clashing_columns(spark, scratch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    warc.write_warc(df, os.path.join(scratch, "w"))
    got = warc.read_warc(spark, os.path.join(scratch, "w")).collect()
    by_id = sorted(((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)
                    for r in got), key=str)
    big = digest(BIG)
    want = [(1, "revisit", 5, 1200, big), (3, "revisit", 5, 1200, big), (-1, "revisit", 5, 1200, big),
            (5, "response", None, 1200, big), (5, "revisit", 5, 1200, big),
            (2, "response", None, 5, digest("short")), (4, "response", None, 5, digest("short")),
            (6, "response", None, 0, digest("")), (7, "response", None, 0, digest("")),
            (8, "response", None, 300_000, digest("z" * 300_000))]
    assert by_id == sorted(want, key=str)
    bodies = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None and r.page_id is not None}
    assert bodies == {5: BIG, 2: "short", 4: "short", 6: "", 7: "", 8: "z" * 300_000}
    urls = {r.page_id: r.url for r in got}
    assert urls[3] is None and urls[2] == "http://a.test/two%20words%0D%0AX:%20y"


def test_same_rows_give_the_same_files_whatever_their_order(spark, scratch):
    sums = []
    for name, parts in (("a", 1), ("b", 3)):
        df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
        m = warc.write_warc(df, os.path.join(scratch, name), shard_bytes=1 << 16, roll_bytes=400)
        sums.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in m.collect()))
        for r in m.collect():
            data = open(os.path.join(scratch, name, r.name), "rb").read()
            assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_commit_can_be_repeated_and_stray_files_are_ignored(spark, scratch):
    root = "file://" + os.path.join(scratch, "w")
    m = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), root).collect()
    folder = os.path.join(scratch, "w")
    os.rename(os.path.join(folder, m[0].name), os.path.join(folder, m[0].temporary))  # as before the rename
    open(os.path.join(folder, ".pages-000000-00009.warc.gz.x.tmp"), "wb").write(b"left by a lost task")
    warc.commit(spark, root)
    warc.commit(spark, root)
    assert warc.read_warc(spark, root, payload=False).count() == len(ROWS)


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.write_warc(df, os.path.join(scratch, "w")).count() == 0
    assert warc.read_warc(spark, os.path.join(scratch, "w")).count() == 0


def test_a_damaged_record_is_found():
    data = warc.page_record(1, "http://a.test", b"x" * 50, hashlib.sha1(b"x" * 50).digest(), None)
    assert [f["warc-type"] for f, _ in warc.records(data)] == ["response"]
    import gzip
    broken = gzip.compress(gzip.decompress(data).replace(b"xxx", b"xyx", 1), mtime=0)
    with pytest.raises(ValueError):
        list(warc.records(broken))


def test_a_missing_or_altered_archive_fails_the_read(spark, scratch):
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"),
                                 F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))
    for n, damage in enumerate((os.remove, lambda f: open(f, "ab").write(b"x"), lambda f: open(f, "r+b").write(b"\x00"))):
        root = os.path.join(scratch, f"w{n}")
        warc.write_warc(df, root, shard_bytes=20_000)
        files = sorted(f for f in os.listdir(root) if f.endswith(".warc.gz"))
        assert len(files) > 5 and warc.read_warc(spark, root).count() == 300
        damage(os.path.join(root, files[3]))
        with pytest.raises(Exception, match="not the archive of the manifest|FileNotFound|No such file"):
            warc.read_warc(spark, root).collect()


def test_rows_without_an_id_and_repeated_ids_fill_no_shard(spark, scratch):
    """A third of the rows have no id, a third one id: every shard keeps to its bytes, and each is a task of its own."""
    rows = [(None, "u", f"no id {i} " + "n" * 900) for i in range(400)] + [(7, "u", f"id 7, {i} " + "s" * 900) for i in range(400)]
    rows += [(100 + i, "u", f"own {i} " + "o" * 900) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    root = os.path.join(scratch, "w")
    manifest = warc.write_warc(df, root, shard_bytes=50_000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert len(manifest) > 20 and max(r.n for r in manifest) < 3 * 1200 / len(manifest)
    got = warc.read_warc(spark, root).collect()
    assert sorted((r.page_id or -1, bytes(r.payload).decode()) for r in got) == sorted((i or -1, h) for i, _, h in rows)


def test_a_third_of_the_rows_are_equal(spark, scratch):
    rows = [(5, "u", BIG)] * 300 + [(6, "u", "short")] * 300 + [(10 + i, "u", f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.warc_round_trip(df, shard_bytes=20_000).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id < 10), key=str)
    assert kinds == sorted([(5, "response", None)] + [(5, "revisit", 5)] * 299 + [(6, "response", None)] * 300, key=str)
    assert len(got) == 900
