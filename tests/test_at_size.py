"""What a job holds, writes and repeats follows its input (round 3)."""

import glob
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as E
from carthouse import session as S
from carthouse.functions.ids import packed_id, unpacked_id
from carthouse.functions.items import parse_item_json
from carthouse.operators import aggregates as A
from carthouse.plans import batch as B
from carthouse.sources import fixtures as X
from carthouse.sources import tables as TB
from carthouse.sources.feed import FeedWriter
from carthouse.sources.journal import write_journal


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, folder, lines=200):
    spark.range(lines).select(
        (F.col("id") % 40).alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 3).alias("l_suppkey"),
        F.col("id").alias("l_linenumber"), F.lit(2.0).alias("l_quantity")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(40).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"),
        F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    spark.range(7).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("p"), F.col("id")).alias("p_name"),
        F.lit(1.5).alias("p_retailprice")).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def _quantity_rows(spark, days, product="p"):
    return spark.createDataFrame([("v", f"{product}{d}", 2024, 1, d, 1, "n") for d in days], TB.ITEM_QUANTITY_BY_DAY)


def test_tasks_follow_the_lines(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path)
    small = sorted(X.purchase_journal(spark, folder).collect(), key=str)
    totals = sorted(E.q_item_quantity_by_day(spark, folder).collect())
    monkeypatch.setattr(X, "LINES_PER_TASK", 5)
    journal = X.purchase_journal(spark, folder)
    assert journal.rdd.getNumPartitions() == 40
    assert sorted(journal.collect(), key=str) == small
    by_day = B.item_quantity_by_day(journal, tasks=X.line_partitions(spark, folder))
    assert by_day.rdd.getNumPartitions() == 40 and sorted(by_day.collect()) == totals
    assert sum(r["quantity"] for r in totals) == 400


def test_wide_order_columns_are_not_shuffled(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = X.purchase_journal(spark, folder)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The upper join is the one with the orders, so nothing above it is dealt again.
    assert "o_orderkey" in next(line for line in plan.splitlines() if "Join" in line)


def test_item_json_is_parsed_once(spark):
    df = spark.createDataFrame([('{"name": "n", "price": 1, "quantity": "x"}',)], "t string").select(parse_item_json("t").alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    row = df.first()["r"]
    assert row["item"] is None and [e.split(":")[0] for e in row["errors"]] == ["productId", "vendorId", "quantity"]


def test_feed_writes_lines_as_they_come(tmp_path):
    batch = pa.RecordBatch.from_pydict({"topic": ["a", "b", "a"], "line": ['{"key":"1"}', '{"key":"ü"}', '{"key":"3"}'],
                                        "offset": ["x", "y", "z"], "offset_ts": [5, 7, None]})
    done = FeedWriter({"path": str(tmp_path), "writer": "w"}).write(iter([batch]))
    assert (done.rows, done.last) == (3, (7, "y"))
    assert {t: open(f, encoding="utf-8").read() for f, t in done.files} == {
        "a": '{"key":"1"}\n{"key":"3"}\n', "b": '{"key":"ü"}\n'}


def test_a_slice_of_commands_fills_the_files_of_one_trigger(spark, tmp_path):
    commands = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") % 500).cast("string").alias("member_id"))
    with S.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):  # as with many commands
        E._append_commands(commands, str(tmp_path / "log"))
    files = glob.glob(str(tmp_path / "log" / "*.parquet"))
    assert len(files) <= 4 * E.FILES_PER_TRIGGER and spark.read.parquet(str(tmp_path / "log")).count() == 4000


def test_a_merge_meets_only_stored_days_near_the_delta(spark, tmp_path):
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    t.upsert(_quantity_rows(spark, range(1, 20)), 0)
    near = t._near(t._scan(t.version().runs), _quantity_rows(spark, [19, 20]))
    assert [r["day"] for r in near.collect()] == [19]
    t.add(_quantity_rows(spark, [19, 20]), {"quantity": 0}, "b")
    assert {r["day"]: r["quantity"] for r in t.read().collect()} == {d: 2 if d == 19 else 1 for d in range(1, 21)}


def test_runs_are_merged_in_one_shuffle(spark, tmp_path):
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    for n in range(2):
        t.upsert(_quantity_rows(spark, [1, 2 + n]), n)
    rows, placed = t._merged(t.version().runs)
    assert placed and _plan(rows).count("Exchange ") + _plan(rows).count("Exchange(") == 1
    assert sorted(r["day"] for r in rows.collect()) == [1, 2, 3]


def test_keys_are_not_dealt_twice_to_be_looked_up(spark, tmp_path):
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    t.upsert(_quantity_rows(spark, [1, 2]), 0)
    keys = _quantity_rows(spark, [2, 2]).select(*t.key)
    assert [r["day"] for r in t.read_keys(keys).collect()] == [2]
    assert "Aggregate" not in t.read_keys(keys)._jdf.queryExecution().optimizedPlan().toString()


def test_merged_runs_go_with_their_versions(spark, tmp_path):
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    for n in range(3):
        t.replace_all(_quantity_rows(spark, [n + 1]))
    t.log.vacuum(1, 86_400)
    assert len(glob.glob(str(tmp_path / "t" / "runs" / "*"))) == 1 and [r["day"] for r in t.read().collect()] == [3]


def test_what_is_written_is_compact_and_state_is_dropped(spark, tmp_path):
    write_journal(X.purchase_journal(spark, _tables(spark, tmp_path)), str(tmp_path / "j"))
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    t.upsert(_quantity_rows(spark, [1]), 0)
    for found in (glob.glob(str(tmp_path / "j" / "*" / "*.parquet")), glob.glob(str(tmp_path / "t" / "**" / "*.parquet"), recursive=True)):
        assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in found} == {"ZSTD"}
    key = "spark.sql.streaming.minBatchesToRetain"
    own = spark.conf.get(key)
    with S.rocksdb_state(spark):
        assert int(spark.conf.get(key)) == S.STATE_BATCHES_KEPT
    assert spark.conf.get(key) == own


def test_ids_go_as_bytes_and_come_back(spark):
    texts = ["3c1d7a52-6f0e-4b1c-9d77-0a5b8e2f4c10", "", "p", "x" * 16, "3C1D7A52-6F0E-4B1C-9D77-0A5B8E2F4C10", None]
    rows = spark.createDataFrame([(t,) for t in texts], "id string").select("id", packed_id("id").alias("b"))
    got = rows.select("id", F.length("b").alias("n"), unpacked_id("b").alias("back")).collect()
    assert [r["back"] for r in got] == texts and [r["n"] for r in got] == [16, 17, 18, 33, 53, None]


def test_an_addition_is_written_once_with_the_shared_keys_sums(spark, tmp_path, monkeypatch):
    """The stored and the added rows meet on their common days only, whether few or many."""
    for sent in (100_000, 0):
        monkeypatch.setattr(TB, "ROWS_SENT", sent)
        t = TB.item_quantity_table(spark, str(tmp_path / f"t{sent}"))
        assert t.add(_quantity_rows(spark, range(1, 10)), {"quantity": 0}, "a")
        assert len(t.version().runs) == 1  # nothing was stored before
        assert t.add(_quantity_rows(spark, range(9, 20)), {"quantity": 0}, "b", note=lambda: "told afterwards")
        first, added, sums = t.version().runs
        assert [r["day"] for r in t._scan([sums]).collect()] == [9] and t.applied("")["note"] == "told afterwards"
        assert sorted(r["day"] for r in t._scan([added]).collect()) == list(range(9, 20))
        assert not t.add(_quantity_rows(spark, [25]), {"quantity": 0}, "c", note=lambda: "")  # nothing to note: nothing added
        assert len(t.version().runs) == 3
        assert {r["day"]: r["quantity"] for r in t.read().collect()} == {d: 2 if d == 9 else 1 for d in range(1, 20)}


def test_only_shared_days_are_merged_when_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TB, "APART_BYTES", 0)
    for name, buckets in (("t", None), ("b", 4)):
        t = TB.item_quantity_table(spark, str(tmp_path / name), buckets=buckets)
        t.upsert(_quantity_rows(spark, range(1, 10)), 0)
        t.upsert(_quantity_rows(spark, range(9, 15)).withColumn("quantity", F.lit(7).cast("long")), 1)
        shared = t._shared(t.version().runs)
        assert {r["day"] for r in t._scan(t.version().runs).where(shared).collect()} == {9}
        assert {r["day"]: r["quantity"] for r in t.read().collect()} == {d: 1 if d < 9 else 7 for d in range(1, 15)}
        monkeypatch.setattr(TB, "CELLS_NAMED", 0)
        assert t._shared(t.version().runs) is None and t.read().count() == 14
        monkeypatch.setattr(TB, "CELLS_NAMED", 2_000)


def test_dealt_rows_are_combined_and_written_without_another_shuffle(spark, tmp_path):
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    items = spark.range(1000).select(
        (F.col("id") % 5).cast("string").alias("vendor_id"), F.col("id").cast("string").alias("product_id"),
        (2018 + F.col("id") % 2).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        F.lit(1).alias("day"), F.lit(1).alias("quantity"),
        F.lit("n").alias("name"), F.col("id").alias("offset_ts"), F.col("id").cast("string").alias("offset"))
    totals = A.item_quantity_by_day(items, deal=lambda rows: t.dealt(rows, 9 * TB.ROWS_PER_TASK))
    plan = _plan(totals)
    assert plan.count("Exchange ") + plan.count("Exchange(") == 1 and "rangepartitioning" in plan and "9)" in plan
    t.upsert(totals, 0, placed=True)
    assert t.read().count() == 1000 and t.read().where("length(product_id) > 0").agg(F.sum("quantity")).first()[0] == 1000


def test_keys_without_a_row_are_found_absent(spark, tmp_path):
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    for n in range(2):
        t.upsert(_quantity_rows(spark, [1, 2 + n]).withColumn("quantity", F.lit(n + 1).cast("long")), n)
        keys = _quantity_rows(spark, [1, 5]).select(*t.key)
        assert {r["day"]: r["quantity"] for r in t.read_keys(keys, absent=True).collect()} == {1: n + 1, 5: None}


def test_a_micro_batch_leaves_one_file_a_month(spark, tmp_path):
    """Without AQE, as a stream plans its batches, every task would write a file into every month."""
    t = TB.item_quantity_table(spark, str(tmp_path / "t"))
    rows = spark.range(0, 4000, 1, 8).select(
        F.col("id").cast("string").alias("vendor_id"), F.lit("p").alias("product_id"), F.lit(2018).alias("year"),
        (F.col("id") % 12 + 1).cast("int").alias("month"), F.lit(1).alias("day"), F.col("id").alias("quantity"), F.lit("n").alias("name"))
    with S.settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        t.upsert(rows, 0)
    assert len(glob.glob(str(tmp_path / "t" / "runs" / "*" / "*" / "*" / "*.parquet"))) == 12


def test_streams_drop_their_old_state_and_shuffle_files_soon(spark):
    with S.rocksdb_state(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.maintenanceInterval") in ("10s", "10000")
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
