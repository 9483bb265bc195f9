"""Batch = stream: the streaming read sides equal the batch rebuild (T11),
with the journal split in many files, file order shuffled, a restart in the
middle, and late (older-offset) events arriving last."""

import os

from pyspark.sql import functions as F

from carthouse.plans import batch as B
from carthouse.sources import fixtures as X
from carthouse.sources.journal import read_journal, write_journal
from carthouse.sources.tables import OffsetStore, item_quantity_table
from carthouse.streaming import hydrators as H

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _split_journal(spark, scratch):
    j = X.purchase_journal(spark, SF_SMALL)
    # Four slices by a hash; the last slice holds the *oldest* offsets so it
    # arrives late.
    p10 = j.agg(F.expr("percentile_approx(offset_ts, 0.1)")).first()[0]
    j = j.withColumn("slice", F.when(F.col("offset_ts") < F.lit(p10), 3)
                     .otherwise(F.pmod(F.xxhash64("offset"), F.lit(3))))
    j = j.checkpoint()
    src = os.path.join(scratch, "journal")
    return j, src


def test_item_quantity_stream_equals_batch(spark, scratch):
    j, src = _split_journal(spark, scratch)
    table_path, offs = os.path.join(scratch, "iq"), os.path.join(scratch, "offsets")
    ckpt = os.path.join(scratch, "ckpt-iq")
    for part in (2, 0):
        write_journal(j.where(F.col("slice") == part).drop("slice").repartition(3), src)
    h = H.item_quantity_stream(spark, src, table_path, offs, checkpoint=ckpt, max_files_per_trigger=2)
    h.await_done()
    # restart in the middle, then more files, late ones last
    for part in (1, 3):
        write_journal(j.where(F.col("slice") == part).drop("slice").repartition(2), src)
    h = H.item_quantity_stream(spark, src, table_path, offs, checkpoint=ckpt, max_files_per_trigger=1)
    h.await_done()
    got = item_quantity_table(spark, table_path).read()
    want = B.item_quantity_by_day(read_journal(spark, src))
    cols = ["vendor_id", "product_id", "year", "month", "day", "quantity", "name"]
    assert _rows(got, cols) == _rows(want, cols)
    stored = OffsetStore(spark, offs).find("popular-items-query", "item-purchased")
    assert stored[1] == read_journal(spark, src).agg(F.max("offset_ts")).first()[0]


def test_vendor_balance_streams_equal_batch(spark, scratch):
    j, src = _split_journal(spark, scratch)
    write_journal(j.drop("slice").repartition(4), src)
    for rounded, want in ((False, B.balance_by_vendor), (True, B.vendor_billing)):
        tp = os.path.join(scratch, f"vb{rounded}")
        h = H.vendor_balance_stream(spark, src, tp, os.path.join(scratch, "offs"), rounded=rounded,
                                    checkpoint=os.path.join(scratch, f"ck{rounded}"), max_files_per_trigger=2)
        h.await_done()
        from carthouse.sources.tables import balance_table, billing_table
        got = (billing_table if rounded else balance_table)(spark, tp).read()
        cols = ["vendor_id", "year", "month", "balance"]
        assert _rows(got, cols) == _rows(want(read_journal(spark, src)), cols)


def test_purchase_feed_to_file_sink(spark, scratch):
    j, src = _split_journal(spark, scratch)
    write_journal(j.drop("slice").repartition(3), src)
    out = os.path.join(scratch, "feed")
    h = H.purchase_feed_stream(spark, src, os.path.join(scratch, "poffs"), "item-purchased-events", 4,
                               fallback_path=out, checkpoint=os.path.join(scratch, "ckf"))
    h.await_done()
    got = spark.read.json(out)
    assert got.count() == j.count()
    assert set(r.partition for r in got.select("partition").distinct().collect()) <= {0, 1, 2, 3}
    stored = OffsetStore(spark, os.path.join(scratch, "poffs"), id_col="producer_id").find(
        "kafka-producer-example", "item-purchased")
    assert stored is not None


def test_batch_catch_up_equals_rebuild(spark, scratch):
    j, src = _split_journal(spark, scratch)
    jr = j.drop("slice")
    table = item_quantity_table(spark, os.path.join(scratch, "cu"))
    offs = OffsetStore(spark, os.path.join(scratch, "cuoffs"))
    cut = jr.agg(F.expr("percentile_approx(offset_ts, 0.5)")).first()[0]
    H.catch_up_item_quantity(spark, jr.where(F.col("offset_ts") <= cut), table, offs)
    H.catch_up_item_quantity(spark, jr, table, offs)
    H.catch_up_item_quantity(spark, jr, table, offs)  # nothing new: no change
    cols = ["vendor_id", "product_id", "year", "month", "day", "quantity", "name"]
    assert _rows(table.read(), cols) == _rows(B.item_quantity_by_day(jr), cols)


def test_command_stream_equals_batch_events(spark, scratch):
    """T7 stream form over the command log cut into ordered files equals the
    batch T6 -> T7 result, row for row."""
    from carthouse.schemas import COMMANDS_SCHEMA, JOURNAL
    from carthouse.streaming.carts import stream_commands_to_events
    cmds = X.command_log(spark, SF_SMALL)
    src = os.path.join(scratch, "commands")
    bounds = cmds.selectExpr("percentile_approx(seq, array(0.3, 0.7))").first()[0]
    for lo, hi in ((None, bounds[0]), (bounds[0], bounds[1]), (bounds[1], None)):
        part = cmds
        if lo is not None:
            part = part.where(F.col("seq") > lo)
        if hi is not None:
            part = part.where(F.col("seq") <= hi)
        part.repartition(2, "member_id").write.mode("append").parquet(src)
    stream = spark.readStream.schema(COMMANDS_SCHEMA).option("maxFilesPerTrigger", 2).parquet(src)
    out = os.path.join(scratch, "events")
    q = (stream_commands_to_events(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck-cmd")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    got = spark.read.schema(JOURNAL).parquet(out)
    _, _, want = B.process_commands(cmds, bucket_size=64)
    cols = [f.name for f in JOURNAL.fields]
    assert got.count() == want.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_endless_stream_guard(spark, scratch):
    """An endless hydrator that is still running is fine; once stopped,
    waiting on it as endless reports that it completed."""
    import pytest
    j, src = _split_journal(spark, scratch)
    write_journal(j.drop("slice").repartition(2), src)
    h = H.item_quantity_stream(spark, src, os.path.join(scratch, "t"), os.path.join(scratch, "o"),
                               checkpoint=os.path.join(scratch, "ck"), available_now=False, interval="1 second")
    h.await_done(timeout=3, endless=True)  # still running: no error
    h.stop()
    with pytest.raises(H.InfiniteStreamCompleted):
        h.await_done(timeout=3, endless=True)


def test_catch_up_balances_equals_rebuild(spark, scratch):
    """T10 for the vendor read sides, in three steps with a replayed batch;
    the 2-dp form keeps per-event rounding across the merges."""
    from carthouse.sources.tables import balance_table, billing_table
    j, _ = _split_journal(spark, scratch)
    jr = j.drop("slice")
    cuts = jr.agg(F.expr("percentile_approx(offset_ts, array(0.3, 0.6))")).first()[0]
    for kind, mk, want in (("balance", balance_table, B.balance_by_vendor), ("billing", billing_table, B.vendor_billing)):
        t = mk(spark, os.path.join(scratch, kind))
        offs = OffsetStore(spark, os.path.join(scratch, kind + "-offs"))
        H.catch_up(spark, jr.where(F.col("offset_ts") <= cuts[0]), kind, t, offs)
        H.catch_up(spark, jr.where(F.col("offset_ts") <= cuts[1]), kind, t, offs)
        H.catch_up(spark, jr, kind, t, offs)
        assert not H.catch_up(spark, jr, kind, t, offs)  # nothing new
        cols = ["vendor_id", "year", "month", "balance"]
        assert _rows(t.read(), cols) == _rows(want(jr), cols)


def test_stream_over_serialized_journal(spark, scratch):
    from carthouse.sources.journal import encode_events, write_raw_journal
    j, _ = _split_journal(spark, scratch)
    src = os.path.join(scratch, "raw")
    write_raw_journal(encode_events(j.drop("slice")).repartition(3), src)
    tp = os.path.join(scratch, "iq-raw")
    H.item_quantity_stream(spark, src, tp, os.path.join(scratch, "o"), checkpoint=os.path.join(scratch, "c"),
                           raw=True).await_done()
    cols = ["vendor_id", "product_id", "year", "month", "day", "quantity", "name"]
    assert _rows(item_quantity_table(spark, tp).read(), cols) == _rows(B.item_quantity_by_day(j.drop("slice")), cols)


def test_command_line_runs_a_hydrator(spark, scratch):
    """``python -m carthouse popular-items --available-now`` in the same
    session: the table equals the batch rebuild."""
    from carthouse.__main__ import main
    j, src = _split_journal(spark, scratch)
    write_journal(j.drop("slice").repartition(2), src)
    tp = os.path.join(scratch, "cli-table")
    assert main(["popular-items", "--journal", src, "--table", tp, "--offsets", os.path.join(scratch, "cli-o"),
                 "--checkpoint", os.path.join(scratch, "cli-ck"), "--available-now"]) == 0
    cols = ["vendor_id", "product_id", "year", "month", "day", "quantity", "name"]
    assert _rows(item_quantity_table(spark, tp).read(), cols) == _rows(B.item_quantity_by_day(read_journal(spark, src)), cols)


def test_command_stream_fails_on_out_of_order_commands(spark, scratch):
    import pytest

    from carthouse.schemas import COMMANDS_SCHEMA
    from carthouse.streaming.carts import stream_commands_to_events
    P1 = "00000000-0000-3000-8000-000000000001"
    item = (P1, "00000000-0000-3000-8000-0000000000aa", "n", 1.0, 1)
    src = os.path.join(scratch, "cmds")
    spark.createDataFrame([("m", 5, "AddItem", item, None, None, "2024-01-01T00:00:05Z")], COMMANDS_SCHEMA) \
        .write.mode("append").parquet(src)
    spark.createDataFrame([("m", 3, "RemoveItem", None, P1, None, "2024-01-01T00:00:03Z")], COMMANDS_SCHEMA) \
        .write.mode("append").parquet(src)
    stream = spark.readStream.schema(COMMANDS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = (stream_commands_to_events(stream).writeStream.format("parquet").option("path", os.path.join(scratch, "ev"))
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    with pytest.raises(Exception, match="appended in order"):
        q.awaitTermination()


def test_rebuild_replaces_stale_rows_and_resumes(spark, scratch):
    from carthouse.sources.tables import balance_table
    j, _ = _split_journal(spark, scratch)
    jr = j.drop("slice")
    t = balance_table(spark, os.path.join(scratch, "rb"))
    offs = OffsetStore(spark, os.path.join(scratch, "rb-offs"))
    schema = "vendor_id string, year int, month int, balance decimal(38,18)"
    from decimal import Decimal
    t.upsert(spark.createDataFrame([("stale-vendor", 1990, 1, Decimal(1))], schema), 0)
    cut = jr.agg(F.expr("percentile_approx(offset_ts, 0.5)")).first()[0]
    H.rebuild(spark, jr.where(F.col("offset_ts") <= cut), "balance", t, offs)
    assert t.read().where(F.col("vendor_id") == "stale-vendor").count() == 0
    H.catch_up(spark, jr, "balance", t, offs)
    cols = ["vendor_id", "year", "month", "balance"]
    assert _rows(t.read(), cols) == _rows(B.balance_by_vendor(jr), cols)


def test_command_line_other_jobs(spark, scratch):
    from carthouse.__main__ import main
    from carthouse.schemas import JOURNAL
    from carthouse.sources.tables import billing_table
    j, src = _split_journal(spark, scratch)
    write_journal(j.drop("slice").repartition(2), src)
    vb = os.path.join(scratch, "vb")
    assert main(["vendor-billing", "--journal", src, "--table", vb, "--offsets", os.path.join(scratch, "o1"),
                 "--rounded", "--checkpoint", os.path.join(scratch, "c1"), "--available-now"]) == 0
    cols = ["vendor_id", "year", "month", "balance"]
    assert _rows(billing_table(spark, vb).read(), cols) == _rows(B.vendor_billing(read_journal(spark, src)), cols)
    feed = os.path.join(scratch, "feed")
    assert main(["item-purchased-events", "--journal", src, "--offsets", os.path.join(scratch, "o2"), "--topic", "t",
                 "--partitions", "3", "--fallback-path", feed, "--checkpoint", os.path.join(scratch, "c2"),
                 "--available-now"]) == 0
    assert spark.read.json(feed).count() == read_journal(spark, src).count()
    cmds = os.path.join(scratch, "cmds")
    X.command_log(spark, SF_SMALL).repartition(2, "member_id").write.parquet(cmds)
    ev = os.path.join(scratch, "events")
    assert main(["commands", "--commands", cmds, "--events", ev, "--checkpoint", os.path.join(scratch, "c3"),
                 "--available-now"]) == 0
    _, _, want = B.process_commands(X.command_log(spark, SF_SMALL), bucket_size=64)
    got = spark.read.schema(JOURNAL).parquet(ev)
    fields = [f.name for f in JOURNAL.fields]
    assert got.count() == want.count() and got.select(*fields).exceptAll(want.select(*fields)).count() == 0


def test_new_checkpoint_reprocesses_into_the_same_table(spark, scratch):
    """Commit markers belong to one streaming query: a fresh checkpoint over
    the same table (a reprocess) is not mistaken for a replay."""
    j, src = _split_journal(spark, scratch)
    write_journal(j.where(F.col("slice") == 0).drop("slice"), src)
    tp, offs = os.path.join(scratch, "t"), os.path.join(scratch, "o")
    H.item_quantity_stream(spark, src, tp, offs, checkpoint=os.path.join(scratch, "ck1")).await_done()
    write_journal(j.where(F.col("slice") != 0).drop("slice"), src)
    H.item_quantity_stream(spark, src, tp, offs, checkpoint=os.path.join(scratch, "ck2")).await_done()
    cols = ["vendor_id", "product_id", "year", "month", "day", "quantity", "name"]
    assert _rows(item_quantity_table(spark, tp).read(), cols) == _rows(B.item_quantity_by_day(read_journal(spark, src)), cols)


def _purchase(spark, n, ticks):
    """The n-th purchase of one product, at a given time."""
    from carthouse.operators.projections import tag_events
    from carthouse.schemas import JOURNAL
    item = ("00000000-0000-3000-8000-000000000001", "00000000-0000-3000-8000-0000000000aa", f"name {n}", 1.0, 1)
    return tag_events(spark.createDataFrame(
        [("cart-m", n, f"o{n}", ticks, "ItemPurchased", None, "00000000-0000-3000-8000-0000000000cc", item, None,
          "2024-01-31T10:00:00Z")], JOURNAL))


def _crash_once(monkeypatch, where, name):
    """The named method fails the first time it is called."""
    real, calls = getattr(where, name), []

    def failing(*args, **kw):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("crash")
        return real(*args, **kw)

    monkeypatch.setattr(where, name, failing)


def test_a_crash_between_rows_and_offset_loses_and_doubles_nothing(spark, scratch, monkeypatch):
    """After the rows, before the offset: the rerun, with a new event in
    between, counts both purchases once."""
    import pytest
    for crash_in, at in ((OffsetStore, "update"), (type(item_quantity_table(spark, scratch)), "publish")):
        root = os.path.join(scratch, at)
        table, offs = item_quantity_table(spark, os.path.join(root, "t")), OffsetStore(spark, os.path.join(root, "o"))
        with monkeypatch.context() as m:
            _crash_once(m, crash_in, at)
            with pytest.raises(OSError):
                H.catch_up(spark, _purchase(spark, 1, 10), "item_quantity", table, offs)
            journal = _purchase(spark, 1, 10).unionByName(_purchase(spark, 2, 20))
            H.catch_up(spark, journal, "item_quantity", table, offs)
        assert table.read().first().quantity == 2 and table.read().first().name == "name 2"
        assert offs.find("popular-items-query", "item-purchased") == ("o2", 20)
        assert not H.catch_up(spark, journal, "item_quantity", table, offs)


def test_a_later_event_of_the_stored_time_is_read(spark, scratch):
    table, offs = item_quantity_table(spark, os.path.join(scratch, "t")), OffsetStore(spark, os.path.join(scratch, "o"))
    H.catch_up(spark, _purchase(spark, 1, 10), "item_quantity", table, offs)
    both = _purchase(spark, 1, 10).unionByName(_purchase(spark, 2, 10))
    assert H.catch_up(spark, both, "item_quantity", table, offs)
    assert table.read().first().quantity == 2


def test_a_crash_after_a_rebuild_keeps_its_offset(spark, scratch, monkeypatch):
    import pytest
    table, offs = item_quantity_table(spark, os.path.join(scratch, "t")), OffsetStore(spark, os.path.join(scratch, "o"))
    journal = _purchase(spark, 1, 10).unionByName(_purchase(spark, 2, 20))
    with monkeypatch.context() as m:
        _crash_once(m, OffsetStore, "update")
        with pytest.raises(OSError):
            H.rebuild(spark, journal, "item_quantity", table, offs)
        assert not H.catch_up(spark, journal, "item_quantity", table, offs)
    assert table.read().first().quantity == 2


def test_command_line_reads_a_serialized_journal(spark, scratch):
    from carthouse.__main__ import main
    from carthouse.sources.journal import encode_events, write_raw_journal
    from carthouse.sources.tables import billing_table
    j, _ = _split_journal(spark, scratch)
    src = os.path.join(scratch, "raw")
    write_raw_journal(encode_events(j.drop("slice")), src)
    vb, feed = os.path.join(scratch, "vb"), os.path.join(scratch, "feed")
    assert main(["vendor-billing", "--raw", "--journal", src, "--table", vb, "--offsets", os.path.join(scratch, "o1"),
                 "--rounded", "--checkpoint", os.path.join(scratch, "c1"), "--available-now"]) == 0
    cols = ["vendor_id", "year", "month", "balance"]
    assert _rows(billing_table(spark, vb).read(), cols) == _rows(B.vendor_billing(j.drop("slice")), cols)
    assert main(["item-purchased-events", "--raw", "--journal", src, "--offsets", os.path.join(scratch, "o2"), "--topic",
                 "t", "--fallback-path", feed, "--checkpoint", os.path.join(scratch, "c2"), "--available-now"]) == 0
    assert spark.read.json(feed).count() == j.count()


def test_a_lost_or_reset_offset_rebuilds(spark, scratch):
    """Half the journal, the offset table gone, then all of it: every event counts once, and the offset is back."""
    from carthouse.sources.versions import delete
    one, two = _purchase(spark, 1, 10), _purchase(spark, 1, 10).unionByName(_purchase(spark, 2, 20))
    for case in ("lost", "behind", "ahead"):
        root = os.path.join(scratch, case)
        table, offs = item_quantity_table(spark, os.path.join(root, "t")), OffsetStore(spark, os.path.join(root, "o"))
        assert H.catch_up(spark, one, "item_quantity", table, offs)
        delete(spark, offs.path)
        if case == "behind":  # an older copy of the offset table
            offs.update("popular-items-query", "item-purchased", "o0", 5)
        if case == "ahead":  # the table is older than its offset
            offs.update("popular-items-query", "item-purchased", "o2", 20)
        assert H.catch_up(spark, two, "item_quantity", table, offs)
        assert table.read().first().quantity == 2 and table.read().first().name == "name 2"
        assert offs.find("popular-items-query", "item-purchased") == ("o2", 20)
        assert not H.catch_up(spark, two, "item_quantity", table, offs)


def test_a_table_filled_by_another_job_is_rebuilt(spark, scratch):
    """A catch-up cannot resume where a stream wrote: it starts over, once."""
    j, src = _split_journal(spark, scratch)
    write_journal(j.where("slice = 0").drop("slice"), src)
    table, offs = item_quantity_table(spark, os.path.join(scratch, "t")), OffsetStore(spark, os.path.join(scratch, "o"))
    H.item_quantity_stream(spark, src, table.path, offs.path, checkpoint=os.path.join(scratch, "c")).await_done()
    jr = j.drop("slice")
    assert H.catch_up(spark, jr, "item_quantity", table, offs) and not H.catch_up(spark, jr, "item_quantity", table, offs)
    cols = ["vendor_id", "product_id", "year", "month", "day", "quantity", "name"]
    assert _rows(table.read(), cols) == _rows(B.item_quantity_by_day(jr), cols)
