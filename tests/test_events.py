"""S1 as a source with its own offsets, and the feed sink with its commit messages."""

import os

import pytest
from pyspark.sql import functions as F

from carthouse.operators.projections import tag_events
from carthouse.schemas import JOURNAL
from carthouse.sources.events import FIRST, JournalReader, stream_events
from carthouse.sources.feed import acknowledged, acknowledged_offset, read_feed, write_feed
from carthouse.sources.journal import STORED, read_journal, write_journal
from carthouse.sources.tables import OffsetStore, item_quantity_table
from carthouse.streaming import hydrators as H

TAG = "item-purchased"


def events(spark, pairs):
    """Purchases with the given (time, id) offsets."""
    item = ("00000000-0000-3000-8000-000000000001", "00000000-0000-3000-8000-0000000000aa", "n", 1.0, 1)
    return tag_events(spark.createDataFrame(
        [("cart-m", n, i, t, "ItemPurchased", None, "00000000-0000-3000-8000-0000000000cc", item, None, "2024-01-31T10:00:00Z")
         for n, (t, i) in enumerate(pairs)], JOURNAL))


# Twelve events of one time between others, over several files.
PAIRS = [(10, "a"), (10, "b"), *[(20, f"o{i:02d}") for i in range(12)], (30, "a"), (30, "c"), (40, "z")]


@pytest.fixture()
def journal(spark, scratch):
    path = os.path.join(scratch, "journal")
    write_journal(events(spark, [*PAIRS, (None, None), (25, None)]).repartition(3), path)
    return path


def collected(spark, stream, checkpoint):
    """The offsets of each micro-batch of a stream that is drained."""
    batches = []
    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda b, i: batches.append(sorted((r.offset_ts, r.offset) for r in b.select("offset_ts", "offset").collect()))).start()
    q.processAllAvailable()
    q.stop()
    return batches


def test_batches_end_after_events_not_files(spark, scratch, journal):
    ck = os.path.join(scratch, "ck")
    got = collected(spark, stream_events(spark, journal, TAG, ck, max_events=5), ck)
    assert got == [PAIRS[i:i + 5] for i in range(0, len(PAIRS), 5)]
    # Restarted with nothing new, then with later events in a new file: neither repeats anything.
    assert collected(spark, stream_events(spark, journal, TAG, ck, max_events=5), ck) == []
    write_journal(events(spark, [(40, "zz"), (50, "a")]), journal)
    assert collected(spark, stream_events(spark, journal, TAG, ck, max_events=5), ck) == [[(40, "zz"), (50, "a")]]


def test_starts_and_stops_inside_one_time(spark, scratch, journal):
    a, b = os.path.join(scratch, "a"), os.path.join(scratch, "b")
    first = collected(spark, stream_events(spark, journal, TAG, a, until=(20, "o05")), a)
    rest = collected(spark, stream_events(spark, journal, TAG, b, after=(20, "o05"), max_events=4), b)
    assert sum(first, []) == PAIRS[:8] and sum(rest, []) == PAIRS[8:] and max(map(len, rest)) == 4


def test_rows_are_those_of_the_batch_scan(spark, scratch, journal):
    ck, out = os.path.join(scratch, "ck"), os.path.join(scratch, "out")
    q = stream_events(spark, journal, TAG, ck).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", ck).start()
    q.processAllAvailable()
    q.stop()
    want = read_journal(spark, journal).where("tag = 'item-purchased' and offset is not null and offset_ts is not null")
    got = spark.read.schema(STORED).parquet(out)
    assert got.count() == want.count() == len(PAIRS) and got.exceptAll(want).count() == 0


def test_reader_reads_only_what_the_range_touches(spark, scratch):
    path = os.path.join(scratch, "journal")
    for lo in (0, 100, 200):  # three files, one after the other
        write_journal(events(spark, [(lo + i, "x") for i in range(50)]).coalesce(1), path)
    reader = JournalReader(STORED, {"path": path, "tag": TAG})
    start, end = {"ts": 120, "id": "x"}, {"ts": 130, "id": "x"}
    (one,) = reader.partitions(start, end)
    assert sum(len(b) for b in reader.read(one)) == 10
    assert len(reader.partitions({"ts": FIRST[0], "id": ""}, end)) == 2 and not reader.partitions(end, end)
    assert len(reader.footers) == 3


def test_empty_journal(spark, scratch):
    ck = os.path.join(scratch, "ck")
    assert sum(collected(spark, stream_events(spark, os.path.join(scratch, "none"), TAG, ck), ck), []) == []


def test_resumed_stream_counts_every_event_once(spark, scratch, journal, monkeypatch):
    table, offs = item_quantity_table(spark, os.path.join(scratch, "t")), OffsetStore(spark, os.path.join(scratch, "o"))
    H.resumed_stream(spark, journal, "item_quantity", table, offs, until=(20, "o05"), max_events=3).drain()
    assert table.read().first().quantity == 8
    assert offs.find("popular-items-query", TAG) == ("o05", 20)
    # A crash after the rows and before the offset row, then another start: the batch is not added again.
    with monkeypatch.context() as m:
        real, calls = OffsetStore.update, []

        def failing(self, *args, **kw):
            calls.append(1)
            if len(calls) == 1:
                raise OSError("crash")
            return real(self, *args, **kw)

        m.setattr(OffsetStore, "update", failing)
        with pytest.raises(RuntimeError):
            H.resumed_stream(spark, journal, "item_quantity", table, offs, max_events=4).drain()
        H.resumed_stream(spark, journal, "item_quantity", table, offs, max_events=4).drain()
    assert table.read().first().quantity == len(PAIRS)
    assert offs.find("popular-items-query", TAG) == ("z", 40)


FRAME = "topic string, partition int, key string, value string, offset string, offset_ts long"


def frames(spark, scratch):
    path = os.path.join(scratch, "frames")
    spark.createDataFrame([(f"t{i % 2}", i % 3, f"k{i}", f'{{"n":{i}}}', f"o{i:03d}", 100 + i // 4) for i in range(40)], FRAME) \
        .repartition(4).write.parquet(path)
    return path


def run_feed(spark, frame, out, checkpoint):
    q = write_feed(frame, out, "w").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_failed_task_shows_nothing_and_is_published_again(spark, scratch):
    src, out, ck, flag = (os.path.join(scratch, d) for d in ("frames", "feed", "ck", "flag"))
    frames(spark, scratch)

    def fail_once(batches):
        for b in batches:
            if not os.path.exists(flag) and (b["key"] == "k17").any():
                open(flag, "w").close()
                raise OSError("task lost")
            yield b

    stream = spark.readStream.schema(FRAME).parquet(src).mapInPandas(fail_once, FRAME)
    with pytest.raises(Exception, match="task lost"):
        run_feed(spark, stream, out, ck)
    assert acknowledged_offset(spark, out) is None and not [d for d in os.listdir(out) if d.startswith("batch_id=")]
    run_feed(spark, spark.readStream.schema(FRAME).parquet(src).mapInPandas(fail_once, FRAME), out, ck)
    got = read_feed(spark, out)
    assert got.count() == 40 and got.select("key").distinct().count() == 40
    assert {(r.topic, r.key) for r in got.collect()} == {(f"t{i % 2}", f"k{i}") for i in range(40)}
    assert acknowledged_offset(spark, out) == (109, "o039")
    assert [(r.batch, r.rows) for r in acknowledged(spark, out).collect()] == [(0, 40)]


def test_a_crash_in_the_commit_publishes_again(spark, scratch):
    """Files moved but not acknowledged: the offset has not moved, and the replayed batch replaces them."""
    src, out = frames(spark, scratch), os.path.join(scratch, "feed")
    run_feed(spark, spark.readStream.schema(FRAME).parquet(src), out, os.path.join(scratch, "ck1"))
    os.remove(os.path.join(out, "_acknowledged", "w-0.json"))
    assert acknowledged_offset(spark, out, "w-0") is None
    run_feed(spark, spark.readStream.schema(FRAME).parquet(src), out, os.path.join(scratch, "ck2"))
    assert read_feed(spark, out).count() == 40 and acknowledged_offset(spark, out, "w-0") == (109, "o039")


def test_an_endless_feed_stores_its_offset_as_it_goes(spark, scratch, journal):
    import time
    offs = OffsetStore(spark, os.path.join(scratch, "o"), id_col="producer_id")
    h = H.purchase_feed_stream(spark, journal, offs.path, "t", 2, fallback_path=os.path.join(scratch, "f"),
                               checkpoint=os.path.join(scratch, "c"), available_now=False, interval="0 seconds")
    for pairs, want in (([(50, "a")], ("a", 50)), ([(60, "b")], ("b", 60))):
        write_journal(events(spark, pairs), journal)
        h.query.processAllAvailable()
        for _ in range(100):
            if offs.find("kafka-producer-example", TAG) == want:
                break
            time.sleep(0.2)
        assert offs.find("kafka-producer-example", TAG) == want
    h.stop()
