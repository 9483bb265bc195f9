"""The read sides and the purchase feed as restartable
Structured Streaming queries.

Each hydrator is the batch plan of ``plans.batch`` applied to the journal as
a file stream:

* aggregates run as a streaming ``groupBy().agg()`` in ``update`` mode; the
  state store (RocksDB) holds the running totals per key, so every emitted
  row is an *absolute* total and the ``foreachBatch`` upsert is idempotent;
* no watermark: late events are always accepted and update old buckets,
  which is why the state is unbounded, as keyed read-side tables are;
* the checkpoint location is the resume point (T10); the user-visible
  offset table is written in the same batch after the rows.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from carthouse.functions.ids import packed_id, unpacked_id, with_ids
from carthouse.operators import projections as P
from carthouse.operators.aggregates import ITEM_IDS
from carthouse.plans import batch as B
from carthouse.schemas import (ITEM_QUANTITY_KEY, KAFKA_PRODUCER_ID, POPULAR_ITEMS_HYDRATOR, TAG_ITEM_PURCHASED,
                               VENDOR_BILLING_HYDRATOR, VENDOR_KEY)
from carthouse.session import checkpoint_root, materialize, release, rocksdb_state
from carthouse.sources.jdbc import VENDOR_BILLING_TARGET, create_tables, write_batch
from carthouse.sources.events import stream_events
from carthouse.sources.feed import acknowledged_offset, write_feed
from carthouse.sources.journal import read_journal, stream_journal
from carthouse.sources.kafka import publish
from carthouse.sources.tables import KeyedTable, OffsetStore, balance_table, billing_table, item_quantity_table


class InfiniteStreamCompleted(RuntimeError):
    """An endless query stopped on its own."""


@dataclass
class Hydrator:
    name: str
    query: StreamingQuery
    # Stores what the query has acknowledged so far; also run after every batch.
    settle: Callable[[], None] | None = None

    def await_done(self, timeout: float | None = None, endless: bool = False) -> None:
        """Surface failures; for an endless trigger, ending is a failure too."""
        try:
            finished = self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()
            exc = self.query.exception()
        except StreamingQueryException as failed:
            finished, exc = True, failed
        if self.settle is not None:
            self.settle()
        if exc is not None:
            raise RuntimeError(f"{self.name} failed: {exc}")
        if endless and finished is not False:
            raise InfiniteStreamCompleted(f"{self.name}: an infinite stream should not complete")

    def drain(self) -> None:
        """Process what is there, then stop (for sources that take no AvailableNow trigger)."""
        try:
            self.query.processAllAvailable()
        except StreamingQueryException as failed:
            raise RuntimeError(f"{self.name} failed: {failed}") from failed
        finally:
            self.query.stop()

    def stop(self) -> None:
        self.query.stop()


class _AfterBatch(StreamingQueryListener):
    """Calls ``settle`` with the number of every finished batch of one query, until that ends."""

    def __init__(self, spark: SparkSession, settle: Callable[[int], None]):
        self.spark, self.settle, self.query_id = spark, settle, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.query_id is not None and str(event.progress.id) == self.query_id:
            self.settle(event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.query_id is not None and str(event.id) == self.query_id:
            self.spark.streams.removeListener(self)


class _BatchScope:
    """Who commits the batches of one streaming query.

    The query id is the persistent one in the checkpoint's metadata: the
    same across restarts of that checkpoint (a replayed batch is skipped),
    new for a new checkpoint (a reprocess into the same table is not)."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.checkpoint, self.query_id = spark, checkpoint, None

    def token(self, batch_id: int) -> str:
        return f"{self.writer()}-{int(batch_id)}"

    def writer(self) -> str:
        if self.query_id is None:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.checkpoint, "metadata"))
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            stream = fs.open(path)
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self.query_id = json.loads(text.strip().splitlines()[0])["id"]
        return self.query_id


def _start(spark: SparkSession, writer, available_now: bool, interval: str) -> StreamingQuery:
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with rocksdb_state(spark):
        return writer.start()


def _purchases_stream(spark: SparkSession, journal_path: str, max_files: int | None, raw: bool = False) -> DataFrame:
    return B.purchased(stream_journal(spark, journal_path, max_files, raw=raw))


def _quantities(items: DataFrame, deal: Callable[[DataFrame], DataFrame] | None = None, packed: bool = True) -> DataFrame:
    """A1 + A2 with the newest offset: one struct is both the order and what it carries, so state holds it once. Ids are
    shuffled and kept as bytes (``packed``). ``deal`` places the rows of a key in one task."""
    latest = F.max(F.struct("offset_ts", "offset", "name")).alias("latest")
    items = with_ids(items, packed_id, ITEM_IDS) if packed else items
    if deal is not None:
        items = deal(items)
    totals = (items.groupBy(*ITEM_QUANTITY_KEY).agg(F.sum(F.col("quantity").cast("long")).alias("quantity"), latest)
              .select(*ITEM_QUANTITY_KEY, "quantity", "latest.name", "latest.offset", "latest.offset_ts"))
    return with_ids(totals, unpacked_id, ITEM_IDS) if packed else totals


def _balances(charges: DataFrame, measure, out_type: str) -> DataFrame:
    """A3 or A4 with the newest offset."""
    latest = F.max(F.struct("offset_ts", "offset")).alias("latest")
    return (charges.groupBy(*VENDOR_KEY).agg(F.sum(measure).alias("balance"), latest)
            .select(*VENDOR_KEY, F.col("balance").cast(out_type).alias("balance"), "latest.offset", "latest.offset_ts"))


def item_quantity_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """T1's running totals as its state store holds them, read as a table: what the next batch will add to."""
    stored = spark.read.format("statestore").load(checkpoint)
    totals = stored.select("key.*", F.col("value.sum").alias("quantity"), F.col("value.max.name").alias("name"))
    return with_ids(totals, unpacked_id, ITEM_IDS)


def store_batch(batch: DataFrame, batch_id: int, writer: str, table: KeyedTable, offsets: OffsetStore,
                hydrator: str) -> None:
    """S4/S5 then S8 of one micro-batch, computed once: its newest offset is
    seen while its rows are written. A replayed one changes nothing; it is
    computed too, for its state."""
    if table.committed(int(batch_id), writer):
        rows = materialize(batch)
        offsets.update_from(rows, hydrator, TAG_ITEM_PURCHASED)
        release(rows)
        return
    rows, newest = _observed(batch)
    table.upsert(rows, int(batch_id), writer=writer)
    if newest() is not None:
        offsets.update(hydrator, TAG_ITEM_PURCHASED, newest()[1], newest()[0])


def _observed(rows: DataFrame):
    """(the rows, what gives (offset_ts, offset) of the newest event behind them once they are written; None without any)."""
    seen = Observation()

    def newest():
        last = seen.get["o"]
        return None if last is None else (last["offset_ts"], last["offset"])

    return rows.observe(seen, F.max(F.struct("offset_ts", "offset")).alias("o")), newest


def item_quantity_stream(spark: SparkSession, journal_path: str, table_path: str, offsets_path: str,
                         checkpoint: str | None = None, available_now: bool = True, interval: str = "10 seconds",
                         max_files_per_trigger: int | None = None, raw: bool = False) -> Hydrator:
    """Popular-items read side, exactly once per key. ``raw`` reads the
    serialized journal (manifest + payload) and decodes it in the stream."""
    items = P.project_item_quantity(_purchases_stream(spark, journal_path, max_files_per_trigger, raw), P.STRICT)
    agg = _quantities(items)
    table = item_quantity_table(spark, table_path).create_if_missing()
    offsets = OffsetStore(spark, offsets_path)
    ckpt = checkpoint or os.path.join(checkpoint_root(spark), "streams", POPULAR_ITEMS_HYDRATOR)
    scope = _BatchScope(spark, ckpt)

    def sink(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, scope.writer(), table, offsets, POPULAR_ITEMS_HYDRATOR)

    w = agg.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(sink)
    return Hydrator(POPULAR_ITEMS_HYDRATOR, _start(spark, w, available_now, interval))


def vendor_balance_stream(spark: SparkSession, journal_path: str, table_path: str, offsets_path: str,
                          rounded: bool = False, checkpoint: str | None = None, available_now: bool = True,
                          interval: str = "10 seconds", max_files_per_trigger: int | None = None,
                          jdbc: tuple[str, dict] | None = None, raw: bool = False) -> Hydrator:
    """Vendor-billing read side; ``rounded`` gives the 2-dp (SQL) form,
    rounded per event before it is added.

    ``jdbc=(url, properties)`` sends each micro-batch to a SQL database
    instead (S6: bulk load + one transaction with the offset row); the
    parquet table and offset store are then not written.
    """
    charges = P.project_vendor_charge(_purchases_stream(spark, journal_path, max_files_per_trigger, raw), P.STRICT)
    measure = F.col("total_2dp") if rounded else F.col("total")
    out_type = "decimal(21,2)" if rounded else "decimal(38,18)"
    agg = _balances(charges, measure, out_type)
    if jdbc is not None:
        create_tables(spark, jdbc[0], jdbc[1], VENDOR_BILLING_TARGET)
    table = None if jdbc is not None else (billing_table if rounded else balance_table)(spark, table_path) \
        .create_if_missing()
    offsets = None if jdbc is not None else OffsetStore(spark, offsets_path)
    name = VENDOR_BILLING_HYDRATOR + ("-2dp" if rounded else "")
    ckpt = checkpoint or os.path.join(checkpoint_root(spark), "streams", name)
    scope = _BatchScope(spark, ckpt)

    def sink(batch: DataFrame, batch_id: int) -> None:
        if jdbc is not None:
            last = batch.agg(F.max_by("offset", F.struct("offset_ts", "offset")).alias("o")).first()["o"]
            if last is not None:  # an empty micro-batch moves nothing
                write_batch(batch, jdbc[0], jdbc[1], VENDOR_BILLING_TARGET, (name, TAG_ITEM_PURCHASED, last),
                            scope.token(batch_id))
            return
        store_batch(batch, batch_id, scope.writer(), table, offsets, name)

    w = agg.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(sink)
    return Hydrator(name, _start(spark, w, available_now, interval))


def purchase_feed_stream(spark: SparkSession, journal_path: str, offsets_path: str, topic: str,
                         partitions: int, bootstrap_servers: str | None = None, fallback_path: str | None = None,
                         checkpoint: str | None = None, available_now: bool = True, interval: str = "10 seconds",
                         max_files_per_trigger: int | None = None, raw: bool = False) -> Hydrator:
    """Every purchase as a keyed JSON record, at least once; the
    producer offset (A6) is stored after the batch is published.

    To files the records go through the feed sink, whose commit messages carry
    the offsets; to Kafka through its connector."""
    src = stream_journal(spark, journal_path, max_files_per_trigger, raw=raw)
    frame = B.purchase_records(src, topic, partitions)
    offsets = OffsetStore(spark, offsets_path, id_col="producer_id")
    ckpt = checkpoint or os.path.join(checkpoint_root(spark), "streams", KAFKA_PRODUCER_ID)
    if bootstrap_servers or not fallback_path:
        scope = _BatchScope(spark, ckpt)

        def sink(batch: DataFrame, batch_id: int) -> None:
            publish(batch, bootstrap_servers, fallback_path, scope.token(batch_id))
            offsets.update_from(batch, KAFKA_PRODUCER_ID, TAG_ITEM_PURCHASED)

        w = frame.writeStream.outputMode("append").option("checkpointLocation", ckpt).foreachBatch(sink)
        return Hydrator(KAFKA_PRODUCER_ID, _start(spark, w, available_now, interval))
    # The same checkpoint names its batches the same, so a replayed one replaces itself.
    writer = uuid.uuid5(uuid.NAMESPACE_URL, ckpt).hex

    def settle(batch_id: int | None = None) -> None:
        last = acknowledged_offset(spark, fallback_path, None if batch_id is None else f"{writer}-{batch_id}")
        if last is not None:
            offsets.update(KAFKA_PRODUCER_ID, TAG_ITEM_PURCHASED, last[1], last[0])

    after_batch = _AfterBatch(spark, settle)
    w = write_feed(frame, fallback_path, writer).option("checkpointLocation", ckpt)
    if not available_now:  # an endless query stores its offset as it goes
        spark.streams.addListener(after_batch)
    query = _start(spark, w, available_now, interval)
    after_batch.query_id = str(query.id)
    return Hydrator(KAFKA_PRODUCER_ID, query, settle)


def _delta_item_quantity(journal: DataFrame, since, table: KeyedTable, rows: int | None):
    items = P.project_item_quantity(B.purchased(journal, since), P.STRICT)
    return _quantities(items, lambda some: table.dealt(some, rows), packed=not table.buckets)


def _delta_balance(journal: DataFrame, since, rounded: bool):
    charges = P.project_vendor_charge(B.purchased(journal, since), P.STRICT)
    measure = F.col("total_2dp") if rounded else F.col("total")
    return _balances(charges, measure, "decimal(21,2)" if rounded else "decimal(38,18)")


_HYDRATOR = {"item_quantity": POPULAR_ITEMS_HYDRATOR, "balance": VENDOR_BILLING_HYDRATOR,
             "billing": VENDOR_BILLING_HYDRATOR + "-2dp"}


def _delta(journal: DataFrame, kind: str, table: KeyedTable, since, rows: int | None):
    """(the totals of a journal's events, whether they lie as the table wants them, what gives (offset_ts, offset) of the
    newest event behind them once they are written). ``rows``: how many events there may be."""
    placed = kind == "item_quantity"
    delta = _delta_item_quantity(journal, since, table, rows) if placed \
        else _delta_balance(journal, since, kind == "billing")
    rows_seen, newest = _observed(delta)
    return rows_seen, placed, newest


def resume_point(table: KeyedTable, offsets: OffsetStore, hydrator: str):
    """(whether the table must be rebuilt, offset its rows reach).

    The table's own version says how far its rows reach: rows and offset are
    one commit. The offset row beside it is what users see and reset. Where it
    is only behind because a crash came between the two, it is stored now. A
    missing or later one otherwise means it was lost or reset, or belongs to
    another state of the table: then events could be lost or counted twice,
    and only the whole journal gives the right rows.
    """
    stored, applied = offsets.find(hydrator, TAG_ITEM_PURCHASED), table.version().applied
    stored = None if stored is None else (stored[1], stored[0])
    own = applied.get(hydrator)
    if own is None:
        return stored is not None or not table.is_empty(), None
    if any(other["version"] > own["version"] for other in applied.values()):
        return True, None  # another job, with resume points of its own, wrote since
    reached = tuple(json.loads(own["note"])) if own["note"] else None
    if reached is None:
        return False, None
    if not table.marked(hydrator) or (stored is not None and stored < reached):
        _store_offset(table, offsets, hydrator, reached)
        stored = reached
    return stored != reached, reached


def _store_offset(table: KeyedTable, offsets: OffsetStore, hydrator: str, reached: tuple) -> None:
    offsets.update(hydrator, TAG_ITEM_PURCHASED, reached[1], reached[0], force=True)
    table.mark(hydrator)


def catch_up(spark: SparkSession, journal: DataFrame, kind: str, table: KeyedTable, offsets: OffsetStore) -> bool:
    """T10 batch form for any read side: resume after the stored offset,
    aggregate only the new events, add them to the stored rows (J1), store
    the newest offset. Without a stored offset a table that has rows is
    rebuilt (T11). Returns whether anything was written.

    Rows and offset are one commit of the table; the offset row follows it,
    and is made good by the next run after a crash. The batch is named after
    the offset it starts from.

    kind: "item_quantity", "balance" (exact) or "billing" (2-dp; each event
    rounded before it is added, as the SQL read side does).
    """
    hydrator = _HYDRATOR[kind]
    lost, since = resume_point(table, offsets, hydrator)
    if lost:
        rebuild(spark, journal, kind, table, offsets, B.purchased(journal).count())
        return True
    rows = B.purchased(journal, since).count()
    return rows > 0 and _add_events(journal, kind, table, offsets, since, rows)


def _add_events(journal: DataFrame, kind: str, table: KeyedTable, offsets: OffsetStore, since, rows: int | None) -> bool:
    """Aggregate the events after ``since``, add them to the table with the offset they reach, then store that."""
    hydrator = _HYDRATOR[kind]
    measures, latest = ({"quantity": 0}, {"name": "name"}) if kind == "item_quantity" else ({"balance": 0}, None)
    delta, placed, newest = _delta(journal, kind, table, since, rows)
    batch_id = "after-" + ("start" if since is None else f"{since[0]}-{since[1]}")
    added = table.add(delta, measures, batch_id, latest=latest, writer=hydrator, placed=placed,
                      note=lambda: json.dumps(newest()) if newest() else "")
    if added:
        _store_offset(table, offsets, hydrator, newest())
    return added


def resumed_stream(spark: SparkSession, journal_path: str, kind: str, table: KeyedTable, offsets: OffsetStore,
                   until: tuple | None = None, max_events: int | None = None, interval: str = "0 seconds") -> Hydrator:
    """T10 as a stream: a read side that goes on where its stored offset says, without state and without an old
    checkpoint. The source (S1), the filter (P8), the offset table (S8) and the table's version share one resume point.

    Every micro-batch adds its events to the stored rows (J1) in one commit
    with their newest offset; events up to the table's own offset, as in a
    replayed batch, are left out. ``until`` stops after that event.
    """
    hydrator = _HYDRATOR[kind]
    lost, reached = resume_point(table, offsets, hydrator)
    if lost:
        rebuild(spark, read_journal(spark, journal_path), kind, table, offsets)
        _, reached = resume_point(table, offsets, hydrator)

    rows = B.purchased(read_journal(spark, journal_path), reached).count()
    rows = min(rows, max_events or rows)

    def sink(batch: DataFrame, batch_id: int) -> None:
        _add_events(batch, kind, table, offsets, resume_point(table, offsets, hydrator)[1], rows)

    # The offset is the resume point, so every start has a checkpoint of its own.
    checkpoint = os.path.join(checkpoint_root(spark), "streams", hydrator, uuid.uuid4().hex)
    events = stream_events(spark, journal_path, TAG_ITEM_PURCHASED, checkpoint, reached, until, max_events)
    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return Hydrator(hydrator, _start(spark, w, False, interval))


def rebuild(spark: SparkSession, journal: DataFrame, kind: str, table: KeyedTable, offsets: OffsetStore,
            rows: int | None = None) -> None:
    """Recompute a read side from the whole journal, replace the table
    (keys no longer produced by the journal disappear) and store the newest
    offset, so a following catch-up or stream resumes after it. ``rows``: how
    many events the journal holds, where known."""
    hydrator = _HYDRATOR[kind]
    full, placed, newest = _delta(journal, kind, table, None, rows)
    table.replace_all(full, lambda: json.dumps(newest()) if newest() else "", uuid.uuid4().hex, hydrator, placed)
    if newest() is not None:
        _store_offset(table, offsets, hydrator, newest())


def catch_up_item_quantity(spark: SparkSession, journal: DataFrame, table: KeyedTable, offsets: OffsetStore) -> bool:
    return catch_up(spark, journal, "item_quantity", table, offsets)
