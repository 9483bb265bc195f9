"""

Every query reads the driver's tables (through the fixture mappings in
carthouse.sources.fixtures) and runs over all of their rows.
"""

from __future__ import annotations

import functools
import importlib
import os
import sys
from collections.abc import Callable
from datetime import datetime, timezone

# The package lives next to this file; make it importable however this
# module was loaded.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carthouse.functions.ids import (GREGORIAN_TO_UNIX_100NS, sql_name_uuid, timeuuid_from_ticks,
                                     timeuuid_unix_millis)
from carthouse.functions.items import parse_item_json
from carthouse.functions.money import price_from_wire, price_to_wire
from carthouse.operators import aggregates as A
from carthouse.operators import carts as C
from carthouse.plans import batch as B
from carthouse.sources import fixtures as X
from carthouse.schemas import KAFKA_PRODUCER_ID, POPULAR_ITEMS_HYDRATOR, TAG_ITEM_PURCHASED
from carthouse.session import materialize, ship_package
from carthouse.sources.journal import decode_events, encode_events, with_offset_ts

SMOKE_DIR = "/root/testdata/sf0.001"

# Fixed values used by the registered queries.
TOP_K = 3
TOPIC = "item-purchased-events"
KAFKA_PARTITIONS = 8


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.purchase_journal(spark, sf_dir)


def q_item_quantity_by_day(spark, sf_dir):
    return B.item_quantity_by_day(_journal(spark, sf_dir), tasks=X.line_partitions(spark, sf_dir))


def q_balance_by_vendor(spark, sf_dir):
    return B.balance_by_vendor(_journal(spark, sf_dir))


def q_vendor_billing(spark, sf_dir):
    return B.vendor_billing(_journal(spark, sf_dir))


def q_top_items_per_day(spark, sf_dir):
    return B.top_items_per_day(_journal(spark, sf_dir), TOP_K, X.line_partitions(spark, sf_dir))


def q_purchases_by_cart(spark, sf_dir):
    return A.purchases_by_cart(_journal(spark, sf_dir)).select(
        "cart_id", "member_id", "item_count", "total_quantity", "total_billed",
        F.array_join(F.transform("items", lambda s: s["product_id"]), ",").alias("products"))


def q_purchase_records(spark, sf_dir):
    return B.purchase_records(_journal(spark, sf_dir), TOPIC, KAFKA_PARTITIONS).drop("offset", "offset_ts")


def q_journal_codec_roundtrip(spark, sf_dir):
    """S3 then S2 over the whole purchase journal; counts per tag and type
    of what decodes back (A1 inputs must survive the codec)."""
    back = decode_events(encode_events(_journal(spark, sf_dir)))
    return B.item_quantity_by_day(back, tasks=X.line_partitions(spark, sf_dir))


def _commands(spark, sf_dir):
    return X.command_log(spark, sf_dir)


def _cart_run(spark, sf_dir):
    return B.process_commands(_commands(spark, sf_dir))


def _cart_journal(spark, sf_dir):
    """The cart journal, written once: a replay reads it several times."""
    return materialize(_cart_run(spark, sf_dir)[2])


def q_command_verdicts(spark, sf_dir):
    verdicts, _, _ = _cart_run(spark, sf_dir)
    return verdicts.select("member_id", "seq", "command", "verdict")


def q_cart_events(spark, sf_dir):
    _, _, journal = _cart_run(spark, sf_dir)
    return journal.select("persistence_id", "seq_nr", "event_type", F.col("item.product_id").alias("product_id"),
                          F.col("item.quantity").alias("quantity"), "amount", "cart_id")


def q_checkout_items(spark, sf_dir):
    _, _, journal = _cart_run(spark, sf_dir)
    return journal.where(F.col("event_type") == "ItemPurchased").select(
        "persistence_id", "seq_nr", "cart_id", F.col("item.product_id").alias("product_id"),
        F.col("item.vendor_id").alias("vendor_id"), F.col("item.price").alias("price"),
        F.col("item.quantity").alias("quantity"))


def q_replay_carts(spark, sf_dir):
    journal = _cart_journal(spark, sf_dir)
    return C.replay_carts(journal)


# Snapshot point of the registered T4 query: every cart as of this instant.
SNAPSHOT_BEFORE = datetime(2024, 1, 15, tzinfo=timezone.utc)
SNAPSHOT_TICKS = int(SNAPSHOT_BEFORE.timestamp()) * 10_000_000 + GREGORIAN_TO_UNIX_100NS


def q_replay_from_snapshot(spark, sf_dir):
    """T4 law on the whole log: snapshot each cart at a cut point (S12),
    then replay snapshot + tail; must equal the full replay."""
    journal = _cart_journal(spark, sf_dir)
    head = journal.where(F.col("offset_ts") < F.lit(SNAPSHOT_TICKS))
    snaps = C.snapshot_from_lines(C.replay_carts(head), head)
    return C.replay_from_snapshot(journal, snaps)


def q_replay_from_checkout_snapshots(spark, sf_dir):
    """T4 with the snapshots a checkout leaves (empty carts at the last
    purchase); must equal the full replay."""
    journal = _cart_journal(spark, sf_dir)
    return C.replay_from_snapshot(journal, C.checkout_snapshots(journal))


def q_cart_contents(spark, sf_dir):
    cmds = _commands(spark, sf_dir)
    journal = _cart_journal(spark, sf_dir)
    members = cmds.select(F.concat(F.lit("cart-"), F.col("member_id")).alias("persistence_id"))
    c = C.cart_contents(journal, members)
    return c.select("persistence_id", F.size("items").alias("item_count"),
                    F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["quantity"]).alias("total_quantity"),
                    F.array_join(F.transform("items", lambda i: i["product_id"]), ",").alias("products"),
                    "cart_id")


def _scratch(spark, name):
    """A fresh folder under the session's shared checkpoint directory."""
    import uuid

    from carthouse.session import checkpoint_root
    return os.path.join(checkpoint_root(spark), "carthouse", f"{name}-{uuid.uuid4().hex}")


# Files of a streamed journal hold at most this many events, and a micro-batch
# reads this many files: its size does not follow the table's.
EVENTS_PER_FILE = 200_000
EVENTS_PER_BATCH = 500_000
FILES_PER_TRIGGER = 4


def _streamed_journal(spark, sf_dir, root):
    from carthouse.sources.journal import write_journal
    jp = os.path.join(root, "journal")
    write_journal(_journal(spark, sf_dir), jp, records_per_file=EVENTS_PER_FILE)
    return jp


def q_stream_item_quantity_by_day(spark, sf_dir):
    """The popular-items stream over the journal as files, several
    micro-batches, result read back from the upserted table."""
    from carthouse.sources.tables import item_quantity_table
    from carthouse.streaming.hydrators import item_quantity_stream
    root = _scratch(spark, "stream-item-quantity")
    jp = _streamed_journal(spark, sf_dir, root)
    item_quantity_stream(spark, jp, os.path.join(root, "table"), os.path.join(root, "offsets"),
                         checkpoint=os.path.join(root, "ckpt"), max_files_per_trigger=FILES_PER_TRIGGER).await_done()
    return item_quantity_table(spark, os.path.join(root, "table")).read()


def q_state_item_quantity(spark, sf_dir):
    """T1's state store after the stream, read as a table: the totals of A1."""
    from carthouse.streaming.hydrators import item_quantity_state, item_quantity_stream
    root = _scratch(spark, "state-item-quantity")
    jp, checkpoint = _streamed_journal(spark, sf_dir, root), os.path.join(root, "ckpt")
    item_quantity_stream(spark, jp, os.path.join(root, "table"), os.path.join(root, "offsets"), checkpoint=checkpoint,
                         max_files_per_trigger=FILES_PER_TRIGGER).await_done()
    return item_quantity_state(spark, checkpoint)


def q_stream_vendor_billing(spark, sf_dir):
    """T2 (2-dp form) as a stream, read back from its table."""
    from carthouse.sources.tables import billing_table
    from carthouse.streaming.hydrators import vendor_balance_stream
    root = _scratch(spark, "stream-vendor-billing")
    jp = _streamed_journal(spark, sf_dir, root)
    vendor_balance_stream(spark, jp, os.path.join(root, "table"), os.path.join(root, "offsets"), rounded=True,
                          checkpoint=os.path.join(root, "ckpt"), max_files_per_trigger=FILES_PER_TRIGGER).await_done()
    return billing_table(spark, os.path.join(root, "table")).read()


# Commands appended to the log at a time, and at most in one of its files.
COMMANDS_PER_APPEND = 1_000_000
COMMANDS_PER_FILE = 250_000


def _append_commands(commands, path):
    """The command log as it grows: slices of the sequence, one append after the
    other (four at least). In a slice each member's commands sit in one partition's
    files, and older files are read first, so a member's order holds across
    micro-batches; a micro-batch is bounded by files of a bounded size. A slice is
    dealt to the files of one trigger: more, smaller ones would make a micro-batch
    of each few of them, and its fixed cost would grow with their number."""
    slices = max(4, -(-commands.count() // COMMANDS_PER_APPEND))
    cuts = commands.select(F.percentile_approx("seq", [i / slices for i in range(1, slices)])).first()[0] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = commands.where((F.col("seq") > lo) if lo is not None else F.lit(True)) \
            .where((F.col("seq") <= hi) if hi is not None else F.lit(True))
        (part.repartition(FILES_PER_TRIGGER, "member_id").sortWithinPartitions("seq").write.mode("append")
         .option("maxRecordsPerFile", COMMANDS_PER_FILE).parquet(path))


def _stream_commands(spark, commands, name, snapshots=None):
    """Runs the command processor over a log; (where it writes events, its checkpoint)."""
    from carthouse.streaming.carts import start_commands
    from carthouse.streaming.hydrators import Hydrator
    root = _scratch(spark, name)
    log, events, checkpoint = (os.path.join(root, d) for d in ("commands", "events", "ckpt"))
    _append_commands(commands, log)
    Hydrator("commands", start_commands(spark, log, events, checkpoint, snapshots, FILES_PER_TRIGGER)).await_done()
    return events, checkpoint


def _event_columns(journal):
    return journal.select("persistence_id", "seq_nr", "event_type", F.col("item.product_id").alias("product_id"),
                          F.col("item.quantity").alias("quantity"), "amount", "cart_id")


def q_stream_cart_events(spark, sf_dir):
    """T7 stream form: the command log as ordered files through the
    per-member stateful processor; same columns as ``cart_events``."""
    from carthouse.sources.journal import read_journal
    events, _ = _stream_commands(spark, _commands(spark, sf_dir), "stream-cart-events")
    return _event_columns(read_journal(spark, events))


def q_stream_cart_state(spark, sf_dir):
    """The carts the T7 stream holds after the whole log, read from its state
    store: the lines a replay of the journal gives (T3)."""
    from carthouse.streaming.carts import cart_state
    _, checkpoint = _stream_commands(spark, _commands(spark, sf_dir), "stream-cart-state")
    return cart_state(spark, checkpoint)


def q_stream_from_snapshots(spark, sf_dir):
    """T4 with T7: snapshots (S12) are taken after the first half of the log and
    written; a stream starts from them, as they are read back, and takes the rest.
    Both halves' events must be those of one stream over everything."""
    from carthouse.sources.journal import read_journal
    from carthouse.sources.snapshots import read_snapshots, write_snapshots
    commands = _commands(spark, sf_dir)
    cut = commands.select(F.percentile_approx("seq", 0.5)).first()[0]
    verdicts, _, journal = B.process_commands(commands.where(F.col("seq") <= cut))
    head, path = materialize(journal), os.path.join(_scratch(spark, "snapshots"), "s")
    write_snapshots(C.cart_snapshots(verdicts, head), path)
    events, _ = _stream_commands(spark, commands.where(F.col("seq") > cut), "stream-from-snapshots",
                                 read_snapshots(spark, path))
    return _event_columns(head).unionByName(_event_columns(read_journal(spark, events)))


def _streamed_feed(spark, sf_dir, name, journal):
    """Runs the purchase feed over a journal; (the feed, its offset table)."""
    from carthouse.sources.journal import write_journal
    from carthouse.streaming.hydrators import purchase_feed_stream
    root = _scratch(spark, name)
    path, feed, offsets = (os.path.join(root, d) for d in ("journal", "feed", "offsets"))
    write_journal(journal, path, records_per_file=EVENTS_PER_FILE)
    purchase_feed_stream(spark, path, offsets, TOPIC, KAFKA_PARTITIONS, fallback_path=feed,
                         checkpoint=os.path.join(root, "ckpt"), max_files_per_trigger=FILES_PER_TRIGGER).await_done()
    return feed, offsets


def q_stream_purchase_records(spark, sf_dir):
    """The purchase feed as a stream into the file form of the topic (same frame), read back."""
    from carthouse.sources.feed import read_feed
    return read_feed(spark, _streamed_feed(spark, sf_dir, "stream-purchase-records", _journal(spark, sf_dir))[0])


def q_stream_producer_offset(spark, sf_dir):
    """The offset the feed stored for its producer, and how many records it acknowledged up to there."""
    from carthouse.sources.feed import acknowledged
    from carthouse.sources.tables import OffsetStore
    journal = X.purchase_journal(spark, sf_dir, renamed=True)
    feed, offsets = _streamed_feed(spark, sf_dir, "stream-producer-offset", journal)
    records = acknowledged(spark, feed).agg(F.sum("rows").alias("records"))
    return OffsetStore(spark, offsets, id_col="producer_id").table.read().crossJoin(records).drop("offset")


def q_stream_failure(spark, sf_dir):
    """Purchases of every seventh order lack their item. The strict read side must fail on them, not leave
    them out, and must store nothing of the batch it failed in."""
    from carthouse.sources.journal import write_journal
    from carthouse.sources.tables import item_quantity_table
    from carthouse.streaming.hydrators import item_quantity_stream
    root = _scratch(spark, "stream-failure")
    n = F.conv(F.substring(F.md5("cart_id"), 1, 8), 16, 10).cast("long")
    broken = _journal(spark, sf_dir).withColumn("item", F.when(n % 7 != 0, F.col("item")))
    path, table = os.path.join(root, "journal"), os.path.join(root, "table")
    write_journal(broken, path, records_per_file=EVENTS_PER_FILE)
    hydrator = item_quantity_stream(spark, path, table, os.path.join(root, "offsets"), checkpoint=os.path.join(root, "ckpt"))
    try:
        hydrator.await_done()
        failed = False
    except RuntimeError:
        failed = True
    stored = item_quantity_table(spark, table).read()
    return stored.agg(F.count(F.lit(1)).alias("stored_rows")).select(
        F.lit(hydrator.name).alias("hydrator"), F.lit(failed).alias("failed"), "stored_rows")


def q_stream_balance_by_vendor(spark, sf_dir):
    """T2, exact form, as a stream over the serialized journal."""
    from carthouse.sources.journal import write_raw_journal
    from carthouse.sources.tables import balance_table
    from carthouse.streaming.hydrators import vendor_balance_stream
    root = _scratch(spark, "stream-balance")
    jp = os.path.join(root, "journal")
    write_raw_journal(encode_events(_journal(spark, sf_dir)), jp, records_per_file=EVENTS_PER_FILE)
    vendor_balance_stream(spark, jp, os.path.join(root, "table"), os.path.join(root, "offsets"), raw=True,
                          checkpoint=os.path.join(root, "ckpt"), max_files_per_trigger=FILES_PER_TRIGGER).await_done()
    return balance_table(spark, os.path.join(root, "table")).read()


def _catch_up(spark, sf_dir, kind, make_table, lose_offsets=False):
    """The journal becomes visible in parts (the second cut lies inside
    the events of one time); each run resumes after the stored offset.
    ``lose_offsets``: the offset table is gone before the last part."""
    from carthouse.sources.journal import read_journal, write_journal
    from carthouse.sources.tables import OffsetStore
    from carthouse.streaming.hydrators import catch_up
    root = _scratch(spark, f"catch-up-{kind}")
    path = os.path.join(root, "journal")
    # Ticks cut to whole days, so that many events share a time.
    day = 864_000_000_000
    write_journal(_journal(spark, sf_dir).withColumn("offset_ts", F.expr(f"offset_ts div {day} * {day}")), path)
    journal = read_journal(spark, path)
    table, offsets = make_table(spark, os.path.join(root, "table")), OffsetStore(spark, os.path.join(root, "offsets"))
    cuts = journal.selectExpr("percentile_approx(offset_ts, array(0.3, 0.6))").first()[0]
    part = journal.where(F.col("offset_ts") == cuts[1]).selectExpr("percentile_approx(conv(substr(offset, 1, 4), 16, 10), 0.5)")
    inside = f"{int(part.first()[0]):04x}"
    order = F.struct("offset_ts", "offset")
    for visible in (journal.where(F.col("offset_ts") <= cuts[0]),
                    journal.where(order <= F.struct(F.lit(cuts[1]).alias("offset_ts"), F.lit(inside).alias("offset"))),
                    journal):
        if lose_offsets and visible is journal:
            offsets = OffsetStore(spark, os.path.join(root, "new-offsets"))
        catch_up(spark, visible, kind, table, offsets)
    return table.read()


def q_stream_resumed(spark, sf_dir):
    """A stream by the journal's own offsets stops inside the events of one time; another
    one, without its checkpoint, goes on after the stored offset."""
    from carthouse.sources.journal import STRETCH_BYTES, read_journal, write_journal
    from carthouse.sources.tables import OffsetStore, item_quantity_table
    from carthouse.streaming.hydrators import resumed_stream
    root = _scratch(spark, "stream-resumed")
    path = os.path.join(root, "journal")
    day = 864_000_000_000  # ticks cut to whole days, so that many events share a time
    write_journal(_journal(spark, sf_dir).withColumn("offset_ts", F.expr(f"offset_ts div {day} * {day}")), path,
                  records_per_file=EVENTS_PER_FILE, row_group_bytes=STRETCH_BYTES)
    journal = read_journal(spark, path)
    at = journal.select(F.percentile_approx("offset_ts", 0.5)).first()[0]
    # An event about in the middle of that time.
    inside = journal.where(F.col("offset_ts") == at).select(
        F.percentile_approx(F.conv(F.substring("offset", 1, 8), 16, 10).cast("long"), 0.5)).first()[0]
    until = (at, f"{inside:08x}-ffff")
    table, offsets = item_quantity_table(spark, os.path.join(root, "t")), OffsetStore(spark, os.path.join(root, "o"))
    resumed_stream(spark, path, "item_quantity", table, offsets, until=until).drain()
    resumed_stream(spark, path, "item_quantity", table, offsets, max_events=EVENTS_PER_BATCH).drain()
    return table.read()


def q_catch_up_item_quantity(spark, sf_dir):
    from carthouse.sources.tables import item_quantity_table
    return _catch_up(spark, sf_dir, "item_quantity", item_quantity_table)


def q_catch_up_co_partitioned(spark, sf_dir):
    """J1 on a table in hash buckets: the stored rows stay where they are, the delta alone is shuffled."""
    from carthouse.sources.tables import item_quantity_table
    return _catch_up(spark, sf_dir, "item_quantity", lambda s, path: item_quantity_table(s, path, buckets=16))


def q_catch_up_balance(spark, sf_dir):
    from carthouse.sources.tables import balance_table
    return _catch_up(spark, sf_dir, "balance", balance_table)


def q_catch_up_after_reset(spark, sf_dir):
    """T10 without a stored offset on a table that has rows: everything is read again."""
    from carthouse.sources.tables import item_quantity_table
    return _catch_up(spark, sf_dir, "item_quantity", item_quantity_table, lose_offsets=True)


def q_rebuild_item_quantity(spark, sf_dir):
    """T11, stored form: rebuilt over a table that already holds other rows."""
    from carthouse.sources.tables import OffsetStore, item_quantity_table
    from carthouse.streaming.hydrators import rebuild
    root = _scratch(spark, "rebuild")
    table, offsets = item_quantity_table(spark, os.path.join(root, "t")), OffsetStore(spark, os.path.join(root, "o"))
    lines = X.table(spark, sf_dir, "lineitem").count()
    stale = B.item_quantity_by_day(_journal(spark, sf_dir), deal=lambda items: table.dealt(items, lines))
    table.upsert(stale.withColumn("year", F.col("year") + 100), "stale", placed=True)
    rebuild(spark, _journal(spark, sf_dir), "item_quantity", table, offsets, lines)
    return table.read()


def q_latest_name(spark, sf_dir):
    """A2 where every purchase carries a name of its own: the latest one counts."""
    return B.item_quantity_by_day(X.purchase_journal(spark, sf_dir, renamed=True), tasks=X.line_partitions(spark, sf_dir))


def q_purchase_records_permissive(spark, sf_dir):
    """P5: every seventh order's events lose their cart id, every fifth their
    item; the feed leaves such events out."""
    j = _journal(spark, sf_dir)
    n = F.conv(F.substring(F.md5("cart_id"), 1, 8), 16, 10).cast("long")
    broken = j.withColumn("item", F.when(n % 5 != 0, F.col("item"))) \
        .withColumn("cart_id", F.when(n % 7 != 0, F.col("cart_id")))
    return B.purchase_records(broken, TOPIC, KAFKA_PARTITIONS).drop("offset", "offset_ts")


def q_cart_journal_codec(spark, sf_dir):
    """S3 then S2 over all five event types of the cart journal."""
    journal = decode_events(encode_events(_cart_run(spark, sf_dir)[2]))
    return journal.select("persistence_id", "seq_nr", "event_type", F.col("item.product_id").alias("product_id"),
                          F.col("item.quantity").alias("quantity"), "amount", "cart_id")


def q_find_item_quantity(spark, sf_dir):
    """The stored quantity of every key that other tables name. Each line asks for
    its own vendor, product and day, and for those of the next vendor: some are absent."""
    from carthouse.sources.tables import item_quantity_table
    table = item_quantity_table(spark, os.path.join(_scratch(spark, "find-item-quantity"), "t"))
    count = X.table(spark, sf_dir, "lineitem").count()
    table.upsert(B.item_quantity_by_day(_journal(spark, sf_dir), deal=lambda items: table.dealt(items, count)), 0, placed=True)
    lines = X.table(spark, sf_dir, "lineitem").join(X.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    vendor = F.explode(F.array(F.col("l_suppkey"), F.col("l_suppkey") + 1))
    # Staged as numbers: the texts made of them would be several times as large.
    named = materialize(lines.select(vendor.alias("vendor"), "l_partkey", F.to_date("o_orderdate").alias("at")).distinct())
    keys = named.select(
        X.vendor_uuid(F.col("vendor")).alias("vendor_id"), X.product_uuid(F.col("l_partkey")).alias("product_id"),
        F.year("at").alias("year"), F.month("at").alias("month"), F.dayofmonth("at").alias("day"))
    return table.read_keys(keys, absent=True).select(*table.key, "quantity", "name")


def q_vendor_months(spark, sf_dir):
    """Each vendor's stored balances of a year in clustering order, latest month first."""
    from carthouse.sources.tables import balance_table
    table = balance_table(spark, os.path.join(_scratch(spark, "vendor-months"), "t"))
    table.upsert(B.balance_by_vendor(_journal(spark, sf_dir)), 0)
    latest_first = Window.partitionBy("vendor_id", "year").orderBy(F.desc("month"))
    return table.read().withColumn("nth", F.row_number().over(latest_first))


def q_parse_item_json(spark, sf_dir):
    """item JSON of every line (every ninth order without a price), decoded."""
    li = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = li.join(X.table(spark, sf_dir, "part"), li.l_partkey == F.col("p_partkey"))
    text = F.to_json(F.struct(
        F.upper(X.product_uuid(F.col("l_partkey"))).alias("productId"), X.vendor_uuid(F.col("l_suppkey")).alias("vendorId"),
        F.col("p_name").alias("name"),
        F.when(F.col("l_orderkey") % 9 != 0, price_to_wire(price_from_wire(F.col("p_retailprice")))).alias("price"),
        F.col("l_quantity").cast("int").alias("quantity")))
    got = parse_item_json(text)
    return rows.select("l_orderkey", "l_linenumber", got["item"]["product_id"].alias("product_id"),
                       got["item"]["price"].alias("price"), got["item"]["quantity"].alias("quantity"),
                       F.array_join(got["errors"], ";").alias("errors"))


def q_offset_ticks(spark, sf_dir):
    """the time of a version-1 offset, read back from its text."""
    o = X.table(spark, sf_dir, "orders")
    ticks = F.col("o_orderkey") * 1_000_003 + F.lit(GREGORIAN_TO_UNIX_100NS)
    text = timeuuid_from_ticks(ticks, F.col("o_custkey"), F.col("o_orderkey"))
    return with_offset_ts(o.select("o_orderkey", text.alias("offset"), F.lit(None).cast("long").alias("offset_ts"))).select(
        "o_orderkey", "offset_ts", timeuuid_unix_millis(F.col("offset")).alias("millis"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the popular-items read side over the sf0.001 purchases."""
    return q_item_quantity_by_day(spark, SMOKE_DIR)


def _optional(module: str):
    """A module of the optional subpackage, or None where it or anything it needs is not installed."""
    try:
        return importlib.import_module(module)
    except ImportError:
        return None


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered, pipeline = _optional("carthouse.llm.queries"), _optional("corpus_pipeline")
    if numbered is None:
        return {}
    return dict(numbered.QUERIES) | ({"pipeline": pipeline.run} if pipeline else {})


def _llm_oracles() -> dict[str, str]:
    numbered, pipeline = _optional("carthouse.llm.queries"), _optional("corpus_pipeline")
    if numbered is None:
        return {}
    return dict(numbered.ORACLE_SQL) | ({"pipeline": pipeline.ORACLE_SQL} if pipeline and pipeline.ORACLE_SQL else {})


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _llm_queries() | {
        "item_quantity_by_day": q_item_quantity_by_day,
        "balance_by_vendor": q_balance_by_vendor,
        "vendor_billing": q_vendor_billing,
        "top_items_per_day": q_top_items_per_day,
        "purchases_by_cart": q_purchases_by_cart,
        "purchase_records": q_purchase_records,
        "journal_codec_roundtrip": q_journal_codec_roundtrip,
        "command_verdicts": q_command_verdicts,
        "cart_events": q_cart_events,
        "checkout_items": q_checkout_items,
        "replay_carts": q_replay_carts,
        "replay_from_snapshot": q_replay_from_snapshot,
        "cart_contents": q_cart_contents,
        "replay_from_checkout_snapshots": q_replay_from_checkout_snapshots,
        "stream_purchase_records": q_stream_purchase_records,
        "stream_item_quantity_by_day": q_stream_item_quantity_by_day,
        "stream_vendor_billing": q_stream_vendor_billing,
        "stream_cart_events": q_stream_cart_events,
        "stream_cart_state": q_stream_cart_state,
        "stream_from_snapshots": q_stream_from_snapshots,
        "state_item_quantity": q_state_item_quantity,
        "stream_resumed": q_stream_resumed,
        "stream_producer_offset": q_stream_producer_offset,
        "stream_failure": q_stream_failure,
        "catch_up_after_reset": q_catch_up_after_reset,
        "vendor_months": q_vendor_months,
        "stream_balance_by_vendor": q_stream_balance_by_vendor,
        "catch_up_item_quantity": q_catch_up_item_quantity,
        "catch_up_co_partitioned": q_catch_up_co_partitioned,
        "catch_up_balance": q_catch_up_balance,
        "rebuild_item_quantity": q_rebuild_item_quantity,
        "latest_name": q_latest_name,
        "purchase_records_permissive": q_purchase_records_permissive,
        "cart_journal_codec": q_cart_journal_codec,
        "find_item_quantity": q_find_item_quantity,
        "parse_item_json": q_parse_item_json,
        "offset_ticks": q_offset_ticks,
    }
    return {name: _shipped(query) for name, query in found.items()}


# ----------------------------------------------------------------------------
# Oracle SQL (DuckDB). The fixture mapping written out in SQL.

def _u(expr: str) -> str:
    return sql_name_uuid(expr)


_PURCHASES = f"""
  SELECT {_u("'vendor-' || CAST(l_suppkey AS VARCHAR)")} AS vendor_id,
         {_u("'product-' || CAST(l_partkey AS VARCHAR)")} AS product_id,
         {_u("'cart-' || CAST(l_orderkey AS VARCHAR)")} AS cart_id,
         'cart-' || {_u("'member-' || CAST(o_custkey AS VARCHAR)")} AS member_id,
         p_name AS name, p_retailprice AS price, CAST(l_quantity AS INTEGER) AS quantity,
         o_orderdate, o_custkey, l_orderkey, l_linenumber,
         CAST(CAST(CAST(p_retailprice * CAST(l_quantity AS INTEGER) AS DOUBLE) AS VARCHAR)
              AS DECIMAL(38,18)) AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""

_BY_DAY = f"""
  SELECT vendor_id, product_id,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(day(o_orderdate) AS INTEGER) AS day,
         CAST(sum(quantity) AS BIGINT) AS quantity, max(name) AS name
  FROM ({_PURCHASES}) p
  GROUP BY ALL
"""


_BILLING = f"""
  SELECT vendor_id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(sum(CAST(total AS DECIMAL(21,2))) AS DECIMAL(21,2)) AS balance
  FROM ({_PURCHASES}) p GROUP BY ALL"""


_BALANCE = f"""
  SELECT vendor_id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(sum(total) AS DECIMAL(38,18)) AS balance
  FROM ({_PURCHASES}) p GROUP BY ALL"""


def _java_hash_sql(expr: str) -> str:
    h = (f"list_reduce(list_transform(str_split({expr}, ''), lambda ch: CAST(unicode(ch) AS BIGINT)), "
         f"lambda acc, c: (acc * 31 + c) % 4294967296, CAST(0 AS BIGINT))")
    return f"(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)"


_RECORDS = f"""
  SELECT '{TOPIC}' AS topic,
         CAST((({_java_hash_sql('member_id')}) % {KAFKA_PARTITIONS} + {KAFKA_PARTITIONS}) % {KAFKA_PARTITIONS}
              AS INTEGER) AS partition,
         member_id AS key,
         '{{"time":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
            CASE WHEN (o_custkey % 25) = 12 THEN 'Z'
                 ELSE (CASE WHEN (o_custkey % 25) < 12 THEN '-' ELSE '+' END) ||
                      lpad(CAST(abs((o_custkey % 25) - 12) AS VARCHAR), 2, '0') || ':00' END ||
         '","name":' || to_json(name) || ',"price":' || CAST(price AS VARCHAR) ||
         ',"quantity":' || CAST(quantity AS VARCHAR) || ',"productId":"' || product_id ||
         '","vendorId":"' || vendor_id || '","cartId":"' || cart_id || '","memberId":"' || member_id || '"}}'
           AS value
  FROM ({_PURCHASES}) p"""


# The command log and a brute-force fold: each row's cart state is the
# reduction of every earlier row of its (member, product, epoch).
_ABSENT = -1000000000
_STEP = (f"lambda acc, x: CASE WHEN x.c = 'AddItem' THEN (CASE WHEN acc = {_ABSENT} THEN x.q ELSE acc END) "
         f"WHEN x.c = 'RemoveItem' THEN {_ABSENT} "
         f"WHEN acc = {_ABSENT} THEN {_ABSENT} WHEN acc + x.d > 0 THEN acc + x.d ELSE acc END")

_COMMANDS = f"""
  SELECT {_u("'member-' || CAST(user_id AS VARCHAR)")} AS member_id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'AddItem' WHEN 'click' THEN 'AdjustQuantity'
              WHEN 'view' THEN 'AdjustQuantity' WHEN 'error' THEN 'RemoveItem' ELSE 'Checkout' END AS command,
         {_u("'product-' || CAST(k % 10 AS VARCHAR)")} AS product,
         {_u("'vendor-' || CAST(k % 3 AS VARCHAR)")} AS vendor_id, value AS price,
         'product-' || CAST(k % 10 AS VARCHAR) AS name,
         CASE WHEN event_type = 'signup' THEN CAST(1 + k % 5 AS INTEGER) END AS add_qty,
         CASE WHEN event_type = 'click' THEN CAST(1 + k % 3 AS INTEGER)
              WHEN event_type = 'view' THEN CAST(-(1 + k % 3) AS INTEGER) END AS delta
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
  WHERE event_type IN ('signup', 'click', 'view', 'error', 'purchase')
"""

_FOLDED = f"""
  WITH e AS (
    SELECT *, coalesce(max(CASE WHEN command = 'Checkout' THEN seq END) OVER (
                PARTITION BY member_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS epoch
    FROM ({_COMMANDS}) c),
  p AS (
    SELECT *,
      coalesce(list({{'c': command, 'q': add_qty, 'd': delta}}) OVER (
        PARTITION BY member_id, product, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        CAST([] AS STRUCT(c VARCHAR, q INTEGER, d INTEGER)[])) AS hist,
      list({{'c': command, 'q': add_qty, 'd': delta}}) OVER (
        PARTITION BY member_id, product, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        AS whole
    FROM e WHERE command <> 'Checkout'),
  s AS (
    SELECT *, list_reduce(hist, {_STEP}, {_ABSENT}) AS q_before, list_reduce(whole, {_STEP}, {_ABSENT}) AS q_end
    FROM p)
  SELECT *, CASE
      WHEN command = 'AddItem' AND q_before <> {_ABSENT} THEN 'ItemAlreadyInCart'
      WHEN command IN ('RemoveItem', 'AdjustQuantity') AND q_before = {_ABSENT} THEN 'ItemNotInCart'
      WHEN command = 'AdjustQuantity' AND q_before + delta <= 0 THEN 'NegativeQuantity' END AS verdict
  FROM s
"""

_ENDS = f"""
  SELECT member_id, epoch, product, max(q_end) AS quantity,
         arg_max(vendor_id, seq) FILTER (WHERE command = 'AddItem' AND verdict IS NULL) AS vendor_id,
         arg_max(price, seq) FILTER (WHERE command = 'AddItem' AND verdict IS NULL) AS price,
         arg_max(name, seq) FILTER (WHERE command = 'AddItem' AND verdict IS NULL) AS name
  FROM ({_FOLDED}) f GROUP BY ALL HAVING max(q_end) <> {_ABSENT}
"""

_CHECKOUTS = f"""
  SELECT c.member_id, c.seq, c.epoch,
         CASE WHEN EXISTS (SELECT 1 FROM ({_ENDS}) n WHERE n.member_id = c.member_id AND n.epoch = c.epoch)
              THEN NULL ELSE 'EmptyCartCheckout' END AS verdict
  FROM (SELECT *, coalesce(max(CASE WHEN command = 'Checkout' THEN seq END) OVER (
              PARTITION BY member_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS epoch
        FROM ({_COMMANDS}) x) c
  WHERE c.command = 'Checkout'
"""


def _cart_id_sql(member: str, epoch: str) -> str:
    return _u(f"'cart/' || {member} || '/' || CAST({epoch} AS VARCHAR)")


_ACCEPTED = f"SELECT member_id, seq FROM ({_CHECKOUTS}) k WHERE verdict IS NULL"


def _cart_epoch_sql(member: str, epoch: str) -> str:
    """The accepted checkout that opened the cart of an epoch (-1: none)."""
    return (f"coalesce((SELECT max(a.seq) FROM ({_ACCEPTED}) a WHERE a.member_id = {member} "
            f"AND a.seq <= {epoch}), -1)")


_EVENTS_X = f"""
  WITH ev AS (
    SELECT member_id, seq, 0 AS sub, epoch,
           CASE command WHEN 'AddItem' THEN 'ItemAdded' WHEN 'RemoveItem' THEN 'ItemRemoved'
                ELSE (CASE WHEN delta > 0 THEN 'ItemQuantityIncreased' ELSE 'ItemQuantityDecreased' END) END
             AS event_type,
           product AS product_id,
           CAST(CASE WHEN command = 'AddItem' THEN add_qty ELSE q_before END AS INTEGER) AS quantity,
           CAST(CASE WHEN command = 'AdjustQuantity' THEN abs(delta) END AS INTEGER) AS amount
    FROM ({_FOLDED}) f WHERE verdict IS NULL
    UNION ALL
    SELECT c.member_id, c.seq, row_number() OVER (PARTITION BY c.member_id, c.seq ORDER BY n.product) AS sub,
           c.epoch, 'ItemPurchased', n.product, CAST(n.quantity AS INTEGER), CAST(NULL AS INTEGER)
    FROM ({_CHECKOUTS}) c JOIN ({_ENDS}) n ON n.member_id = c.member_id AND n.epoch = c.epoch
    WHERE c.verdict IS NULL),
  ev2 AS (SELECT ev.*, {_cart_epoch_sql('ev.member_id', 'ev.epoch')} AS cart_epoch FROM ev)
  SELECT 'cart-' || member_id AS persistence_id,
         CAST(row_number() OVER (PARTITION BY member_id ORDER BY seq, sub) AS BIGINT) AS seq_nr,
         event_type, product_id, quantity, amount, {_cart_id_sql('member_id', 'cart_epoch')} AS cart_id,
         member_id, epoch
  FROM ev2
"""

_EVENTS = f"""
  SELECT persistence_id, seq_nr, event_type, product_id, quantity, amount, cart_id FROM ({_EVENTS_X}) x
"""

_LINES = f"""
  SELECT 'cart-' || n.member_id AS persistence_id, n.product AS product_id, n.vendor_id,
         n.name, n.price, CAST(n.quantity AS INTEGER) AS quantity,
         {_cart_id_sql('n.member_id', _cart_epoch_sql('n.member_id', 'n.epoch'))} AS cart_id
  FROM ({_ENDS}) n
  JOIN (SELECT member_id, coalesce(max(CASE WHEN command = 'Checkout' THEN seq END), -1) AS cur
        FROM ({_COMMANDS}) c GROUP BY member_id) m ON m.member_id = n.member_id AND m.cur = n.epoch
"""


def oracle_sql() -> dict[str, str]:
    return _llm_oracles() | {
        "item_quantity_by_day": _BY_DAY,
        "balance_by_vendor": _BALANCE,
        "vendor_billing": _BILLING,
        "stream_vendor_billing": _BILLING,
        "top_items_per_day": f"""
  SELECT * FROM (
    SELECT *, CAST(rank() OVER (PARTITION BY year, month, day ORDER BY quantity DESC) AS INTEGER) AS rank
    FROM ({_BY_DAY}) d) WHERE rank <= {TOP_K}""",
        "purchases_by_cart": f"""
  SELECT cart_id, min(member_id) AS member_id, count(*) AS item_count,
         CAST(sum(quantity) AS BIGINT) AS total_quantity,
         CAST(sum(CAST(total AS DECIMAL(21,2))) AS DECIMAL(21,2)) AS total_billed,
         array_to_string(list_sort(list(product_id)), ',') AS products
  FROM ({_PURCHASES}) p GROUP BY cart_id""",
        "purchase_records": _RECORDS,
        "stream_purchase_records": _RECORDS,
        "journal_codec_roundtrip": _BY_DAY,
        "command_verdicts": f"""
  SELECT member_id, seq, command, verdict FROM ({_FOLDED}) f
  UNION ALL
  SELECT member_id, seq, 'Checkout' AS command, verdict FROM ({_CHECKOUTS}) c""",
        "cart_events": _EVENTS,
        "checkout_items": f"""
  SELECT persistence_id, seq_nr, cart_id, product_id, vendor_id, price, quantity FROM (
    SELECT e.*, n.vendor_id, n.price FROM ({_EVENTS_X}) e
    JOIN ({_ENDS}) n ON e.member_id = n.member_id AND e.epoch = n.epoch AND e.product_id = n.product
    WHERE e.event_type = 'ItemPurchased')""",
        "replay_carts": _LINES,
        "stream_item_quantity_by_day": _BY_DAY,
        "stream_cart_events": _EVENTS,
        "stream_cart_state": f"SELECT persistence_id, product_id, vendor_id, name, price, quantity FROM ({_LINES}) l",
        "stream_from_snapshots": _EVENTS,
        "state_item_quantity": _BY_DAY,
        "stream_resumed": _BY_DAY,
        "stream_producer_offset": f"""
  SELECT '{KAFKA_PRODUCER_ID}' AS producer_id, '{TAG_ITEM_PURCHASED}' AS tag, count(*) AS records,
         max((epoch_us(o_orderdate) - (o_custkey % 25 - 12) * 3600000000) * 10 + {GREGORIAN_TO_UNIX_100NS}
             + l_orderkey * 8 + l_linenumber) AS offset_ts FROM ({_PURCHASES}) p""",
        "stream_failure": f"""
  SELECT '{POPULAR_ITEMS_HYDRATOR}' AS hydrator, count(*) > 0 AS failed, CAST(0 AS BIGINT) AS stored_rows
  FROM ({_PURCHASES}) p WHERE CAST(('0x' || substr(md5(cart_id), 1, 8)) AS BIGINT) % 7 = 0""",
        "catch_up_after_reset": _BY_DAY,
        "vendor_months": f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY vendor_id, year ORDER BY month DESC) AS INTEGER) AS nth
  FROM ({_BALANCE}) b""",
        "stream_balance_by_vendor": _BALANCE,
        "catch_up_item_quantity": _BY_DAY,
        "catch_up_co_partitioned": _BY_DAY,
        "catch_up_balance": _BALANCE,
        "rebuild_item_quantity": _BY_DAY,
        "latest_name": f"""
  SELECT vendor_id, product_id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(day(o_orderdate) AS INTEGER) AS day, CAST(sum(quantity) AS BIGINT) AS quantity,
         arg_max(name || ' ' || l_orderkey || ' ' || l_linenumber,
                 (epoch_us(o_orderdate) - (o_custkey % 25 - 12) * 3600000000) * 10 + l_orderkey * 8 + l_linenumber) AS name
  FROM ({_PURCHASES}) p GROUP BY ALL""",
        "purchase_records_permissive": f"""
  SELECT topic, partition, key, value FROM (
    SELECT *, CAST(('0x' || substr(md5(substr(value, strpos(value, '"cartId":"') + 10, 36)), 1, 8)) AS BIGINT) AS n
    FROM ({_RECORDS}) r) WHERE n % 5 <> 0 AND n % 7 <> 0""",
        "cart_journal_codec": _EVENTS,
        "find_item_quantity": f"""
  SELECT k.*, d.quantity, d.name FROM (
    SELECT DISTINCT {_u("'vendor-' || CAST(unnest([l_suppkey, l_suppkey + 1]) AS VARCHAR)")} AS vendor_id,
           {_u("'product-' || CAST(l_partkey AS VARCHAR)")} AS product_id, CAST(year(o_orderdate) AS INTEGER) AS year,
           CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) k
  LEFT JOIN ({_BY_DAY}) d USING (vendor_id, product_id, year, month, day)""",
        "parse_item_json": f"""
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 9 <> 0 THEN {_u("'product-' || CAST(l_partkey AS VARCHAR)")} END AS product_id,
         CASE WHEN l_orderkey % 9 <> 0 THEN p_retailprice END AS price,
         CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_quantity AS INTEGER) END AS quantity,
         CASE WHEN l_orderkey % 9 = 0 THEN 'price: missing or invalid' ELSE '' END AS errors
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "offset_ticks": f"""
  SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000003 + {GREGORIAN_TO_UNIX_100NS} AS offset_ts,
         CAST(o_orderkey AS BIGINT) * 1000003 // 10000 AS millis FROM orders""",
        "replay_from_snapshot": _LINES,
        "replay_from_checkout_snapshots": _LINES,
        "cart_contents": f"""
  SELECT m.persistence_id, CAST(count(l.product_id) AS INTEGER) AS item_count,
         CAST(coalesce(sum(l.quantity), 0) AS BIGINT) AS total_quantity,
         coalesce(array_to_string(list_sort(list(l.product_id)), ','), '') AS products,
         max(l.cart_id) AS cart_id
  FROM (SELECT DISTINCT 'cart-' || member_id AS persistence_id FROM ({_COMMANDS}) c) m
  LEFT JOIN ({_LINES}) l ON l.persistence_id = m.persistence_id
  GROUP BY m.persistence_id""",
    }
