"""Journal: tagging, tag/offset scans, codec, the two bad-record policies,
latest-name-by-offset."""

import pytest
from pyspark.sql import functions as F

from carthouse.operators import aggregates as A
from carthouse.operators import projections as P
from carthouse.plans import batch as B
from carthouse.schemas import JOURNAL
from carthouse.sources import fixtures as X
from carthouse.sources.journal import decode_events, encode_events, events_by_tag

from conftest import SF_SMALL

V = "3c1d7a52-6f0e-4b1c-9d77-0a5b8e2f4c10"
PID = "b7e4c2d9-1a3f-4e58-8c66-5d20f9a1e734"
CART = "5e8f0b36-72c4-4d9a-b1e3-c47a6d85f902"


def ev(seq, offset_ts, etype="ItemPurchased", name="A", qty=1, price=1.0, time="2018-01-31T23:30:00-05:00",
       cart=CART, vendor=V, product=PID, item=True):
    it = (product, vendor, name, price, qty) if item else None
    return ("cart-m", seq, f"o{offset_ts}", offset_ts, etype, None, cart, it, None, time)


def journal(spark, rows):
    return P.tag_events(spark.createDataFrame(rows, JOURNAL))


def test_tags_and_tag_scan(spark):
    j = journal(spark, [ev(1, 10), ev(2, 20, "ItemAdded"), ev(3, 30), ev(4, 5, "Unknown")])
    tags = {r.seq_nr: r.tags for r in j.collect()}
    assert tags[1] == ["item-purchased", "cart-event"] and tags[4] == []
    got = [r.seq_nr for r in events_by_tag(j, "item-purchased", 10).collect()]
    assert got == [3]
    assert [r.seq_nr for r in events_by_tag(j, "cart-event").collect()] == [1, 2, 3]


def test_tag_filter_reaches_the_parquet_scan(spark, scratch):
    from carthouse.sources.journal import read_journal, write_journal
    write_journal(journal(spark, [ev(1, 10), ev(2, 20)]), scratch + "/j")
    write_journal(journal(spark, [ev(3, 30, "ItemAdded")]), scratch + "/j")
    df = events_by_tag(read_journal(spark, scratch + "/j"), "item-purchased", 10)
    assert [r.seq_nr for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan and "item-purchased" in plan
    assert "PushedFilters" in plan and "offset_ts" in plan


def test_latest_name_follows_offset_order_not_arrival(spark):
    # name B has the later offset but arrives first
    j = journal(spark, [ev(2, 200, name="B"), ev(1, 100, name="A")])
    r = B.item_quantity_by_day(j).first()
    assert (r.name, r.quantity, r.year, r.month, r.day) == ("B", 2, 2018, 1, 31)


def test_strict_fails_on_malformed(spark):
    for bad in (ev(1, 1, vendor=None), ev(1, 1, item=False), ev(1, 1, product="not-a-uuid"),
                ev(1, 1, time="yesterday")):
        with pytest.raises(Exception, match="malformed ItemPurchased"):
            B.item_quantity_by_day(journal(spark, [ev(2, 2), bad])).collect()


def test_vendor_charge_needs_a_product_id(spark):
    with pytest.raises(Exception, match="malformed ItemPurchased"):
        B.balance_by_vendor(journal(spark, [ev(1, 1, product=None)])).collect()


def test_permissive_drops_missing_item_but_fails_on_bad_id(spark):
    ok = P.project_item_details(journal(spark, [ev(1, 1), ev(2, 2, item=False), ev(3, 3, cart=None)]),
                                P.PERMISSIVE)
    assert ok.count() == 1
    with pytest.raises(Exception, match="malformed ItemPurchased"):
        P.project_item_details(journal(spark, [ev(1, 1, product="bad")]), P.PERMISSIVE).collect()


def test_codec_round_trip(spark):
    j = X.purchase_journal(spark, SF_SMALL)
    raw = encode_events(j)
    assert set(r.manifest for r in raw.select("manifest").distinct().collect()) == {"ItemPurchased"}
    back = decode_events(raw)
    cols = [f.name for f in JOURNAL.fields]
    assert back.select(*cols).exceptAll(j.select(*cols)).count() == 0
    assert back.count() == j.count()


def test_codec_keeps_amount_and_time_field_per_type(spark):
    rows = [ev(1, 1, "ItemAdded"), ("cart-m", 2, "o2", 2, "ItemQuantityIncreased", None, CART,
                                    (PID, V, "A", 1.0, 1), 3, "2018-01-01T00:00:00Z")]
    j = journal(spark, rows)
    raw = encode_events(j).collect()
    assert '"timeAdded"' in raw[0].payload and '"amount":3' in raw[1].payload and '"time"' in raw[1].payload
    back = decode_events(spark.createDataFrame(raw)).orderBy("seq_nr").collect()
    assert back[1].amount == 3 and back[0].event_time == "2018-01-31T23:30:00-05:00"


def test_last_offset(spark):
    j = journal(spark, [ev(1, 30), ev(2, 10)])
    r = A.last_offset(j, "hydrator_id", "h", "item-purchased").first()
    assert (r.offset, r.offset_ts, r.hydrator_id) == ("o30", 30, "h")


def test_offset_time_order_beats_string_order(spark):
    """Two time-UUID offsets whose text order is the reverse of their time
    order: the later *time* names the product."""
    import uuid as _uuid

    from carthouse.sources.journal import with_offset_ts

    def tu(ticks):
        return str(_uuid.UUID(fields=(ticks & 0xFFFFFFFF, (ticks >> 32) & 0xFFFF, ((ticks >> 48) & 0x0FFF) | 0x1000,
                                      0x80, 0x01, 0x0A0B0C0D0E0F)))
    early, late = tu(0x1E0000000000001), tu(0x1E0000100000000)
    assert late < early  # text order says "late" comes first
    rows = [("cart-m", 1, early, None, "ItemPurchased", None, CART, (PID, V, "EARLY", 1.0, 1), None,
             "2018-01-31T23:30:00-05:00"),
            ("cart-m", 2, late, None, "ItemPurchased", None, CART, (PID, V, "LATE", 1.0, 1), None,
             "2018-01-31T23:30:00-05:00")]
    j = with_offset_ts(journal(spark, rows))
    assert B.item_quantity_by_day(j).first().name == "LATE"
    assert [r.offset for r in events_by_tag(j, "item-purchased").collect()] == [early, late]


def test_unknown_manifest_fails_the_strict_read_side(spark):
    raw = encode_events(journal(spark, [ev(1, 1)])).withColumn("manifest", F.lit("SomethingElse"))
    back = decode_events(raw)
    assert back.first().event_type is None
    # Still tagged as a purchase, but not decodable as one: the read sides fail.
    for plan in (B.item_quantity_by_day, B.balance_by_vendor, B.vendor_billing):
        with pytest.raises(Exception, match="malformed ItemPurchased"):
            plan(back).collect()


def test_a_mis_tagged_event_fails_the_strict_read_side(spark, scratch):
    from carthouse.sources.journal import read_journal, write_journal
    other = spark.createDataFrame([ev(1, 1, "ItemAdded")], JOURNAL).withColumn(
        "tags", F.array(F.lit("item-purchased"), F.lit("cart-event")))
    write_journal(other, scratch + "/j")
    with pytest.raises(Exception, match="malformed ItemPurchased"):
        B.item_quantity_by_day(read_journal(spark, scratch + "/j")).collect()


def test_events_of_the_stored_time_are_told_apart_by_the_offset(spark):
    j = journal(spark, [ev(1, 10), ev(2, 10)]).withColumn("offset", F.concat(F.lit("o"), F.col("seq_nr").cast("string")))
    assert [r.seq_nr for r in events_by_tag(j, "item-purchased", (10, "o1")).collect()] == [2]
    assert events_by_tag(j, "item-purchased", (10, "o2")).count() == 0
    assert events_by_tag(j, "item-purchased", 10).count() == 0


def test_quantity_totals_do_not_wrap_at_32_bits(spark):
    big = 2_000_000_000
    r = B.item_quantity_by_day(journal(spark, [ev(1, 1, qty=big), ev(2, 2, qty=big)])).first()
    assert r.quantity == 2 * big  # a 32-bit running sum would have wrapped negative
