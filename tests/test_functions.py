"""Scalar functions (F1-F13) on hand-made edge rows."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from carthouse.functions import (calendar_fields, delta_amount, delta_event_type, format_local_time,
                                 java_string_hash, kafka_partition, line_total, name_uuid, parse_event_time,
                                 parse_item_json, timeuuid_from_ticks, timeuuid_ticks, timeuuid_unix_millis,
                                 to_billing, canonical_uuid)


def one(spark, col, data, schema="t string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_calendar_fields_use_the_events_own_offset(spark):
    rows = spark.createDataFrame([("2018-01-31T23:30:00-05:00",), ("2018-02-01T00:00:00.123456789Z",),
                                  ("2018-02-01T10:15+01:00",)], "t string")
    got = rows.select(*calendar_fields("t")).collect()
    assert [tuple(r) for r in got] == [(2018, 1, 31), (2018, 2, 1), (2018, 2, 1)]


def test_parse_event_time(spark):
    got = one(spark, parse_event_time("t").cast("string"),
              [("2018-01-31T23:30:00-05:00",), ("2018-02-01T00:00:00.123456789Z",), ("2018-02-01T10:15+01:00",),
               ("not a time",), ("2018-02-01 10:15:00",), ("2018-02-01T10:15:00",)])
    assert got == ["2018-02-01 04:30:00", "2018-02-01 00:00:00.123456", "2018-02-01 09:15:00", None, None, None]


def test_format_local_time_round_trips(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07.179575", 0), ("1995-01-01 00:00:00", -300),
                                ("1995-01-01 00:00:00.5", 330)], "ts string, off int")
    got = [r[0] for r in df.select(format_local_time(F.to_timestamp_ntz("ts"), F.col("off"))).collect()]
    assert got == ["2024-01-01T00:00:07.179575Z", "1995-01-01T00:00:00-05:00", "1995-01-01T00:00:00.5+05:30"]


def test_line_total_is_double_then_decimal(spark):
    df = spark.createDataFrame([(0.1, 3), (0.125, 1)], "p double, q int")
    got = df.select(line_total("p", "q").cast("string"), to_billing(line_total("p", "q")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("0.300000000000000040", "0.30"), ("0.125000000000000000", "0.13")]


def test_rounding_per_event_differs_from_rounding_the_sum(spark):
    df = spark.createDataFrame([(0.125, 1), (0.125, 1)], "p double, q int")
    r = df.agg(F.sum(to_billing(line_total("p", "q"))).cast("decimal(21,2)").alias("per_event"),
               F.sum(line_total("p", "q")).alias("exact")).first()
    assert str(r.per_event) == "0.26" and str(r.exact) == "0.250000000000000000"


def test_timeuuid_time_order_differs_from_string_order(spark):
    ticks = [0x1E0000000000001, 0x1E0000100000000]  # later one has the smaller time_low
    df = spark.createDataFrame([(t,) for t in ticks], "t long")
    u = [r[0] for r in df.select(timeuuid_from_ticks(F.col("t"), F.lit(7), F.lit(11))).collect()]
    assert [uuid.UUID(x).time for x in u] == ticks and [uuid.UUID(x).version for x in u] == [1, 1]
    assert sorted(u) != u  # string order is not time order
    back = spark.createDataFrame([(x,) for x in u], "u string").select(timeuuid_ticks("u"), timeuuid_unix_millis("u"))
    got = back.collect()
    assert [r[0] for r in got] == ticks
    assert got[0][1] == (ticks[0] - 0x01B21DD213814000) // 10000


def test_name_uuid_matches_version_3_of_the_name_bytes(spark):
    names = ["vendor-1", "product-42", "", "ä€"]
    got = one(spark, name_uuid("t"), [(n,) for n in names])
    want = [str(uuid.UUID(bytes=hashlib.md5(n.encode()).digest(), version=3)) for n in names]
    assert got == want


def test_canonical_uuid(spark):
    got = one(spark, canonical_uuid("t"), [("5E8F0B36-72C4-4D9A-B1E3-C47A6D85F902",), ("nope",), (None,)])
    assert got == ["5e8f0b36-72c4-4d9a-b1e3-c47a6d85f902", None, None]


def _java_hash(s):
    h = 0
    for ch in s:
        h = (31 * h + ord(ch)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= (1 << 31) else h


def test_java_string_hash_and_partition_never_negative(spark):
    keys = ["cart-5e8f0b36-72c4-4d9a-b1e3-c47a6d85f902", "", "a", "polygenelubricants", "zzzzzzzzzz"]
    got = spark.createDataFrame([(k,) for k in keys], "t string").select(
        java_string_hash("t"), kafka_partition("t", 7)).collect()
    assert [r[0] for r in got] == [_java_hash(k) for k in keys]
    assert any(_java_hash(k) < 0 for k in keys)
    assert [r[1] for r in got] == [_java_hash(k) % 7 for k in keys]


def test_parse_item_json(spark):
    data = [('{"productId":"b7e4c2d9-1a3f-4e58-8c66-5d20f9a1e734","vendorId":"3c1d7a52-6f0e-4b1c-9d77-0a5b8e2f4c10",'
             '"name":"walnut-bookshelf","price":"149.5","quantity":6}',),
            ('{"productId":"b7e4c2d9-1a3f-4e58-8c66-5d20f9a1e734","name":"x","price":1.5,"quantity":2}',)]
    got = spark.createDataFrame(data, "t string").select(parse_item_json("t").alias("r")).collect()
    assert got[0].r.item.price == 149.5 and got[0].r.item.quantity == 6 and got[0].r.errors == []
    assert got[1].r.item is None and got[1].r.errors == ["vendorId: missing or invalid"]


@pytest.mark.parametrize("delta,typ,amount", [(3, "ItemQuantityIncreased", 3), (-2, "ItemQuantityDecreased", 2),
                                              (0, "ItemQuantityDecreased", 0)])
def test_delta_split(spark, delta, typ, amount):
    r = spark.createDataFrame([(delta,)], "d int").select(delta_event_type("d"), delta_amount("d")).first()
    assert (r[0], r[1]) == (typ, amount)


def test_price_wire_round_trip_and_absent_as_zero(spark):
    from carthouse.functions import absent_as_zero, price_from_wire, price_to_wire
    df = spark.createDataFrame([("149.5",), (None,)], "p string")
    got = df.select(price_from_wire(price_to_wire(F.col("p").cast("decimal(38,18)"))).cast("string"),
                    absent_as_zero(F.col("p").cast("double").cast("int"))).collect()
    assert [tuple(r) for r in got] == [("149.500000000000000000", 149), (None, 0)]


def test_random_uuid_is_version_4(spark):
    from carthouse.functions import random_uuid
    u = spark.range(3).select(random_uuid().alias("u")).collect()
    assert len({r.u for r in u}) == 3 and all(uuid.UUID(r.u).version == 4 for r in u)


def test_normalize_event_time(spark):
    from carthouse.functions import normalize_event_time
    got = one(spark, normalize_event_time("t"),
              [("2018-02-01T10:15+01:00",), ("2018-02-01T00:00:00.123456789Z",), ("2018-01-31T23:30:00-05:00",),
               ("2018-01-31T23:30:00+00:00",), ("2018-01-31T23:30:00.500+05:30",), ("garbage",)])
    assert got == ["2018-02-01T10:15:00+01:00", "2018-02-01T00:00:00.123456Z", "2018-01-31T23:30:00-05:00",
                   "2018-01-31T23:30:00Z", "2018-01-31T23:30:00.5+05:30", None]


def test_normalize_event_time_ignores_session_zone_gaps(spark):
    from carthouse.functions import normalize_event_time
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist in New York on that day; the text's own offset rules
        got = one(spark, normalize_event_time("t"), [("2018-03-11T02:30+01:00",)])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2018-03-11T02:30:00+01:00"]


def test_wall_time_helpers_ignore_session_zone(spark):
    from carthouse.functions.time import ntz_epoch_micros
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00.25",)], "s string").select(F.to_timestamp_ntz("s").alias("t"))
        r = df.select(format_local_time("t", F.lit(-300)), ntz_epoch_micros("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r[0] == "2024-03-10T02:30:00.25-05:00"
    assert r[1] == (1710037800 * 1_000_000 + 250_000)


def test_format_event_time_from_instant(spark):
    from carthouse.functions import format_event_time
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2018-01-31T23:30:00-05:00", -300), ("2018-02-01T00:00:00.123456Z", 0),
                                    ("2018-02-01T10:15+01:00", 60), ("1969-12-31T23:59:59.5Z", 0)], "t string, o int")
        got = [r[0] for r in df.select(format_event_time(parse_event_time("t"), F.col("o"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2018-01-31T23:30:00-05:00", "2018-02-01T00:00:00.123456Z", "2018-02-01T10:15:00+01:00",
                   "1969-12-31T23:59:59.5Z"]


def test_java_string_hash_on_non_ascii_bmp_text(spark):
    keys = ["cart-é", "ça-ü-€", "日本語"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "t string").select(java_string_hash("t")).collect()]
    assert got == [_java_hash(k) for k in keys]
