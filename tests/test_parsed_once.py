"""A row's ids and time are parsed once, and an id's text is made once."""

import pytest
from pyspark.sql import functions as F

from carthouse.functions.ids import packed_id, unpacked_id
from carthouse.functions.time import local_date
from carthouse.operators import projections as P
from carthouse.sources.journal import decode_events


@pytest.mark.parametrize("project, ids", [(P.project_item_quantity, 2), (P.project_vendor_charge, 1)])
def test_ids_and_time_are_parsed_once(spark, project, ids):
    item = "struct<product_id: string, vendor_id: string, name: string, price: double, quantity: int>"
    text = F.col("id").cast("string")
    journal = spark.range(1).select(text.alias("offset"), F.col("id").alias("offset_ts"), text.alias("event_type"), text.alias("cart_id"),
                                    text.alias("event_time"), F.from_json(text, item).alias("item"))
    plan = project(journal, P.STRICT)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == ids + 1 and plan.count("gettimestamp(") <= 5


def test_ids_come_back_as_they_were(spark):
    texts = ["0f8fad5b-d9cb-469f-a165-70867728950e", "0F8FAD5B-D9CB-469F-A165-70867728950E", "", "vendor", "0f8fad5bd9cb469fa16570867728950e",
             "0f8fad5b-d9cb-469f-a165-70867728950", "ü" * 36, None, "0f8fad5b-d9cb-469f-a165-7086772895-e"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed_id("t").alias("p")).select("t", "p", unpacked_id("p").alias("u"))
    assert all(r["t"] == r["u"] for r in rows.collect())
    # The text is cut from the bytes: each of them is written in digits once.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("hex(substring(") >= 5


def test_dates_are_read_as_the_formatter_reads_them(spark):
    texts = ["2018-01-31T23:30:00-05:00", "2018-02-30T00:00:00Z", "2018-1-31T00", "2018-01-1T", "2018-01-1 ", "-997-01-01", "1997-01- 1", "0000-01-01T",
             "2018-01-31", "2018-01-311", "2018/01/31", "", None, "1997--1-01", "12018-1-01", "2018-13-01T00:00:00Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(local_date("t").cast("string").alias("d"),
                      F.try_to_date(F.substring("t", 1, 10), "yyyy-MM-dd").cast("string").alias("w")).collect()
    assert [r["d"] for r in got] == [r["w"] for r in got]


def test_a_payload_is_parsed_once(spark):
    raw = spark.range(1).select(F.lit("c").alias("persistence_id"), F.col("id").alias("seq_nr"), F.lit("o").alias("offset"),
                                F.col("id").alias("offset_ts"), F.array(F.lit("t")).alias("tags"), F.lit("ItemPurchased").alias("manifest"),
                                F.col("id").cast("string").alias("payload"))
    plan = P.project_vendor_charge(decode_events(raw), P.STRICT)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
