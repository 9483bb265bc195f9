"""Journal and command log derived by Spark from the driver's tables.

purchases: lineitem x orders x part -> ItemPurchased journal rows.
commands:  events -> cart command log.

Ids become name-based UUIDs of stable keys so that any rerun (and the DuckDB
oracle) produces the same ids. Both builders are plain DataFrame plans; they
grow with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carthouse.functions.ids import GREGORIAN_TO_UNIX_100NS, name_uuid, timeuuid_from_ticks
from carthouse.functions.time import format_local_time, ntz_epoch_micros
from carthouse.operators.projections import tag_events
from carthouse.schemas import (ADD_ITEM, ADJUST_QUANTITY, CHECKOUT, COMMANDS_SCHEMA, ITEM_PURCHASED, JOURNAL,
                               REMOVE_ITEM)

# Prefixes of the names hashed into fixture ids.
VENDOR_PREFIX = "vendor-"
PRODUCT_PREFIX = "product-"
CART_PREFIX = "cart-"
MEMBER_PREFIX = "member-"
PERSISTENCE_PREFIX = "cart-"

#: Lines of one task: what it sorts and holds does not follow the tables.
LINES_PER_TASK = 500_000

_DAY_100NS = 864_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def line_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks the lines are dealt over, LINES_PER_TASK to each; None where the session's number is enough.
    The count comes from the files' footers."""
    parts = -(-table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(df: DataFrame, parts: int | None, *key: str) -> DataFrame:
    return df.repartition(*key) if parts is None else df.repartition(parts, *key)


def vendor_uuid(key) -> F.Column:
    return name_uuid(F.concat(F.lit(VENDOR_PREFIX), key.cast("string")))


def product_uuid(key) -> F.Column:
    return name_uuid(F.concat(F.lit(PRODUCT_PREFIX), key.cast("string")))


def member_uuid(key) -> F.Column:
    return name_uuid(F.concat(F.lit(MEMBER_PREFIX), key.cast("string")))


def persistence_id(member_id) -> F.Column:
    return F.concat(F.lit(PERSISTENCE_PREFIX), member_id)


def zone_offset_minutes(custkey) -> F.Column:
    """Each customer lives in one of 25 whole-hour offsets (-12h .. +12h), so
    calendar fields taken in UTC would be wrong for most rows."""
    return ((F.pmod(custkey, F.lit(25)) - 12) * 60).cast("int")


def purchase_journal(spark: SparkSession, sf_dir: str, renamed: bool = False) -> DataFrame:
    """ItemPurchased journal rows (JOURNAL schema) for every lineitem.

    Lines and orders grow together, so they meet in a shuffle join at every
    size, in tasks of a bounded number of lines; order attributes (member and
    cart ids, the event time text) are derived on the shuffled orders, once per
    order rather than once per line. Parts join the lines first: the wide rows
    with ids and times in them are never shuffled.
    ``renamed`` gives every line a name of its own and ticks that count lines
    within the instant, so that the latest name can be recomputed. The offset is a version-1 UUID whose time
    lies within a day after the purchase, spread by a hash of the line;
    ``seq_nr`` is that tick count, increasing per persistence id (not dense).
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    parts = line_partitions(spark, sf_dir)
    o = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), parts, "o_orderkey")
    off = zone_offset_minutes(F.col("o_custkey"))
    od = o.select(
        "o_orderkey",
        persistence_id(member_uuid(F.col("o_custkey"))).alias("persistence_id"),
        name_uuid(F.concat(F.lit(CART_PREFIX), F.col("o_orderkey").cast("string"))).alias("cart_id"),
        format_local_time(F.col("o_orderdate"), off).alias("event_time"),
        (ntz_epoch_micros(F.col("o_orderdate")) - off.cast("long") * 60_000_000).alias("instant_micros"),
    )
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    named = li.join(pt, li.l_partkey == pt.p_partkey).drop("p_partkey")
    if parts is not None:
        named = _dealt(named, parts, "l_orderkey")
    p = named.join(od.hint("shuffle_merge"), named.l_orderkey == od.o_orderkey)
    row_cols = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")]
    within = F.pmod(F.xxhash64(*row_cols), F.lit(_DAY_100NS))
    name = F.col("p_name")
    if renamed:
        within = F.col("l_orderkey") * 8 + F.col("l_linenumber")
        name = F.concat_ws(" ", name, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    ticks = F.col("instant_micros") * 10 + F.lit(GREGORIAN_TO_UNIX_100NS) + within
    item = F.struct(
        product_uuid(F.col("l_partkey")).alias("product_id"),
        vendor_uuid(F.col("l_suppkey")).alias("vendor_id"),
        name.alias("name"),
        F.col("p_retailprice").alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )
    df = p.select(
        "persistence_id",
        ticks.alias("seq_nr"),
        timeuuid_from_ticks(ticks, F.xxhash64(F.lit("clock"), *row_cols),
                            F.xxhash64(F.lit("node"), *row_cols)).alias("offset"),
        ticks.alias("offset_ts"),
        F.lit(ITEM_PURCHASED).alias("event_type"),
        "cart_id",
        item.alias("item"),
        F.lit(None).cast("int").alias("amount"),
        "event_time",
    )
    return tag_events(df).select(*[f.name for f in JOURNAL.fields])


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart commands (COMMANDS schema) from the events table.

    member = user_id; order = (ts, event_id), carried as ``seq = event_id``
    (event ids follow ts in the data; the cart operators order by ``seq``);
    product = k mod 10 and vendor = k mod 3 so carts collide; price = value.
    """
    # Dealt before ids, times and JSON are worked out: a table of one file would keep one core busy.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props") \
        .repartition(parts, "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    command = (F.when(et == "signup", F.lit(ADD_ITEM))
                .when(et.isin("click", "view"), F.lit(ADJUST_QUANTITY))
                .when(et == "error", F.lit(REMOVE_ITEM))
                .when(et == "purchase", F.lit(CHECKOUT)))
    product = product_uuid(F.pmod(k, F.lit(10)))
    item = F.struct(
        product.alias("product_id"),
        vendor_uuid(F.pmod(k, F.lit(3))).alias("vendor_id"),
        F.concat(F.lit(PRODUCT_PREFIX), F.pmod(k, F.lit(10)).cast("string")).alias("name"),
        F.col("value").alias("price"),
        (F.pmod(k, F.lit(5)) + 1).cast("int").alias("quantity"),
    )
    step = (F.pmod(k, F.lit(3)) + 1).cast("int")
    df = ev.where(command.isNotNull()).select(
        member_uuid(F.col("user_id")).alias("member_id"),
        F.col("event_id").alias("seq"),
        command.alias("command"),
        F.when(command == ADD_ITEM, item).alias("item"),
        F.when(command.isin(REMOVE_ITEM, ADJUST_QUANTITY), product).alias("product_id"),
        F.when(et == "click", step).when(et == "view", -step).alias("delta"),
        format_local_time(F.col("ts"), F.lit(0)).alias("time"),
    )
    return df.select(*[f.name for f in COMMANDS_SCHEMA.fields])
