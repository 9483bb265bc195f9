"""The journal as an append-only parquet table, its scans and its codec.

The journal (JOURNAL schema) is written in one directory per tag and sorted by
offset within files: a tag prunes whole directories, and parquet min/max
statistics let ``offset_ts >= o`` skip row groups.
The serialized form (RAW_JOURNAL) keeps a manifest and a JSON payload per
event, as a storage layer would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carthouse.functions.ids import timeuuid_ticks
from carthouse.operators.projections import after_offset, filter_tag, storage_tag
from carthouse.schemas import (EVENT_TYPES, ITEM_ADDED, ITEM_PURCHASED, ITEM_QUANTITY_DECREASED,
                               ITEM_QUANTITY_INCREASED, ITEM_REMOVED, JOURNAL, RAW_JOURNAL)
from carthouse.session import CODEC, tidy

# The serializer manifest of each event type, and the name of
# the time field in each payload.
MANIFESTS = {
    ITEM_ADDED: "ItemAdded",
    ITEM_REMOVED: "ItemRemoved",
    ITEM_QUANTITY_INCREASED: "ItemQuantityIncreased",
    ITEM_QUANTITY_DECREASED: "ItemQuantityDecreased",
    ITEM_PURCHASED: "ItemPurchased",
}
TIME_FIELD = {
    ITEM_ADDED: "timeAdded",
    ITEM_REMOVED: "timeRemoved",
    ITEM_QUANTITY_INCREASED: "time",
    ITEM_QUANTITY_DECREASED: "time",
    ITEM_PURCHASED: "timePurchased",
}

_WIRE_ITEM = ("struct<productId:struct<value:string>,vendorId:struct<value:string>,name:string,"
              "price:double,quantity:int>")
_WIRE_PAYLOAD = (f"struct<item:{_WIRE_ITEM},cartId:struct<value:string>,amount:int,timeAdded:string,"
                 "timeRemoved:string,time:string,timePurchased:string>")


#: Bytes of a row group of a journal that is read by stretches of time: a file is sorted by offset, so the statistics of
#: small groups let such a reader skip nearly all of every file. They take a fifth more room than one group a file.
STRETCH_BYTES = 2 << 20

# A stored row carries the tag its directory is named after.
STORED = T.StructType(JOURNAL.fields + [T.StructField("tag", T.StringType())])
RAW_STORED = T.StructType(RAW_JOURNAL.fields + [T.StructField("tag", T.StringType())])


def with_storage_tag(events: DataFrame, schema: T.StructType = JOURNAL) -> DataFrame:
    return events.select(*[f.name for f in schema.fields], storage_tag(F.col("tags")).alias("tag"))


def _append(events: DataFrame, path: str, mode: str, schema: T.StructType, records_per_file: int,
            row_group_bytes: int | None = None) -> None:
    with tidy(events.sparkSession):
        (with_storage_tag(events, schema).sortWithinPartitions("tag", "offset_ts", "offset")
         .write.mode(mode).option("maxRecordsPerFile", int(records_per_file)).option("compression", CODEC)
         .options(**({"parquet.block.size": row_group_bytes} if row_group_bytes else {})).partitionBy("tag").parquet(path))


def write_journal(events: DataFrame, path: str, mode: str = "append", records_per_file: int = 0,
                  row_group_bytes: int | None = None) -> None:
    """Append events under ``tag=<tag>/``, sorted by offset inside each file.

    ``records_per_file`` (0: no limit) bounds a file, and with it what a
    stream reads per file. ``row_group_bytes``: STRETCH_BYTES for readers of stretches of time."""
    _append(events, path, mode, JOURNAL, records_per_file, row_group_bytes)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def stream_journal(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                   raw: bool = False) -> DataFrame:
    """The journal as an unbounded source (new files are new events).
    ``raw``: the serialized form, decoded in the stream (S2)."""
    r = spark.readStream.schema(RAW_STORED if raw else STORED)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = r.parquet(path)
    return decode_events(df) if raw else df


def with_offset_ts(journal: DataFrame) -> DataFrame:
    """Fill ``offset_ts`` from the version-1 offset where a source only
    carries the UUID text (F6); the text itself never orders events."""
    return journal.withColumn("offset_ts", F.coalesce(F.col("offset_ts"), timeuuid_ticks(F.col("offset"))))


def events_by_tag(journal: DataFrame, tag: str, after: tuple | int | None = None,
                  ordered: bool = True) -> DataFrame:
    """Rows carrying ``tag`` strictly after an offset, in offset order.

    On a stream pass ``ordered=False``: micro-batches are unordered sets and
    the operators downstream use the offset itself, never arrival order.
    """
    df = after_offset(filter_tag(journal, tag), after)
    return df.orderBy("offset_ts", "offset") if ordered else df


def encode_events(journal: DataFrame) -> DataFrame:
    """S3: typed rows -> (manifest, JSON payload) in the wire shape
    (ids wrapped as {"value": ...}, time under its per-type field name)."""
    et = F.col("event_type")

    def wrap(c):
        return F.when(c.isNotNull(), F.struct(c.alias("value")))

    item = F.when(F.col("item").isNotNull(), F.struct(
        wrap(F.col("item.product_id")).alias("productId"),
        wrap(F.col("item.vendor_id")).alias("vendorId"),
        F.col("item.name").alias("name"),
        F.col("item.price").alias("price"),
        F.col("item.quantity").alias("quantity")))
    fields = [item.alias("item"), wrap(F.col("cart_id")).alias("cartId"),
              F.when(et.isin(ITEM_QUANTITY_INCREASED, ITEM_QUANTITY_DECREASED), F.col("amount")).alias("amount")]
    for name in sorted(set(TIME_FIELD.values())):
        types = [k for k, v in TIME_FIELD.items() if v == name]
        fields.append(F.when(et.isin(types), F.col("event_time")).alias(name))
    manifest = F.create_map(*[x for k in EVENT_TYPES for x in (F.lit(k), F.lit(MANIFESTS[k]))])[et]
    return journal.select(
        "persistence_id", "seq_nr", "offset", "offset_ts", "tags",
        manifest.alias("manifest"),
        F.to_json(F.struct(*fields)).alias("payload"),
    )


def decode_events(raw: DataFrame) -> DataFrame:
    """(manifest, payload) -> typed rows. An unknown manifest gives a
    NULL event type (the strict projections then fail on it)."""
    # A step of its own: the payload is parsed once, not for every field taken from it.
    raw = raw.withColumn("parsed", F.from_json(F.col("payload"), _WIRE_PAYLOAD))
    p = F.col("parsed")
    by_manifest = F.create_map(*[x for k in EVENT_TYPES for x in (F.lit(MANIFESTS[k]), F.lit(k))])
    et = by_manifest[F.col("manifest")]
    time = F.coalesce(*[F.when(et.isin([k for k, v in TIME_FIELD.items() if v == name]), p[name])
                        for name in sorted(set(TIME_FIELD.values()))])
    item = F.when(p["item"].isNotNull(), F.struct(
        p["item"]["productId"]["value"].alias("product_id"),
        p["item"]["vendorId"]["value"].alias("vendor_id"),
        p["item"]["name"].alias("name"),
        p["item"]["price"].alias("price"),
        p["item"]["quantity"].alias("quantity")))
    return raw.select(
        "persistence_id", "seq_nr", "offset", "offset_ts",
        et.alias("event_type"), "tags", *[c for c in raw.columns if c == "tag"],
        p["cartId"]["value"].alias("cart_id"),
        item.alias("item"),
        p["amount"].alias("amount"),
        time.alias("event_time"),
    )


def write_raw_journal(raw: DataFrame, path: str, mode: str = "append", records_per_file: int = 0) -> None:
    """Append serialized events (RAW_JOURNAL), laid out like the typed journal."""
    _append(raw, path, mode, RAW_JOURNAL, records_per_file)


def read_raw_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_STORED).parquet(path)
