"""Shared helpers of the training-data operators: staged tables, heavy keys, bounded Arrow batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carthouse.session import checkpoint_root

#: A key is heavy when it holds at least 1/HEAVY_SHARE of the rows, so there are never more than HEAVY_SHARE of them.
HEAVY_SHARE = 1024
#: Rows of one Arrow batch unless the session says otherwise; bounds a Python worker's memory with long texts.
ARROW_ROWS = 1000

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), "carthouse-llm", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage at the price of one computation and one columnar copy,
    survives lost executors, and lets later jobs prune columns. Staged tables
    stay until the folder is cleared by whoever owns it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for whole texts, unless the session sets its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct column ``row``: own columns added
    beside it cannot clash with the caller's names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one-row-per-key ``classes`` that survives hot keys.

    ``classes[count]`` is how many of the ``total`` rows carry the key. Keys
    with at least total/HEAVY_SHARE rows (so at most HEAVY_SHARE of them,
    whatever the data) are broadcast; the others meet in an ordinary shuffle
    in which no key has more rows than that. Both inputs are read twice, so
    they should be staged.
    """
    is_heavy = F.col(count) * F.lit(HEAVY_SHARE) >= F.lit(int(total))
    heavy, light = classes.where(is_heavy), classes.where(~is_heavy)
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(cold)


def crc32_text(c: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes."""
    return F.crc32(c.cast("string").cast("binary"))


def hash_sample(rows: DataFrame, group: str, key: str, counts: dict, limit: int) -> DataFrame:
    """At most ``limit`` rows of each group: those with the smallest hash of ``key``.

    ``counts`` are the groups' rows. A threshold on the hash, set for a quarter
    more than the limit, leaves few rows before they are put in order, so no
    task sees more than that of a group.
    """
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    tops = [(value, 2 ** 63 - 1 if n <= limit else int(2 ** 63 * min(1.0, 1.25 * limit / n)) - 1) for value, n in counts.items()]
    bars = rows.sparkSession.createDataFrame(tops, T.StructType([rows.schema[group], T.StructField("sample_top", T.LongType())]))
    below = rows.join(F.broadcast(bars), group).where(h <= F.col("sample_top")).drop("sample_top")  # a row per group
    nth = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return below.withColumn("sample_rank", nth).where(F.col("sample_rank") <= limit).drop("sample_rank")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """``rows`` with ``name``: gapless from 0 within each value of ``keys``, ascending by ``order`` (nulls first), and
    ``total``, the rows of that value, when asked for.

    One range sort on the keys, the order and a last key that spreads repeated
    rows deals all rows evenly, whatever share a key or a row holds. A row's
    number is its place in its partition plus what earlier partitions hold of
    its key (at most a row for each partition and key).
    """
    spread = rows.withColumn("rank_spread", F.monotonically_increasing_id())
    sort = [*keys, *order, "rank_spread"]
    dealt = stage(spread.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("rank_spread")
                  .withColumn("rank_at", F.monotonically_increasing_id())
                  .withColumn("rank_part", F.shiftright("rank_at", 33)), "numbered")
    held = dealt.groupBy(*keys, "rank_part").agg(F.min("rank_at").alias("rank_first"), F.count(F.lit(1)).alias("rank_rows"))
    own, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("rank_part")
    held = held.select(*[F.col(k).alias(f"rank_key{i}") for i, k in enumerate(keys)], F.col("rank_part").alias("rank_held"),
                       (F.sum("rank_rows").over(before) - F.col("rank_rows") - F.col("rank_first")).alias("rank_base"),
                       F.sum("rank_rows").over(own).alias("rank_total"))
    same = dealt["rank_part"] == held["rank_held"]
    for i, k in enumerate(keys):
        same = same & dealt[k].eqNullSafe(held[f"rank_key{i}"])
    return dealt.join(held, same).select(*rows.columns, (F.col("rank_at") + F.col("rank_base")).alias(name),
                                         *([F.col("rank_total").alias(total)] if total else []))
