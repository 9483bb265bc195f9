"""Cart snapshots as parquet (persistence_id, seq_nr, cart_id, items map)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carthouse.schemas import SNAPSHOT


def write_snapshots(snapshots: DataFrame, path: str, mode: str = "overwrite") -> None:
    snapshots.select(*[f.name for f in SNAPSHOT.fields]).write.mode(mode).parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot per persistence id wins when several were written."""
    from pyspark.sql import functions as F
    df = spark.read.schema(SNAPSHOT).parquet(path)
    return (df.groupBy("persistence_id")
            .agg(F.max_by(F.struct("seq_nr", "cart_id", "items"), F.col("seq_nr")).alias("s"))
            .select("persistence_id", "s.seq_nr", "s.cart_id", "s.items"))
