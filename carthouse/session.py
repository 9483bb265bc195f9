"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults sized for the local test box; on a cluster the submitter's
# settings win because getOrCreate() keeps an existing session untouched.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner measured to be small; 64 MB is a bound
    # that does not move with the size of the journal.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "carthouse",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, unless
    it is installed for them anyway (local runs; a cluster gets it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


#: Codec of what is written here: ids are hex text, which snappy leaves twice as large.
CODEC = "zstd"
#: A restart needs the last batch and the one before it; state files of earlier ones are dropped. Spark's own
#: choice, 100 batches, keeps every file the state store has compacted away.
STATE_BATCHES_KEPT = 2
#: How often state files no kept batch needs are dropped. With a batch in a few seconds, Spark's own minute lets
#: several times the state pile up.
STATE_MAINTENANCE = "10s"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside; the session's own are back afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def tidy(spark: SparkSession):
    """What is written inside leaves no shuffle files behind; otherwise they stay until the driver's next long collection."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def rocksdb_state(spark: SparkSession):
    """Streaming queries started inside use the RocksDB state store (state beyond memory, and required by
    ``transformWithState``) and keep the state of their last batches."""
    key = "spark.sql.streaming.stateStore.providerClass"
    return settings(spark, {key: _DEFAULTS[key], "spark.sql.streaming.minBatchesToRetain": str(STATE_BATCHES_KEPT),
                            "spark.sql.streaming.stateStore.maintenanceInterval": STATE_MAINTENANCE,
                            "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none and runs on a ``local`` master is a scratch
    folder created and registered, so that streaming checkpoints, versioned
    tables and staged results all land in one place. On a cluster a folder of
    one machine would be useless to the others, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"master {master} needs spark.checkpoint.dir: a folder all executors share")
        root = tempfile.mkdtemp(prefix="carthouse-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _staged_folder(spark: SparkSession) -> str:
    return os.path.join(checkpoint_root(spark), "carthouse", "staged")


def materialize(df):
    """Cut lineage: write ``df`` as a table into the shared checkpoint folder
    and read it back.

    Used where a result is read several times (the fold output) or where a
    plan would otherwise be re-expanded at every use. Survives executor loss
    (unlike a local checkpoint or a cache); computed once and columnar (a
    reliable RDD checkpoint computes its input twice and stores whole rows).
    """
    spark = df.sparkSession
    path = os.path.join(_staged_folder(spark), uuid.uuid4().hex)
    with tidy(spark):
        df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df) -> None:
    """Delete the table behind a ``materialize`` result that is no longer read."""
    spark = df.sparkSession
    folder = _staged_folder(spark).rstrip("/") + "/"
    for file in df.inputFiles()[:1]:
        at = file.find("/carthouse/staged/")
        if at < 0:
            continue
        name = file[at + len("/carthouse/staged/"):].split("/")[0]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder + name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
