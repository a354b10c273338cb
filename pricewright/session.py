"""Session helpers: one place for the configuration the engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on; a cluster session keeps its own values for
# everything else (shuffle partitions, memory, checkpoint dir ...).
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method above 8000 bytes. A projection of many columns is one such
    # method in a whole stage; beyond the limit Spark generates it in parts, which are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A join whose smaller side has shuffled partitions of at most this size (as measured) puts that side
    # into a hash table; the wide rows of the other side are neither sorted nor spilled.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}
# What a session made elsewhere is given as well.
TUNED = ("spark.sql.codegen.hugeMethodLimit", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")


def get_session(master: str | None = None, cpus: int | None = None,
                app_name: str = "pricewright", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. Local masters get test-sized settings."""
    builder = SparkSession.builder.appName(app_name)
    if master is None and cpus is not None:
        master = f"local[{cpus}]"
    if master is not None:
        builder = builder.master(master)
    local = master is not None and master.startswith("local")
    conf = dict(ENGINE_CONF)
    if local:
        n = cpus or os.cpu_count() or 8
        conf.update({
            "spark.sql.shuffle.partitions": str(n),
            "spark.default.parallelism": str(n),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        })
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Gives a session made elsewhere the settings of ``TUNED``, unless it names them itself."""
    for key in TUNED:
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, ENGINE_CONF[key])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is left alone. Only a local
    master without one gets a scratch folder of its own; a cluster without one is an
    error, as its executors would write where nobody else can read.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not current:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        current = tempfile.mkdtemp(prefix="pricewright-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return current


# The shuffle files of a write go when it has ended; else they lie there until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df):
    """Cut lineage: a Parquet table in the session's shared checkpoint folder. It survives
    executor loss, is written in one pass, pruned on reading and has a known size. What was
    shuffled for it is removed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)
