"""Session, checkpoint and broadcast helpers shared by every operator."""

from __future__ import annotations

import ctypes
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bound in bytes under which a side table (node tables, thresholds, grids,
# pattern tables) is broadcast.  Paper-sized tables never are.
BROADCAST_MAX_BYTES = 64 << 20

#: Rows and bytes of an Arrow batch between the JVM and a Python worker: texts
#: reach megabytes, and Spark's default of 10,000 rows is held whole on both sides.
ARROW_ROWS = 1_000
ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = 4 << 20
ARROW_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def get_spark(master: str | None = None, app: str = "papersieve",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build or return the session with the settings the library relies on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # one JVM does all the work in local mode; the 1 GB default heap is
        # too small for the level loops' window sorts (only read at launch)
        b = b.config("spark.driver.memory", os.environ.get("PAPERSIEVE_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when
    it is unset and the session is local (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder "
                           "before running level loops on a cluster")
    path = tempfile.mkdtemp(prefix="papersieve-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for written tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (survives executor loss, unlike localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                      known_rows: int | None = None) -> DataFrame:
    """Broadcast a side table only when its size is measured to be small.

    The table is checkpointed and then measured, so its upstream runs once
    (``known_rows``: it is computed already).  Above the bound it is returned
    as it is and the optimiser picks a shuffle join."""
    if known_rows is None:
        df = cut_lineage(df)
    fixed = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if known_rows is not None and len(fixed) == len(df.columns):
        size = 8 * known_rows * len(fixed)
    else:
        other = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))
                 for f in df.schema.fields if f not in fixed]
        width = F.lit(8 * len(df.columns) + 16).cast("long")
        for o in other:
            width = width + o
        size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def spread(df: DataFrame, key: str = "paper_id", min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (regex over whole texts) enough tasks.

    When the scan already has at least one partition per core (any real
    input: 128 MB splits of a large table) this is a no-op.  Only a small
    input with fewer splits than cores is hash-partitioned by ``key``, which
    also co-partitions it for the later joins on that key."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def short_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """ARROW_ROWS (and ``most_bytes``) an Arrow batch for the session, unless it
    has settings of its own."""
    for key, most in ((ARROW_ROWS_KEY, ARROW_ROWS), (ARROW_BYTES_KEY, most_bytes)):
        if most is not None and spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def give_back() -> None:
    """Free memory of this Python worker back to the system.  Spark keeps workers
    from task to task, and the C library keeps what numpy has freed, so without
    this every worker stays as large as its largest task was."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
