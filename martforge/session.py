"""Session settings shared by the library, the tests and the bench.

Two kinds of settings:

* semantic ones that results depend on (UTC day boundaries, ANSI decimal
  overflow, last-wins duplicate JSON keys) -- applied to *any* session the
  library is handed, because the driver brings its own session;
* performance ones (AQE, skew join, broadcast thresholds) -- defaults for
  sessions we build ourselves; a cluster deployment overrides them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Broadcast only below a checked size: Catalyst checks the static plan
# estimate, AQE re-checks the measured shuffle output at run time. Above it
# the planner keeps the sort-merge join, so no side is broadcast unchecked.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

# Compressed input for each partition that a shuffle starts with (``spread``).
PARTITION_INPUT_BYTES = 4 * 1024 * 1024

SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

RUNTIME_PERF_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_LIMIT_BYTES),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_LIMIT_BYTES),
    # Parquet is compressed; without this the static size check compares the
    # *compressed* bytes to the broadcast limit and lets through tables
    # several times larger in memory.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # published versions are rewritten every cycle: smaller files, less I/O
    "spark.sql.parquet.compression.codec": "zstd",
    # transformWithState (cart state stream) needs the RocksDB state store
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Shuffle files go when the query that wrote them has ended; a DataFrame that
# is evaluated again writes them anew. No result depends on it.
CLEANUP_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

STATIC_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.scheduler.mode": "FAIR",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to a session, and the early
    removal of shuffle files; its own performance settings stay as they are."""
    for key, value in {**SEMANTIC_CONF, **CLEANUP_CONF}.items():
        spark.conf.set(key, value)
    return spark


def spread(spark: SparkSession, paths: list[str]) -> None:
    """Shuffles start with as many partitions as the Parquet files ``paths``
    need, so that one task's share doesn't grow with the tables; adaptive
    execution joins small ones. Never fewer than the session has."""
    jvm, conf, size = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for p in map(jvm.org.apache.hadoop.fs.Path, paths):
        size += p.getFileSystem(conf).getContentSummary(p).getLength()
    key, most = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", -(-size // PARTITION_INPUT_BYTES)
    if most > max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(key, None) or 0)):
        spark.conf.set(key, str(most))


def build_session(
    master: str | None = None,
    app_name: str = "martforge",
    shuffle_partitions: int | None = None,
    scratch_dir: str | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    ``scratch_dir`` is only used when the session does not already name a
    shared ``spark.checkpoint.dir`` (tests, local runs).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**STATIC_CONF, **SEMANTIC_CONF, **RUNTIME_PERF_CONF}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if scratch_dir:
        conf.setdefault("spark.sql.warehouse.dir", os.path.join(scratch_dir, "warehouse"))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_dir(spark, scratch_dir)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster); only when it is
    unset -- as in tests -- fall back to ``fallback`` or a fresh temp folder.
    """
    global _LOCAL_FALLBACK
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current and not sc.master.startswith("local[") and sc.master != "local" and not fallback:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not current:
        if _LOCAL_FALLBACK is None:
            _LOCAL_FALLBACK = (os.path.join(fallback, "checkpoints") if fallback
                               else tempfile.mkdtemp(prefix="mf-ckpt-"))
        current = _LOCAL_FALLBACK
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


_LOCAL_FALLBACK: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the
    driver was started from: zipped once per application, sent with
    ``addPyFile``."""
    sc = spark.sparkContext
    if getattr(sc, "_martforge_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="mf-ship-"), "martforge_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("martforge", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._martforge_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the
    application's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/martforge-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(target)
    return path


def materialise(df, name: str, batch_rows: int | None = None):
    """Write ``df`` as Parquet into the shared scratch folder and read it
    back: cuts lineage in a way that survives lost executors.

    ``batch_rows``: rows of an Arrow batch while this runs, where rows are
    wide."""
    spark = df.sparkSession
    ship_package(spark)
    path, key = scratch_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def small(table, most: int):
    """The written ``table`` with a broadcast hint if it has up to ``most``
    rows; else the planner decides."""
    return F.broadcast(table) if table.count() <= most else table


def release(*tables) -> None:
    """Remove tables of ``materialise`` that nothing reads any more. A table
    is one folder, named by the files that a plan over it alone reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
