"""Catalog side of the pipeline: namespaces, guarded rebuilds, atomic publish.

A published table is a catalog *view* over the Parquet folder of its current
version. A rebuild writes a new folder, commits a manifest that lists it
(``plans.versions``) and swaps the view in one catalog call, so readers never
see a missing or half-written table (the source system drops and re-creates
instead). No folder is ever overwritten: a version goes when newer ones have
replaced it and no reader leases it (``reading``).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..schemas import NAMESPACES
from .versions import Segment, Versions

VERSION_PROPERTY = "martforge.version"


def ensure_namespaces(spark: SparkSession, names=NAMESPACES) -> None:
    for ns in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {ns}")


def warehouse_root(spark: SparkSession, root: str | None = None) -> str:
    """Shared folder for published tables (default: the session warehouse)."""
    if root:
        return root
    wh = spark.conf.get("spark.sql.warehouse.dir")
    return wh[len("file:"):] if wh.startswith("file:") and not wh.startswith("file://") else wh


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def versions(spark: SparkSession, name: str, root: str | None = None) -> Versions:
    """The versions of ``ns.table``."""
    return Versions(spark, os.path.join(warehouse_root(spark, root), *name.split(".")))


def current_version(spark: SparkSession, name: str) -> int | None:
    """The version that the catalogue serves."""
    if not table_exists(spark, name):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()  # a handful of metadata rows
    props = {r["key"]: r["value"] for r in rows}
    return int(props[VERSION_PROPERTY]) if VERSION_PROPERTY in props else None


def publish(spark: SparkSession, df: DataFrame, name: str, root: str | None = None,
            partition_by: list[str] | None = None, bucket_by: tuple[str, int] | None = None,
            keep: int = 2) -> str:
    """Write ``df`` as the new version of table ``ns.table`` and swap it in.

    ``bucket_by=(key, n)`` stores the version as a bucketed catalog table
    (``<table>__<id>``): a later join or aggregation on ``key`` with ``n``
    partitions reads it without a shuffle -- used for staging. The newest
    ``keep`` versions stay, and older ones while a reader leases them."""
    store = versions(spark, name, root)
    path, physical = store.new_folder(), None
    writer = df.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        key, n = bucket_by
        # one task per bucket, by the hash the buckets use: at most n files
        physical = f"{name}__{uuid.uuid4().hex[:12]}"
        df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(physical)
    else:
        writer.option("compression", "zstd").save(path)
    columns = {f.name: f.dataType.simpleString() for f in df.schema}
    segment = Segment(path, columns, "base", bytes=store.files.size(path), table=physical)

    def replace(m):
        segment.seq = m.next_seq
        m.segments, m.next_seq = [segment], m.next_seq + 1

    done = store.commit(replace)
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{VERSION_PROPERTY}'='{done.version}') "
              f"AS SELECT * FROM {physical or f'parquet.`{path}`'}")
    store.vacuum(keep)
    return path


@contextmanager
def reading(spark: SparkSession, name: str, root: str | None = None, seconds: float = 3600) -> Iterator[DataFrame]:
    """The current version of a published table, whose files stay until the
    block ends (or ``seconds`` have passed), however often it is rebuilt."""
    with versions(spark, name, root).lease(seconds) as manifest:
        segment = manifest.segments[0]
        yield spark.table(segment.table) if segment.table else spark.read.parquet(segment.path)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP VIEW IF EXISTS {name}")


def rebuild_table(spark: SparkSession, target: str, sources: list[str], fn, root: str | None = None,
                  bucket_by: tuple[str, int] | None = None, **kwargs) -> bool:
    """Rebuild ``target`` from ``fn(*source tables)`` only if every source
    exists; otherwise the target is dropped and stays absent (no error)."""
    if not all(table_exists(spark, s) for s in sources):
        drop(spark, target)
        return False
    df = fn(*[spark.table(s) for s in sources], **kwargs)
    publish(spark, df, target, root, bucket_by=bucket_by)
    return True
