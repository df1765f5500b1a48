"""Full refresh: namespaces -> 7 cleaning loads -> barrier -> 6 marts.

Independent tables are rebuilt concurrently from driver threads (each one a
normal Spark job; ``spark.scheduler.mode=FAIR`` shares the executors). The
barrier requires every load to succeed before any mart starts; each table
gets one retry, like the source system's scheduler.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from ..operators import dwh, marts
from ..fixed import RETRIES, RETRY_DELAY_S
from .catalog import ensure_namespaces, publish, rebuild_table


def _with_retry(fn, retries: int, delay_s: float):
    for attempt in range(retries + 1):
        try:
            return fn()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(delay_s)


def _run_all(spark: SparkSession, jobs: dict, retries: int, delay_s: float, workers: int) -> dict:
    def run(name, job):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return _with_retry(job, retries, delay_s)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        futures = {name: pool.submit(run, name, job) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}  # re-raises the first failure


def load_jobs(spark: SparkSession, root: str | None):
    """Cleaned tables are stored unbucketed: both sides of every join into
    them are then shuffles, which lets AQE split a hot order or customer."""
    return {t: (lambda t=t, fn=fn: rebuild_table(spark, f"dwh.{t}", [f"staging.{t}"], fn, root))
            for t, fn in dwh.LOADS.items()}


def mart_jobs(spark: SparkSession, root: str | None, as_of=None):
    jobs = {}
    for name, (fn, sources) in marts.MARTS.items():
        kwargs = {"as_of": as_of} if name == "mart_invoices" else {}
        jobs[name] = (lambda name=name, fn=fn, sources=sources, kwargs=kwargs:
                      rebuild_table(spark, f"dmart.{name}", [f"dwh.{s}" for s in sources], fn, root, **kwargs))
    return jobs


def refresh(spark: SparkSession, layers=("dwh", "dmart"), root: str | None = None, as_of=None,
            retries: int = RETRIES, retry_delay_s: float = RETRY_DELAY_S, workers: int = 7) -> dict:
    """Rebuild the cleaned layer, then (only if every load succeeded) the marts.

    Returns {table: built?}; a table whose sources are absent is reported
    False and left absent.
    """
    ensure_namespaces(spark)
    out = {}
    if "dwh" in layers:
        out.update({f"dwh.{k}": v for k, v in
                    _run_all(spark, load_jobs(spark, root), retries, retry_delay_s, workers).items()})
    if "dmart" in layers:
        out.update({f"dmart.{k}": v for k, v in
                    _run_all(spark, mart_jobs(spark, root, as_of), retries, retry_delay_s, workers).items()})
    return out


def publish_staging(spark: SparkSession, tables: dict, root: str | None = None, workers: int = 7,
                    buckets: int | None = None) -> None:
    """Publish ready staging DataFrames (e.g. an initial snapshot) as
    staging.<table>, concurrently; bucketed by id like the stream's versions."""
    ensure_namespaces(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    jobs = {name: (lambda name=name, df=df: publish(spark, df, f"staging.{name}", root, bucket_by=("id", n)))
            for name, df in tables.items()}
    _run_all(spark, jobs, retries=0, delay_s=0.0, workers=workers)
