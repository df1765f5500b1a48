"""Change-capture input: read change topics, decode JSON, unwrap envelopes,
route topics to tables.

Production reads the broker with the ``kafka`` source (its connector jar must
be on the classpath; it is not in this image, so tests use the JSON-file
source with the same columns: topic, key, value, offset).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SOURCE_DATABASE, STAGING_TABLES, TOPIC_PREFIX, wire_schema

# Columns every change source yields (the kafka source's own column names).
WIRE_COLUMNS = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])


def topic_regex(prefix: str = TOPIC_PREFIX, database: str = SOURCE_DATABASE) -> str:
    """Regex with one capture group: the table name of a change topic."""
    return f"^{re.escape(prefix)}\\.{re.escape(database)}\\.(.*)$"


def table_topics(tables=STAGING_TABLES, prefix: str = TOPIC_PREFIX, database: str = SOURCE_DATABASE) -> str:
    """Subscribe pattern for the whitelisted tables only."""
    alternatives = "|".join(f"{re.escape(prefix)}\\.{re.escape(database)}\\.{re.escape(t)}" for t in tables)
    return f"^(?:{alternatives})$"


def cdc_source(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
               tables=STAGING_TABLES, streaming: bool = True, options: dict | None = None) -> DataFrame:
    """Row changes of whitelisted tables: DataFrame(topic, key, value, partition, offset).

    ``fmt="kafka"`` subscribes by pattern (``options`` carries bootstrap
    servers etc.); ``fmt="json"`` reads JSON lines with those columns from
    ``path`` (tests, replays). Only topics of the listed tables pass.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        df = (reader.format("kafka").option("subscribePattern", table_topics(tables))
              .options(**(options or {})).load()
              .select("topic", F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"), "partition", "offset"))
    else:
        df = reader.schema(WIRE_COLUMNS).options(**(options or {})).format(fmt).load(path)
        df = df.filter(F.col("topic").rlike(table_topics(tables)))
    return df


BAD = "__bad"
_CORRUPT = "__corrupt"


def decode(df: DataFrame, row: T.StructType, value_col: str = "value", bad: str = "fail") -> DataFrame:
    """JSON value with schema envelope -> ``value`` struct(before, after, op, ts_ms, source).

    A NULL value (tombstone) stays NULL; the key (JSON without schema) is kept
    as text. A record that can't be decoded -- broken JSON, a field of another
    type, no payload, no row image (of a delete: before, else: after) -- stops the job (``bad="fail"``) or is kept with its text
    in ``__bad`` (``bad="mark"``), never passed off as a tombstone.
    """
    wire = T.StructType([*wire_schema(row).fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    out = df.withColumn("__parsed", F.from_json(F.col(value_col), wire, options))
    parsed = F.col("__parsed")
    payload = parsed.getField("payload")
    image = F.when(payload.getField("op") == "d", payload.getField("before")).otherwise(payload.getField("after"))
    is_bad = F.col(value_col).isNotNull() & (parsed.isNull() | parsed.getField(_CORRUPT).isNotNull() | payload.isNull() | image.isNull())
    if bad == "fail":
        message = F.concat(F.lit("undecodable change record: "), F.substring(F.col(value_col), 1, 200))
        value = F.when(is_bad, F.raise_error(message)).otherwise(parsed.getField("payload"))
        return out.withColumn(value_col, value).drop("__parsed")
    out = out.withColumn(BAD, F.when(is_bad, F.col(value_col)))
    return out.withColumn(value_col, F.when(F.col(BAD).isNull(), parsed.getField("payload"))).drop("__parsed")


# Type names of the envelope's own schema, as the capture tool declares them.
_DECLARED = {"int16": "int", "int32": "int", "int64": "bigint", "float32": "float", "float": "float", "double": "double",
             "boolean": "boolean", "string": "string"}


def evolved_row(df: DataFrame, row: T.StructType, value_col: str = "value") -> T.StructType:
    """``row`` plus the columns that the records' row images bring and it
    lacks, with the types that a record's envelope declares (text if none
    does). Collects column names only."""
    after = F.get_json_object(value_col, "$.payload.after")
    names = df.select(F.explode(F.json_object_keys(after)).alias("name")).distinct().collect()
    new = sorted({r["name"] for r in names} - set(row.fieldNames()))
    if not new:
        return row
    declared = {}
    for name in new:  # one record that has the column
        spec = df.filter(F.array_contains(F.json_object_keys(after), name)).select(F.get_json_object(value_col, "$.schema.fields")).first()
        for side in json.loads(spec[0]) if spec and spec[0] else []:
            if isinstance(side, dict) and side.get("field") == "after":
                declared.update({f.get("field"): _DECLARED.get(f.get("type"), "string") for f in side.get("fields", [])})
    more = T.StructType.fromDDL(", ".join(f"`{n}` {declared.get(n, 'string')}" for n in new))
    return T.StructType([*row.fields, *more.fields])


def unwrap(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Flatten change envelopes into row images plus change metadata.

    insert/update/snapshot -> after image, ``__deleted='false'``;
    delete -> before image, ``__deleted='true'`` (rewrite, not removal);
    tombstones (NULL value) are dropped. Adds ``__op``, ``__ts_ms``,
    ``__source_ts_ms``; keeps the other input columns (topic, offset, ...).
    """
    v = F.col(value_col)
    others = [c for c in df.columns if c != value_col]
    row_cols = [f.name for f in df.schema[value_col].dataType["after"].dataType.fields]
    image = F.when(v.getField("op") == "d", v.getField("before")).otherwise(v.getField("after"))
    flat = df.filter(v.isNotNull()).select(
        *others, image.alias("__row"), v.getField("op").alias("__op"), v.getField("ts_ms").alias("__ts_ms"),
        v.getField("source").getField("ts_ms").alias("__source_ts_ms"),
        F.when(v.getField("op") == "d", F.lit("true")).otherwise(F.lit("false")).alias("__deleted"))
    return flat.select(*others, *[F.col("__row").getField(c).alias(c) for c in row_cols],
                       "__op", "__ts_ms", "__source_ts_ms", "__deleted")


def route(df: DataFrame, regex: str | None = None, topic_col: str = "topic") -> DataFrame:
    """Topic -> ``table`` via the regex capture; non-matching topics are dropped."""
    rx = regex or topic_regex()
    return (df.filter(F.col(topic_col).rlike(rx))
            .withColumn("table", F.regexp_extract(F.col(topic_col), rx, 1)))
