"""Sinks: what is written once, what is appended, what is replaced."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenqc.functions import text
from lumenqc.operators import batch


#: Folders by hash of the key: a batch reads the keys of those that its own keys fall into.
BUCKETS = 64


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def append_once(new: DataFrame, path: str, key: str, part: str | None = None) -> None:
    """Appends the rows whose key the table lacks, one a key: done twice it adds nothing.

    The rows go to the folder of ``part``, which they replace; so a batch that is repeated under its own name, after a loss in the
    midst of writing, leaves what it would have left.  Of the table only keys are read, of the buckets that the new keys need.
    """
    spark, part = new.sparkSession, part or uuid.uuid4().hex
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    kinds = ("string", "bigint", "int", "double", "timestamp")
    first = [F.col(c) for c in new.columns if c != key and new.schema[c].dataType.simpleString() in kinds]
    held = T.StructType([new.schema[key], T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
    needed = [r[0] for r in new.select(bucket).distinct().collect()]  # BUCKETS numbers at the most
    old = existing(spark, path, held).where(F.col("bucket").isin(needed) & (F.col("part") != part))
    fresh = new.join(old.select(key), key, "left_anti")
    one = fresh.groupBy(key).agg(F.min_by(F.struct(*(c for c in new.columns if c != key)), F.struct(*(first or [F.lit(1)]))).alias("row"))
    one = one.select(key, "row.*").select(*new.columns) if len(new.columns) > 1 else fresh.distinct()
    one.withColumns({"part": F.lit(part), "bucket": bucket}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "bucket").parquet(path)


def append_version(new: DataFrame, path: str) -> None:
    """Appends a version of each key; ``latest`` reads the last."""
    new.write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str, schema, key: str, order: str) -> DataFrame:
    return batch.upsert(existing(spark, path, schema), key, [order])


def append_report(report: DataFrame, path: str) -> None:
    """Reports as CSV rows; lists are joined by semicolons, and a repeated item repeats its row."""
    flat = [text.joined(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "array<string>" else F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("struct", "map")) else F.col(f.name) for f in report.schema]
    report.select(*flat).write.mode("append").option("header", "true").csv(path)


def append_failures(rows: DataFrame, path: str, name: str = "filename", reason: str = "reason") -> None:
    rows.select(F.concat_ws("\t", F.col(name), F.col(reason)).alias("value")).write.mode("append").text(path)


def manifest(report: DataFrame) -> DataFrame:
    """Manifest rows of reviewed items: reasons joined, flags as yes or no, time to two places, UTC to the second."""
    return report.select(
        F.col("id").alias("review_id"), text.joined(F.col("reasons")).alias("review_reason"), F.when(F.col("fallback"), "yes").otherwise("no").alias("fallback_used"),
        F.format_string("%.2f", F.col("seconds")).alias("processing_time"), F.to_json("metrics").alias("quality_metrics"), F.date_format(F.date_trunc("SECOND", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Appends each row as a JSON line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def log_view(spark: SparkSession, log: str, out: str, schema: str) -> None:
    """The log's rows as a CSV report of the schema's columns: broken lines are left out, what a line lacks is empty."""
    made = spark.read.text(log).select(F.from_json("value", f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("row")).select("row.*").where("broken is null").drop("broken")
    made.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in made.columns)).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(out)


def harness_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A run's rows as JSON lines, and beside them its summary, a single row."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.limit(1).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def attempted(write: Callable[..., None], *args, **named) -> str | None:
    """Writes, and says what went wrong instead of raising it: a side report must not stop a batch."""
    try:
        write(*args, **named)
    except Exception as e:  # whatever a sink raises
        return f"{type(e).__name__}: {e}"[:500]
    return None
