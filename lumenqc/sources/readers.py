"""Readers: pictures, reports, manifests, logs and case lists.  Schemas are given, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenqc.functions import text

#: What counts as a picture, and folders that hold results.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "heic", "heif")
RESULT_FOLDERS = ("review", "approved", "edited", "original")
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in "review_id original_filename original_source_path review_original_path review_edited_path review_reason processing_mode fallback_used quality_metrics processing_time timestamp".split()])


def is_picture(path: str = "path") -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Picture files with their ids, by lower-cased path; results of earlier runs are left out.  Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "modificationTime", "length")
    name = re.escape(folder.rstrip("/").split("/")[-1].lower())
    below = F.split(F.regexp_replace(F.lower("path"), f"^.*?/{name}/", ""), "/")
    kept = files.where(is_picture() & ~F.arrays_overlap(below, F.array(*map(F.lit, RESULT_FOLDERS))))
    return kept.withColumns({"id": text.stable_id(F.col("path")), "normal_path": text.normal_path(F.col("path"))}).orderBy(F.lower("path"))


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pictures; one that can't be decoded is a row with an error."""
    found = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select("image.*")
    bad = (F.col("width") <= 0) | (F.col("height") <= 0)
    return found.withColumns({"error": F.when(bad, "decode_failed"), "bucket": F.when(bad, "failed")})


def pixels(decoded: DataFrame) -> DataFrame:
    """(origin, y, x, r, g, b) of decoded three-channel pictures: the bytes are blue, green, red, row by row."""
    each = decoded.where("error is null and nChannels = 3").select("origin", "width", "data", F.explode(F.expr("sequence(0, width * height - 1)")).alias("i"))
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, i * 3 + {k}, 1)")), 16, 10).cast("int")
    return each.select("origin", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), byte(3).alias("r"), byte(2).alias("g"), byte(1).alias("b"))


def reports(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A JSON file a row; those that don't parse are left out."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.input_file_name())


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of a manifest."""
    rows = spark.read.schema(MANIFEST).option("header", "true").csv(path)
    return rows.select(F.trim("review_id").alias("review_id")).where("review_id <> ''").distinct()


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Category, stem and notes; lines that start with # are comments."""
    rows = spark.read.schema("category string, stem string, notes string").option("sep", "\t").option("comment", "#").csv(path)
    return rows.where("category is not null and stem is not null")
