"""Cases and the files that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqc.functions import text


def resolved(cases: DataFrame, files: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """Each case with the file of its best key; cases without a file are left out.

    Keys are exploded on both sides and joined; the best key wins, and of files under one key the least path.
    """
    index = files.select(F.explode(text.index_keys(F.col(path))).alias("key"), F.col(path).alias("file")).groupBy("key").agg(F.min("file").alias("file"))
    looked = cases.select("*", F.posexplode(text.case_keys(F.col(stem))).alias("rank", "key")).join(index, "key")
    return looked.groupBy(*cases.columns).agg(F.min_by("file", "rank").alias("file"), F.min_by("key", "rank").alias("key"))
