"""Review packages as files: a data source writer whose tasks stage what they write and whose commit makes it visible.

A package is the edited picture, a copy of the original and a row of the manifest.  Tasks write into a staging folder of their own; the commit
moves these folders to ``packages``, so a task that fails or is tried again leaves nothing visible, and the driver handles a name a task only.
The original is copied as well as possible, with one retry: its failure is noted in the manifest and doesn't stop the package.  A package
whose edited picture can't be written has no manifest row but one among the failures.  The first package of an id wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ROWS = T.StructType([T.StructField("review_id", T.StringType()), T.StructField("edited", T.BinaryType()), T.StructField("original", T.StringType()), T.StructField("manifest", T.StringType())])
MANIFEST = "review_id string, edited_path string, original_path string, original_error string, manifest string"
FAILURES = "review_id string, error string"


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    packages: int
    failures: int


class PackageWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def place(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def put(self, path: str, content: bytes) -> None:
        store, name = self.place(path)
        with store.open_output_stream(name) as out:
            out.write(content)

    def copied(self, source: str, to: str) -> str | None:
        """Copies a file, trying twice; what went wrong, if it did."""
        error = None
        for _ in range(2):
            try:
                store, name = self.place(source)
                with store.open_input_stream(name) as data:
                    self.put(to, data.read())
                return None
            except Exception as e:  # whatever a store raises: the original is a side file
                error = f"{type(e).__name__}: {e}"
        return error

    def write(self, rows: Iterator[Row]) -> Staged:
        task = f"{self.job}-{uuid.uuid4().hex}"
        folder, manifest, failures = f"{self.path}/_staging/{task}", [], []
        store, name = self.place(folder)
        store.create_dir(name, recursive=True)
        final = f"{self.path}/packages/{task}"
        for row in rows:
            file = row.review_id.replace("/", "_")
            try:
                if row.edited is None:
                    raise ValueError("no edited picture")
                self.put(f"{folder}/{file}.edited", bytes(row.edited))
            except Exception as e:  # a failing package is a row; the others go on
                failures.append({"review_id": row.review_id, "error": f"{type(e).__name__}: {e}"})
                continue
            error = self.copied(row.original, f"{folder}/{file}.original") if row.original else "no original"
            kept = {"original_error": error} if error else {"original_path": f"{final}/{file}.original"}
            manifest.append({"review_id": row.review_id, "edited_path": f"{final}/{file}.edited", "manifest": row.manifest} | kept)
        for kind, found in (("manifest", manifest), ("failures", failures)):
            self.put(f"{folder}/{kind}.jsonl", "".join(json.dumps(x) + "\n" for x in found).encode())
        return Staged(task, len(manifest), len(failures))

    def commit(self, messages: list[Staged | None]) -> None:
        store, name = self.place(self.path)
        store.create_dir(f"{name}/packages", recursive=True)
        for m in messages:
            if m:
                store.move(f"{name}/_staging/{m.folder}", f"{name}/packages/{m.folder}")
        self.tidy(store, name)

    def abort(self, messages: list[Staged | None]) -> None:
        self.tidy(*self.place(self.path))

    def tidy(self, store: fs.FileSystem, name: str) -> None:
        """Deletes what this job's tasks staged and didn't commit."""
        for found in store.get_file_info(fs.FileSelector(f"{name}/_staging", allow_not_found=True)):
            if found.base_name.startswith(self.job):
                store.delete_dir(found.path)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_package"

    def schema(self) -> T.StructType:
        return ROWS

    def writer(self, schema: T.StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"])


def read_lines(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The committed manifest or failures; of a path without any, none."""
    try:
        return spark.read.schema(schema).json(f"{path}/packages/*/{kind}.jsonl")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, "manifest", MANIFEST)


def failures(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, "failures", FAILURES)


def write_packages(rows: DataFrame, path: str) -> None:
    """Writes the packages (review_id, edited, original, manifest) that ``path`` lacks; of an id the first one by original and manifest."""
    spark = rows.sparkSession
    spark.dataSource.register(PackageSource)
    new = rows.where("review_id is not null").join(manifest(spark, path).select("review_id"), "review_id", "left_anti")
    one = new.groupBy("review_id").agg(F.min_by(F.struct("edited", "original", "manifest"), F.struct("original", "manifest")).alias("p"))
    one.select("review_id", "p.edited", "p.original", "p.manifest").write.format("review_package").option("path", path).mode("append").save()
