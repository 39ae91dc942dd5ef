"""Token-id files: documents to ids to checksummed, range-coded blocks, and back.

Documents are dealt by ranges of their id and sorted, each task encodes its texts and writes files of whole
documents in ascending order to the given (shared) folder.  A file is written under a task's own name and then renamed,
so a repeated task writes the same file again.  Nothing but file names and totals returns to Spark's plan.

A file: the blocks of ``range_coder``; an Arrow stream of (id, n_tokens) a document; its length and checksum and
the blocks' length; a magic word.  A block holds ids of neighbouring documents and needs nothing outside itself.

Special cases: a null text counts as empty and has the end id alone; rows that repeat an id keep one entry each, by
text; null ids come first; a very long text is encoded whole and may fill several blocks of its file; texts of equal id come in
their own order, equal ones in any; an empty table makes no files and an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenqc.llm import range_coder, tokens
from lumenqc.llm.common import new_path, written

FOOTER = struct.Struct("<QQI8s")  # bytes of blocks, bytes of the index, crc of the index, magic
MAGIC = b"LQTOKEN1"
#: Ids after which a task begins a new file.
FILE_IDS = 4 * range_coder.BLOCK


def file_bytes(ids: list[np.ndarray], keys: pa.Array) -> bytes:
    blocks = b"".join(range_coder.encode(np.concatenate(ids)))
    sink = io.BytesIO()
    index = pa.record_batch({"id": keys, "n_tokens": pa.array(list(map(len, ids)), pa.int64())})
    with pa.ipc.new_stream(sink, index.schema) as stream:
        stream.write_batch(index)
    tail = sink.getvalue()
    return blocks + tail + FOOTER.pack(len(blocks), len(tail), zlib.crc32(tail), MAGIC)


def read_bytes(data: bytes) -> tuple[np.ndarray, pa.RecordBatch]:
    """The ids and the index of a file; raises range_coder.Corrupt."""
    if len(data) < FOOTER.size:
        raise range_coder.Corrupt("a file is cut off")
    blocks, size, crc, magic = FOOTER.unpack(data[-FOOTER.size :])
    tail = data[blocks : blocks + size]
    if magic != MAGIC or blocks + size + FOOTER.size != len(data) or zlib.crc32(tail) != crc:
        raise range_coder.Corrupt("a file's index fails its checksum")
    index = pa.ipc.open_stream(tail).read_all().combine_chunks().to_batches()[0]
    ids = range_coder.decode(data[:blocks])
    if len(ids) != sum(index.column(1).to_pylist()):
        raise range_coder.Corrupt("a file's index doesn't fit its blocks")
    return ids, index


def put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(data)
    where.move(own, f"{path}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns (file, n_docs, n_tokens), file names in the order of their documents."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    dealt = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(tokenizer_path).ids, np.array([end_id], "<u4")
        ids, keys, size, made = [], [], 0, []

        def close() -> None:
            name = f"part-{TaskContext.get().partitionId():06d}-{len(made):06d}.tok"
            put(folder, name, file_bytes(ids, pa.concat_arrays(keys)))
            made.append((name, len(ids), size))

        for batch in batches:
            for at, x in enumerate(encode(batch.column(1), lots=2)):
                if size and size + len(x) + 1 > FILE_IDS:
                    close()
                    ids, keys, size = [], [], 0
                ids.append(np.concatenate((x, end)))
                keys.append(batch.column(0).slice(at, 1))
                size += len(x) + 1
        if ids:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))], names=["file", "n_docs", "n_tokens"])

    return written(dealt.mapInArrow(run, "file string, n_docs long, n_tokens long"), "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame, id_type: str = "long", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row per document of the files, with where it starts among all ids and the checksum of its own; and the ids if asked for."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file of millions of ids
    starts = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                ids, index = read_bytes(content.as_py())
                n = index.column(1).to_numpy()
                ends = np.cumsum(n)
                each = [ids[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                out = [pa.array([name.as_py()] * len(n)), index.column(0), pa.array(ends - n), index.column(1), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                if with_ids:
                    out.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["file", id_col, "at", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    found = data.mapInArrow(run, f"file string, `{id_col}` {id_type}, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return found.join(starts, "file").select(id_col, (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as token files in a new shared folder and reads them back."""
    folder = new_path(docs.sparkSession, "token-ids")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files = write_tokens(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, folder, files, docs.schema[id_col].dataType.simpleString(), id_col)
