"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each response gives a conversion record (the page as plain text) and a metadata record (facts of the source: its
headers, HTTP headers, digests, title and links).  Both refer to the response's id, keep its target URI and
date, and carry their own block digests; record ids derive from the response's, so a repeated task makes equal records.
Records are written to .warc.gz files in the shared folder, a gzip member a record, and read back from them.

A page is read in one pass over its tags; no search starts over, so time is linear in its length whatever it holds.

Special cases: a null page is an empty response with an empty conversion; a null URL has an empty target; malformed HTML is
read as far as it goes (an unclosed tag is text, an unclosed script or comment hides the rest); a very long page is one
record; a record that isn't a response gives nothing; repeated rows repeat their records; an empty table
gives an empty result and no file; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqc.llm.common import new_path, written

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: The page's own key goes along as a header of the response, so as a source header of its metadata.
KEY = "X-Page-Key"
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
HREF = re.compile(r"(?<![\w-])href\s*+=\s*+[\"']?+([^\"'\s>]++)", re.IGNORECASE)
HIDING = ("script", "style", "noscript", "template")
CLOSING = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in HIDING}
TITLE_END = re.compile("</title", re.IGNORECASE)
BREAKING = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav main aside blockquote pre title body html hr form dd dt dl".split())
ZEROS, LARGE = re.compile("&#0++(?=[0-9])"), re.compile("&#[0-9]{8,}+;?")
BLANKS = re.compile(r"[^\S\n]+")
LINE_ENDS = re.compile(r"[\r\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Header values stay as they are, but for line ends, which can't be in them."""
    lines = b"".join(f"{k}: {LINE_ENDS.sub(' ', v)}\r\n".encode("utf-8", "surrogatepass") for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def fields(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """All headers in order, names in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    found = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])]
    return found, rest[: int(dict(found).get("content-length", len(rest)))]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by name in lower case (the last of a name), and the block."""
    found, block = fields(data)
    return dict(found), block


def response(key: object, url: str | None, page: str | None) -> bytes:
    """The response record of a fetched page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>"), ("WARC-Target-URI", url or ""),
        ("WARC-Date", DATE), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(headers if key is None else [*headers, (KEY, str(key))], block)


def unescaped(text: str) -> str:
    """Character references resolved, however many digits they have."""
    return html.unescape(LARGE.sub("\ufffd", ZEROS.sub("&#", text)) if "&#" in text else text)


def read_page(page: str) -> tuple[str, str, list[str]]:
    """Plain text (a line for each block, without scripts, styles and comments), title and links."""
    out, links, title, at, end = [], [], None, 0, len(page)
    while at < end:
        i = page.find("<", at)
        if i < 0:
            break
        out.append(page[at:i])
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            out.append(" ")
            at = end if j < 0 else j + 3
            continue
        m = NAME.match(page, i)
        if not m and page[i + 1 : i + 2] not in ("!", "?"):
            out.append("<")
            at = i + 1
            continue
        j = page.find(">", i + 1)
        if j < 0:  # no tag ends from here on
            at = i
            break
        at = j + 1
        name = m[1].lower() if m else ""
        if name in HIDING and page[i + 1] != "/":
            out.append(" ")
            close = CLOSING[name].search(page, at)
            at = close.end() if close else end
        elif name == "head":
            out.append(" ")
        elif name in BREAKING:
            out.append("\n")
            if name == "title" and title is None:
                close = TITLE_END.search(page, at)
                title = page[at : close.start()] if close else ""
        elif name == "a" and page[i + 1] != "/":
            links += (x[1] for x in [HREF.search(page, m.end(), j)] if x)
    out.append(page[at:])
    text = unescaped("".join(out))
    return "\n".join(x for x in (BLANKS.sub(" ", line).strip() for line in text.split("\n")) if x), " ".join(unescaped(title or "").split()), links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def derive(data: bytes) -> tuple[bytes, bytes] | None:
    """The metadata and conversion records of a response record."""
    given, block = fields(data)
    source = dict(given)
    if source.get("warc-type") != "response":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    text, title, links = read_page(payload.decode("utf-8", "replace"))
    link = [("WARC-Refers-To", source["warc-record-id"]), ("WARC-Target-URI", source.get("warc-target-uri", "")), ("WARC-Date", source.get("warc-date", DATE))]
    own = lambda kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source['warc-record-id'] + kind)}>"
    facts = [(f"source-{k}", v) for k, v in given]
    facts += [(f"http-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])]
    facts += [("http-status", http.split(b"\r\n")[0].decode("utf-8", "replace")), ("title", title), *(("outlink", x) for x in links)]
    about = "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "surrogatepass")
    conversion_id = own("conversion")
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", own("metadata")), *link, ("WARC-Concurrent-To", conversion_id), ("Content-Type", "application/warc-fields")], about)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *link, ("WARC-Source-Payload-Digest", source.get("warc-payload-digest", "")), ("Content-Type", "text/plain; charset=utf-8")], text.encode("utf-8", "surrogatepass"))
    return metadata, conversion


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): a response record a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[id_col, "record"])

    kept = pages.select(id_col, url_col, html_col)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, record binary")


def derivatives(found: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """A row per response: ids, digests and the two derived records."""
    names = ["source_id", "metadata_id", "conversion_id", "target_uri", "payload_digest", "metadata_digest", "conversion_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                if data is not None and (made := derive(data)):
                    (s, _), (m, _), (c, text) = parse(data), *map(parse, made)
                    keys.append(k)
                    rows.append((c["warc-refers-to"], m["warc-record-id"], c["warc-record-id"], c["warc-target-uri"], s.get("warc-payload-digest"), m["warc-block-digest"], c["warc-block-digest"], len(text), *made))
            kinds = [*[pa.string()] * 7, pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(10))], names=[id_col, *names, "text_bytes", "metadata", "conversion"])

    kept = found.select(id_col, record_col)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {', '.join(f'{n} string' for n in names)}, text_bytes long, metadata binary, conversion binary")


def write_files(derived: DataFrame, folder: str, kinds: tuple[str, ...] = ("metadata", "conversion"), most: int = 16 << 20) -> DataFrame:
    """Writes the records to .warc.gz files in a shared folder, a gzip member a record; returns (file, n_records)."""
    from pyarrow import fs

    from lumenqc.llm.token_store import put

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n, made = [], 0, 0, []

        def close() -> None:
            name = f"part-{TaskContext.get().partitionId():06d}-{len(made):06d}.warc.gz"
            put(folder, name, b"".join(out))
            made.append((name, n))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for data in row:
                    out.append(gzip.compress(data, 4, mtime=0))
                    size, n = size + len(out[-1]), n + 1
                if size >= most:
                    close()
                    out, size, n = [], 0, 0
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["file", "n_records"])

    return written(derived.select(*kinds).mapInArrow(run, "file string, n_records long"), "warc-files")


def records(data: bytes) -> Iterator[bytes]:
    """The records of a .warc.gz file, one after the other."""
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at == len(data):
                raise ValueError("a record is cut off")
            piece = data[at : at + 8192]  # what follows a member is handed back, so little is given at once
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(parts)


def read_files(spark: SparkSession, folder: str, key: str = "page_id", key_type: str = "long") -> DataFrame:
    """From files of metadata and conversion records in turn, a row per pair: the page's key, ids, digests, and what the blocks hold.

    ``sound`` says whether both refer to one source, the metadata names the conversion, and the blocks fit their digests.
    """
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    texts = ["key", "source_id", "metadata_id", "conversion_id", "target_uri", "payload_digest", "metadata_digest", "conversion_digest", "about", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = records(memoryview(content.as_py()))
                while some := list(itertools.islice(zip(found, found, strict=True), 500)):
                    rows = []
                    for first, second in some:
                        (m, about), (c, text) = parse(first), parse(second)
                        facts = dict(reversed([(k, v) for k, _, v in (x.partition(": ") for x in about.decode("utf-8", "surrogatepass").split("\r\n")) if k.startswith("source-")]))
                        sound = m["warc-refers-to"] == c["warc-refers-to"] and m["warc-concurrent-to"] == c["warc-record-id"] and m["warc-block-digest"] == digest(about) and c["warc-block-digest"] == digest(text)
                        rows.append((
                            facts.get(f"source-{KEY.lower()}"), c["warc-refers-to"], m["warc-record-id"], c["warc-record-id"], c["warc-target-uri"], c["warc-source-payload-digest"], m["warc-block-digest"], c["warc-block-digest"],
                            about.decode("utf-8", "replace"), text.decode("utf-8", "replace"), len(text), sound,
                        ))
                    kinds = [*[pa.string()] * 10, pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*texts, "text_bytes", "sound"])

    made = data.mapInArrow(run, ", ".join(f"{n} string" for n in texts) + ", text_bytes long, sound boolean")
    return made.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)


def build(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to response records to derivative files in a new shared folder, read back: a row per page."""
    spark, folder = pages.sparkSession, new_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    write_files(derivatives(responses(pages, id_col, url_col, html_col), id_col), folder)
    return read_files(spark, folder, id_col, pages.schema[id_col].dataType.simpleString())
