"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in Arrow batches; everything after is joins and aggregations.  Equal fingerprints are
first merged into one node, so a group of exact copies costs one row whatever its size.  Each node is
indexed by its segments; a node probes, in each segment, a small Hamming ball around its own value, and a
table match counts only if the complete fingerprints differ in few enough bits.  With two segments of 32
bits and three bits allowed, one segment differs in at most one bit, so balls of radius one lose no link.
Of a pair that differs in one bit of a segment exactly one side has a zero there, so probing only the flips of zero bits
finds the pair from that side, and the probes are half as many.

A segment value that many nodes share is indexed further: the other bits are cut into one part more than bits may differ, so
two linked nodes agree in one of these parts, and only nodes that do are compared.

Links go to connected components by alternating large-star and small-star rounds; each round is written to the
shared folder.  Nothing is collected.  A component's hub, or the fingerprint of very many documents, isn't one task: the
rows of such keys meet their one partner row where they are.

Special cases: a null or blank text has fingerprint zero and links like any other; a text under three words
is one shingle; a very long text is hashed whole, in bounded memory; a bit that is set in just half the shingles is 0; repeated
rows share a fingerprint; a null id has a component but never names one; an empty table
gives an empty result; other columns are ignored, whatever their names.  Components that aren't found in ``max_rounds`` rounds,
whose number grows with the logarithm of the longest chain, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqc.llm.common import discard, joined, new_path, nothing_kept, slices, without, written

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash over word shingles of the A-Z-lowered text."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D, alone
    if not found:
        return 0
    line, n = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n > words:
        starts, ends = starts[: n - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for batch in slices(batches):
            made = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=[id_col, "fp"])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, fp long")


def links(nodes: DataFrame, max_bits: int = 3, segments: int = 2, common: int = 256) -> DataFrame:
    """Distinct pairs (a, b), a < b, of fingerprints in ``nodes.fp`` (each once) that differ in 1 to max_bits bits.

    Segment values of more than ``common`` nodes are joined by a part of the other bits as well.
    """
    radius = max_bits // segments
    if radius > 1 or 64 % segments:
        raise ValueError("segments must divide 64, and max_bits // segments be 0 or 1")
    bits = 64 // segments
    mask = (1 << bits) - 1 if bits < 64 else -1
    parts = F.array(*(F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit(mask)).alias("v")) for i in range(segments)))
    index = nodes.select("fp", F.explode(parts).alias("s")).select("s.seg", "s.v", "fp")
    hot = written(index.groupBy("seg", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > common).select("seg", "v"), "hot-segments")
    ball = index.select(F.col("fp").alias("a"), "seg", "v", F.lit(False).alias("flipped"))
    if radius:
        flips = F.expr(f"explode(transform(filter(sequence(0, {bits - 1}), b -> (v & shiftleft(1L, b)) = 0), b -> v | shiftleft(1L, b)))")
        ball = ball.unionByName(index.select(F.col("fp").alias("a"), "seg", flips.alias("v"), F.lit(True).alias("flipped")))
    keys, index = ["seg", "v"], index.withColumnRenamed("fp", "b")
    if hot.isEmpty():
        met = ball.join(index, keys)
    else:

        def finer(rows: DataFrame, fp: str) -> DataFrame:
            """Rows of common segment values, one for each part of the other bits."""
            turned = F.expr(" ".join(["CASE seg", *(f"WHEN {i} THEN shiftrightunsigned({fp}, {i * bits}) | shiftleft({fp}, {64 - i * bits})" for i in range(segments)), "END"]))
            width = -(-(64 - bits) // (max_bits + 1))
            part = F.posexplode(F.array(*(F.shiftrightunsigned(turned, bits + k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(max_bits + 1))))
            return rows.join(hot, keys, "left_semi").select("*", part.alias("part", "value"))

        met = ball.join(hot, keys, "left_anti").join(index.join(hot, keys, "left_anti"), keys)
        met = met.unionByName(finer(ball, "a").join(finer(index, "b"), [*keys, "part", "value"]).drop("part", "value"))
    return (
        met.where((F.col("flipped") | (F.col("a") < F.col("b"))) & F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, max_bits))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that it reaches.  Earlier rounds are deleted."""
    spark, seen = edges.sparkSession, None
    path = new_path(spark, "edges")
    edges = written(edges.select("a", "b"), "edges", path)
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        paths = [new_path(spark, name) for name in ("least", "down", "least")]
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", paths[0])
        large = joined(both, least, "u", "inner").where("v > u").select("m", F.col("v").alias("w")).where("m <> w").distinct()
        down = written(large.select(F.greatest("m", "w").alias("u"), F.least("m", "w").alias("v")), "down", paths[1])
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least", paths[2])
        small = joined(down, least, "u", "inner").select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e")).select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
        last, path = path, new_path(spark, "edges")
        edges = written(small.where("a <> b").distinct(), "edges", path)
        for done in (last, *paths):
            discard(spark, done)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, words: int = 3, segments: int = 2) -> DataFrame:
    """One row per document: its fingerprint (16 hexadecimal digits) and its component's smallest id."""
    marked = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes, max_bits, segments))
    rooted = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    names = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = written(joined(rooted, names, "root", "inner").select("fp", "component_id"), "named")
    return joined(marked, named, "fp", "inner").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of the smallest id.

    Rows that repeat an id are one document and stay together; rows without an id stay, as no group can name them.
    """
    found = near_duplicates(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    gone = found.groupBy(id_col).agg(F.bool_or(F.col(id_col) == F.col("component_id")).alias("first")).where("not first")
    return without(docs, gone, id_col)
