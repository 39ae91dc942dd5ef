"""Merkle manifest of a table, with the proof of every row.

Rows are leaves; of each group (a source) the leaves ascend by id and every 16 consecutive nodes become their hash, until one is
left.  The groups' roots, ordered by group, give the root of the whole table in the same way.

Method: butterfly exchange.  A group's leaves are cut into aligned blocks of 16 ** 2 consecutive ones, which are the units of
distribution: each hashes its own subtree.  Then blocks swap roots round by round.  In round r a block holds its ancestor 16 ** r
blocks wide and sends it to the blocks of the 15 sibling ancestors that have the same place in theirs; everyone who has received a
whole run hashes the parent redundantly and notes its siblings as a step of its proof.  After the last round each block has all upper steps
of its rows' proofs: nothing is sent down again.  The last ancestor of a round may be narrower than its siblings; its blocks then
serve the places that it lacks in turns.  A round is one shuffle of at most 16 narrow rows a block.

Special cases: a null value is hashed as ``-``, other than an empty one; ties of an id are ordered by leaf, and equal rows are
equal leaves, each with a proof of its own place; a null id sorts first and the null group is a group of its own, the first; texts
of any length are hashed whole; an empty table has no rows and no root; further columns are not hashed unless named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.llm.common import is_small, joined, written
from lumenqc.llm.ranks import ranked

FANOUT = 16
#: Levels that a block of consecutive leaves hashes by itself.
LEVELS = 2
#: Targets of one message are listed in arrays of so many, so that no row becomes long.
LISTED = 65_536
PATH = "array<struct<before:string,after:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return hashed(*map(field, values))


def between(nodes: Column, first: Column, last: Column) -> Column:
    """The nodes' hashes from place ``first`` to ``last``, concatenated."""
    listed = F.transform(F.sequence(first, last), lambda k: F.get(nodes, k))
    return F.when(last < first, "").otherwise(F.array_join(listed, ""))


def parents(nodes: Column) -> Column:
    """The hashes of the runs of 16 nodes."""
    last = F.size(nodes) - 1
    runs = F.sequence(F.lit(0), F.floor(last / FANOUT).cast("int"))
    return F.transform(runs, lambda k: F.sha2(between(nodes, k * FANOUT, F.least(k * FANOUT + FANOUT - 1, last)), 256))


def step(nodes: Column, at: Column) -> Column:
    """The siblings before and after the node at place ``at``."""
    first = at - at % FANOUT
    last = F.least(first + FANOUT - 1, F.size(nodes) - 1)
    return F.struct(between(nodes, first, at - 1).alias("before"), between(nodes, at + 1, last).alias("after"))


def blocks(leaves: DataFrame, name: str) -> DataFrame:
    """A row for a block of consecutive leaves: its levels, its own root ``top`` and how many blocks its group has (``n``).

    ``leaves``: grp, rank, leaf and item, which goes along.
    """
    block = F.floor(F.col("rank") / FANOUT**LEVELS).alias("block")
    listed = F.sort_array(F.collect_list(F.struct("rank", "leaf", "item"))).alias("rows")
    cut = written(leaves.groupBy("grp", block).agg(listed), f"{name}-blocks")
    cut = joined(cut, written(cut.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), f"{name}-groups"), "grp")
    made = cut.withColumn("level0", F.transform("rows", lambda r: r["leaf"]))
    for k in range(LEVELS):
        goes_on = (F.col("n") > 1) | (F.size(f"level{k}") > 1)
        made = made.withColumn(f"level{k + 1}", F.when(goes_on, parents(F.col(f"level{k}"))))
    top = F.coalesce(*(F.get(f"level{k}", F.lit(0)) for k in range(LEVELS, -1, -1)))
    return written(made.withColumn("top", top), f"{name}-trees")


def exchanged(state: DataFrame, stride: int) -> DataFrame:
    """One round: ``state`` (grp, block, n, top, path) with ancestors and paths of a level more, where a group has one more."""
    c = F.col
    node = F.floor(c("block") / stride)
    sent = state.withColumns({"node": node, "first": F.floor(node / FANOUT) * FANOUT, "width": F.least(F.lit(stride), c("n") - node * stride)})
    last = F.least(c("first") + FANOUT - 1, F.floor((c("n") - 1) / stride))
    sent = sent.withColumn("to", F.explode(F.sequence(c("first"), last)))
    # the places of this block's part in the sibling: its own and, if the sibling is wider, those that this one lacks
    start = c("to") * stride + c("block") % stride
    end = F.least((c("to") + 1) * stride, c("n")) - 1
    own = c("to") == c("node")
    sent = sent.withColumns({"own": own, "start": F.when(own, c("block")).otherwise(start), "end": F.when(own, c("block")).otherwise(end)}).where("start <= end")
    lots = F.sequence(F.lit(0), F.floor((c("end") - c("start")) / (c("width") * LISTED)))
    sent = sent.withColumn("lot", F.explode(lots)).withColumn("start", c("start") + c("lot") * c("width") * LISTED)
    some = F.sequence(c("start"), F.least(c("end"), c("start") + c("width") * (LISTED - 1)), c("width"))
    slot = c("node") - c("first")
    mine = lambda x: F.when(c("own"), x)
    sent = sent.select("grp", "n", F.explode(some).alias("block"), slot.alias("slot"), "top", mine(slot).alias("at"), mine(c("path")).alias("path"))
    met = sent.groupBy("grp", "block").agg(
        F.first("n").alias("n"), F.max("at").alias("at"), F.first("path", ignorenulls=True).alias("path"),
        F.sort_array(F.collect_list(F.struct("slot", "top"))).alias("run"),
    )
    hashes = lambda test: F.array_join(F.transform(F.filter("run", test), lambda s: s["top"]), "")
    side = F.struct(hashes(lambda s: s["slot"] < c("at")).alias("before"), hashes(lambda s: s["slot"] > c("at")).alias("after"))
    more = c("n") > stride
    return met.select(
        "grp", "block", "n",
        F.when(more, F.sha2(hashes(lambda s: F.lit(True)), 256)).otherwise(F.get("run", F.lit(0))["top"]).alias("top"),
        F.when(more, F.concat("path", F.array(side))).otherwise(c("path")).alias("path"),
    )


def climbed(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with the path from their root to that of their group (``upper``) and that root (``subroot``); and the groups' roots."""
    trees = blocks(leaves, name)
    state = trees.select("grp", "block", "n", "top", F.array().cast(PATH).alias("path"))
    most, stride = trees.agg(F.max("n")).first()[0] or 0, 1
    while stride < most:
        state, stride = exchanged(state, stride), stride * FANOUT
    state = written(state.select("grp", "block", F.col("top").alias("subroot"), F.col("path").alias("upper")), f"{name}-upper")
    small = F.broadcast(state) if is_small(state) else state
    return trees.join(small, ["grp", "block"]), state.where("block = 0").select("grp", "subroot")


def opened(trees: DataFrame, *kept: str) -> DataFrame:
    """A row for a leaf: its item, leaf and path up to ``upper``, and the columns ``kept``."""

    def local(at: Column) -> Column:
        steps = [F.when(F.col(f"level{k + 1}").isNotNull(), step(F.col(f"level{k}"), F.floor(at / FANOUT**k).cast("int"))) for k in range(LEVELS)]
        return F.filter(F.array(*steps), lambda s: s.isNotNull())

    rows = F.transform("rows", lambda r, at: F.struct(r["item"].alias("item"), r["leaf"].alias("leaf"), F.concat(local(at), F.col("upper")).alias("path")))
    return trees.select(*kept, F.inline(rows))


def manifest(leaves: DataFrame) -> DataFrame:
    """For each row of ``leaves`` (group, key, leaf and a struct item): item, leaf, subroot, root and proof.

    The proof lists, from the leaf's level to the root, the siblings before and after the node, as concatenated hashes.
    """
    group = F.when(F.col("group").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("group").cast("string")))
    named = leaves.select(group.alias("grp"), "key", "leaf", "item")
    trees, roots = climbed(ranked(named, ["grp"], ["key", "leaf"], "merkle"), "merkle")
    tops = roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("leaf"), F.struct(F.col("grp").alias("of")).alias("item"))
    over, root = climbed(ranked(tops, ["grp"], ["key"], "merkle-top"), "merkle-top")
    above = opened(over, "subroot").select(F.col("item.of").alias("grp"), F.col("path").alias("above"), F.col("subroot").alias("root"))
    trees = joined(trees, written(above, "merkle-above"), "grp").withColumn("upper", F.concat("upper", "above"))
    return opened(trees, "subroot", "root").withColumnRenamed("path", "proof")


def folded(claimed: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, claimed, lambda node, s: hashed(s["before"], node, s["after"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, hashed together."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, held against a copy in which one in five is lower-cased.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (from the copy's leaf and the original proof) and verified.
    """
    c = F.col
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.crc32(c("doc_id").cast("string")) % 5 == 0
    of = lambda text: leaf(c("doc_id"), c("source"), c("lang"), c("n_chars"), text)
    whole = of(c("text"))
    item = F.struct(c("doc_id"), F.when(altered, of(lowered)).otherwise(whole).alias("claimed"))
    made = manifest(docs.select(c("source").alias("group"), c("doc_id").alias("key"), whole.alias("leaf"), item.alias("item")))
    made = made.withColumn("folded_root", folded(c("item.claimed"), c("proof")))
    return made.select("item.doc_id", "leaf", "subroot", "root", siblings(c("proof")).alias("proof_sha256"), "folded_root", (c("folded_root") == c("root")).alias("verified"))
