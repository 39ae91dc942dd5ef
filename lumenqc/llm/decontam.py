"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A mask such as 1101011 slides over the words of a text; the words under a 1 are hashed together, those under
a 0 are ignored, so a substituted word spoils only the seeds that look at it.  Training seeds join the benchmark's;
a match fixes how document and item lie over one another, and there the words are compared: the pair counts
if some window of ``window`` words (or the whole item, if shorter) has ``identity`` of its words in place.

An item of fewer than 16 words has masks of its own, as the two above would miss some of its allowed substitutions: where s of its
n words may differ, the places that leave the same remainder by s + 1 make a mask, laid over the whole item.
s substitutions spoil at most s of these s + 1 masks, so one is left, and no such overlap is missed.  Documents are looked
through with these masks only for lengths that the benchmark has.

The benchmark's seeds are counted first: up to ``broadcast_rows`` of them are broadcast; beyond that seeds are shuffled, common ones
apart from the rest.  What matches say, document, item and shift, is made distinct where it is found, and these few join the texts again; a shift is
verified in time linear in the item.

Words are runs of letters and digits, lower-cased.  Special cases: null and empty texts have no seeds and an item without words
matches nothing; very long texts are read whole; repeated documents repeat under their own ids, repeated
rows of one id count once; rows without an id match under null; of equal windows the first counts; an empty table on either side
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.llm.common import is_small, joined, let, without, written

#: Positions that count (1) and that are ignored (0).
MASKS = ("1101011", "11100101")
#: Items of fewer words have masks of their own.
SHORT = 16


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seed(hashes: Column, at: Column, mask: str) -> Column:
    """The mask's seed at place ``at`` of an array of word hashes; null where the mask stands over the end."""
    looked = [k for k, c in enumerate(mask) if c == "1"]
    return F.when(at <= F.size(hashes) - len(mask), F.xxhash64(*(F.get(hashes, at + k) for k in looked), F.lit(mask)))


def hashed(table: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    words = table.select(F.col(id_col).alias(name), tokens(F.col(text_col)).alias("words"))
    return words.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def seed_rows(table: DataFrame, masks: tuple[str, ...], *kept: str) -> DataFrame:
    """A row for each mask and place: seed, place ``at``, and ``kept``.

    Places are exploded first, so seeds, and the join after them, are generated code that passes the words of a text on
    by reference and copies them for matches alone.  The outer form keeps the optimiser from adding a filter that would
    build the array twice.
    """
    places = table.select(*kept, "h", F.posexplode_outer("h").alias("at", "own"))
    return places.select(*kept, "at", F.explode(F.array(*(seed(F.col("h"), F.col("at"), m) for m in masks))).alias("seed")).where(F.col("seed").isNotNull())


def own_masks(n: int, identity: float) -> list[tuple[int, str]]:
    """Place and mask of each class of places of an item of ``n`` words; one class at least has no substitution."""
    classes = n - math.ceil(identity * n - 1e-9) + 1
    return [(k, "".join("1" if i % classes == 0 else "0" for i in range(n - k)).rstrip("0")) for k in range(min(classes, n))]


def agreement(item: Column, words: Column, shift: Column) -> Column:
    """1 for each word of ``item`` that stands in ``words`` at its place plus ``shift``, else 0."""
    return F.transform(item, lambda w, k: F.when(F.get(words, shift + k) == w, 1).otherwise(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def best_window(hit: Column, width: Column) -> Column:
    """The largest sum of ``width`` neighbours, by a running sum."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def slide(state: Column, k: Column) -> Column:
        run = state["run"] + F.get(hit, k) - F.when(k >= width, F.get(hit, k - width)).otherwise(0)
        return let(run, lambda r: F.struct(r.alias("run"), F.greatest(r, state["best"]).alias("best")))

    return F.aggregate(F.sequence(F.lit(0), F.size(hit) - 1), start, slide)["best"]


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, window: int = 20, identity: float = 0.8, broadcast_rows: int = 500_000,
) -> DataFrame:
    """One row per document and item that overlap: words in place, of how many, and the best window's."""
    items = hashed(benchmark, item_col, item_text_col, "item").withColumnRenamed("words", "item_words")
    size = F.size("item_words")
    keys = seed_rows(items.where(size >= SHORT), masks, "item")
    short = [r[0] for r in items.where((size > 0) & (size < SHORT)).select(size).distinct().collect()]  # numbers under SHORT
    for n in sorted(short):
        for at, mask in own_masks(n, identity):
            own = items.where(size == n).select("item", F.lit(at).alias("at"), seed(F.col("h"), F.lit(at), mask).alias("seed"))
            keys, masks = keys.unionByName(own), (*masks, mask)
    keys, masks = written(keys.withColumnRenamed("at", "item_at").distinct(), "seeds"), tuple(dict.fromkeys(masks))
    words = items.select("item", "item_words").distinct()
    # seeds of one overlap agree in how far the item is shifted: each shift is verified once, however many seeds name it
    met = joined(seed_rows(hashed(docs, id_col, text_col, "doc"), masks, "doc"), keys, "seed", "inner", broadcast_rows)
    met = written(met.select("doc", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "shifts")
    named = met.select(F.col("doc").alias("named")).distinct()
    held = docs.select(id_col, text_col).join(F.broadcast(named) if is_small(named) else named, F.col(id_col).eqNullSafe(F.col("named")), "left_semi")
    texts = held.select(F.col(id_col).alias("text_doc"), tokens(F.col(text_col)).alias("words"))
    found = met.join(F.broadcast(words) if is_small(words, broadcast_rows) else words, met["item"].eqNullSafe(words["item"])).drop(words["item"])
    found = found.join(texts, F.col("doc").eqNullSafe(F.col("text_doc"))).drop("text_doc")
    width = F.least(size, F.lit(window))
    judged = let(agreement(F.col("item_words"), F.col("words"), F.col("shift")), lambda hit: F.struct(best_window(hit, width).alias("best"), total(hit).alias("matched")))
    checked = found.select("doc", "item", "shift", size.alias("n_item_words"), width.alias("width"), judged.alias("j")).select("*", "j.best", "j.matched").where(F.col("best") >= identity * F.col("width"))
    return (
        checked.select("doc", "item", "n_item_words", "width", "best", "matched", F.greatest("shift", F.lit(0)).alias("place"))
        .groupBy("doc", "item")
        .agg(F.max("matched").cast("long").alias("matched_words"), F.max("n_item_words").cast("long").alias("n_item_words"), F.max(F.col("best") / F.col("width")).alias("identity"), F.min("place").cast("long").alias("first_word"))
        .withColumnsRenamed({"doc": id_col, "item": item_col})
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that overlap an item; rows without an id stay, as no match can name them."""
    return without(docs, overlaps(docs, benchmark, id_col, text_col, **how), id_col)
