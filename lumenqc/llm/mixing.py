"""Mixing sources to target weights by entropy balancing.

Each source has a target in words.  Document rates r = min(cap, exp(lambda * size / mean size)) are those nearest to one copy each (in
relative entropy, each document counting alike) that reach the target: the exponential tilt of the convex dual.  Newton iterations find
each source's lambda: a pass sums, over all documents, what the rates take and its derivative; a step that leaves the interval in
which the solution is known to lie is replaced by its middle.  As a rate depends on source and size alone, documents are counted by
these first and the passes read the counts; rows of one source lie in all tasks and are summed before they are shuffled.

Rates become copies by systematic rounding along the sizes of a source, so that the copies of any range of sizes are those of the rates
within one; what the words then lack or exceed is put right from the longest size that fits downwards.  The copies of a source and size go
to its documents in the order of a hash of their ids, so that they differ by one copy at most and reruns agree.

Special cases: a null text has size 0 and takes part with no words; documents without words are never taken; a source that must be taken whole at
the cap is; ties and repeated rows are documents of their own; a null source is the last one; an empty table or one without words gives targets
of 0; further columns are not read.  Copies of one size in a source number as many as an exact rank says: no group is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqc.llm.common import is_small, joined, written
from lumenqc.llm.ranks import ranked

#: Fixed values of the mix: weights of the sources in order, the share of all words, the most copies of a document.
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2
#: Newton stops when every source is this near its target, relative to it, or after so many passes.
NEAR, PASSES = 1e-7, 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (grp, total) with ``target``: by weight, but at most ``cap`` times the total; what is over is shared out again by weight.

    Weights repeat in the order of grp.  A pass sees which sources are full; it reads two sums, and there are no more passes than kinds of fullness.
    """
    order = ranked(sources.withColumn("all", F.lit(0)), ["all"], ["grp"], "mix-sources").drop("all")
    weighed = written(order.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-weights")
    budget = share * (weighed.agg(F.sum("total")).first()[0] or 0)
    rate, full = 0.0, None
    while True:
        limit = cap * F.col("total")
        over = F.col("weight") * rate >= limit if full is not None else F.lit(False)
        seen = weighed.agg(F.count_if(over).alias("full"), F.sum(F.when(over, limit).otherwise(0.0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("left")).first()
        if seen.full == full:
            break
        full, rate = seen.full, (budget - (seen.taken or 0)) / seen.left if seen.left else math.inf
    target = F.least(F.col("weight") * rate, limit.cast("double")) if math.isfinite(rate) else limit.cast("double")
    return weighed.select("grp", "total", target.alias("target"))


def balanced(cells: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """The tilt of each source: ``sources`` (grp, total, mean, target) with ``tilt``; null where every document is taken ``cap`` times.

    ``cells``: grp, size, n.
    """
    c = F.col
    full = c("target") >= cap * c("total")
    # below ``low`` a source takes less than its target, above ``high`` more: at ``high`` even the shortest documents reach the cap
    least = cells.where("size > 0").groupBy("grp").agg(F.min("size").alias("least"))
    state = joined(sources.where(~full & (c("target") > 0)), least, "grp").select(
        "grp", "mean", "target", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), (math.log(cap) * c("mean") / c("least")).alias("high"), F.lit(False).alias("done")
    )
    state = written(state, "mix-tilts")
    # a row a source: counted once, as their number stays
    by_source = F.broadcast if is_small(state) else lambda x: x
    for _ in range(PASSES):
        told = cells.where("size > 0").join(by_source(state.where(~c("done"))), "grp")
        x = c("size") / c("mean")
        free = F.exp(c("tilt") * x)
        taken = F.sum(c("n") * c("size") * F.least(F.lit(float(cap)), free)).alias("taken")
        slope = F.sum(F.when(free < cap, c("n") * c("size") * x * free).otherwise(0.0)).alias("slope")
        seen = state.join(by_source(told.groupBy("grp").agg(taken, slope)), "grp", "left")
        gap = c("target") - c("taken")
        low, high = F.when(gap > 0, c("tilt")).otherwise(c("low")), F.when(gap < 0, c("tilt")).otherwise(c("high"))
        newton = c("tilt") + gap / F.when(c("slope") > 0, c("slope"))
        # without a lower end yet, a step down at most doubles the way gone
        floor = F.coalesce(low, 2 * F.least(c("tilt"), F.lit(0.0)) - 1.0)
        stepped = F.when((newton > floor) & (newton < high), newton).otherwise(F.when(low.isNull(), floor).otherwise((floor + high) / 2))
        near = F.abs(gap) <= NEAR * c("target")
        moved = lambda name, new: F.when(c("done"), c(name)).otherwise(new).alias(name)
        state = written(seen.select("grp", "mean", "target", moved("tilt", F.when(near, c("tilt")).otherwise(stepped)), moved("low", low), moved("high", high), (c("done") | near).alias("done")), "mix-tilts")
        if state.where(~c("done")).isEmpty():
            break
    return joined(sources, state.select("grp", "tilt"), "grp")


def rounded(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """Whole copies of each cell: ``rated`` (grp, size, n, target, rate) to grp, size, n, copies.

    A source's cells are as many as it has different sizes, which its longest text bounds; they meet in one task.
    """
    c = F.col
    along = Window.partitionBy("grp").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sofar = F.floor(F.sum(c("n") * c("rate")).over(along) + 0.5)
    cells = rated.withColumn("sofar", sofar)
    ahead = F.coalesce(F.lag("sofar").over(Window.partitionBy("grp").orderBy("size")), F.lit(0))
    cells = written(cells.withColumn("copies", F.least(cap * c("n"), F.greatest(F.lit(0), c("sofar") - ahead)).cast("long")).drop("sofar"), "mix-rounded")

    def put_right(state: Column, cell: Column) -> Column:
        """Copies more or fewer of a cell, as many as fit into what is missing or over."""
        missing = state["missing"]
        room = F.when(missing > 0, cap * cell["n"] - cell["copies"]).otherwise(cell["copies"])
        k = F.least(room, F.floor(F.abs(missing) / cell["size"])) * F.signum(missing).cast("long")
        some = F.concat(state["changes"], F.array(F.struct(cell["size"].alias("size"), k.alias("change"))))
        return F.when(k != 0, F.struct((missing - k * cell["size"]).alias("missing"), some.alias("changes"))).otherwise(state)

    longest_first = F.reverse(F.array_sort(F.collect_list(F.struct("size", "n", "copies"))))
    by_source = cells.where("size > 0").groupBy("grp").agg(longest_first.alias("cells"), (F.first("target") - F.sum(c("copies") * c("size"))).alias("missing"))
    start = F.struct(F.round("missing").cast("long").alias("missing"), F.array().cast("array<struct<size:bigint,change:bigint>>").alias("changes"))
    changes = by_source.select("grp", F.inline(F.aggregate("cells", start, put_right)["changes"]))
    return cells.join(changes, ["grp", "size"], "left").select("grp", "size", "n", (c("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """How often the mix takes each of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, rate, copies, taken."""
    c = F.col
    group = F.when(c("source").isNull(), "1").otherwise(F.concat(F.lit("0"), c("source").cast("string")))
    sized = docs.select("doc_id", c("source").alias("of"), group.alias("grp"), words(c("text")).alias("size"), F.xxhash64(c("doc_id").cast("string")).alias("drawn"))
    order = ranked(sized, ["grp", "size"], ["drawn", "doc_id"], "mix")
    order = written(order, "mix-ranked")
    cells = written(order.groupBy("grp", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = cells.groupBy("grp").agg(F.sum(c("n") * c("size")).alias("total"), (F.sum(c("n") * c("size")) / F.sum(F.when(c("size") > 0, c("n")))).alias("mean"))
    sources = written(sources, "mix-totals")
    aimed = written(targets(sources.select("grp", "total"), share, cap, weights), "mix-targets")
    tilts = balanced(cells, joined(aimed, sources.select("grp", "mean"), "grp"), cap)
    tilts = written(tilts, "mix-balanced")
    rate = F.when(c("size") == 0, 0.0).when(c("target") >= cap * c("total"), float(cap)).when(c("target") <= 0, 0.0)
    rated = joined(cells, tilts, "grp").withColumn("rate", rate.otherwise(F.least(F.lit(float(cap)), F.exp(c("tilt") * c("size") / c("mean")))))
    rated = written(rated.select("grp", "size", "n", "total", "target", "rate"), "mix-rates")
    whole = written(rounded(rated, cap).join(rated.select("grp", "size", "total", "target", "rate"), ["grp", "size"]), "mix-copies")
    cell = F.concat_ws(":", "size", "grp").alias("cell")
    placed = joined(order.select("*", cell), whole.select(cell, "n", "total", "target", "rate", "copies"), "cell")
    copies = F.floor(c("copies") / c("n")) + F.when(c("rank") < c("copies") % c("n"), 1).otherwise(0)
    made = placed.withColumn("copies", copies.cast("long"))
    return made.select("doc_id", c("of").alias("source"), "size", c("total").alias("source_size"), "target", "rate", "copies", (c("copies") * c("size")).alias("taken"))
