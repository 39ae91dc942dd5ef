"""Where the product is, estimated from a picture's pixels: priors, contact shadow and evidence.

Pictures are square rasters in array columns, an array a channel, values from 0 to 255.  Each function takes a table and adds columns, one step
after the other, so that no expression is repeated; nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.functions import filters, neighbourhood
from lumenqc.functions.neighbourhood import let


@dataclass(frozen=True)
class Sizes:
    """What depends on the size of the pictures."""

    side: int
    #: Width of the border ring that stands for the background.
    ring: int
    #: Pixels that a mask must have to be measured, and a component to be kept (or ``least_share`` of the frame, if more).
    enough: int = 80
    least_share: float = 0.004
    #: Openings and closings of what is salient.
    smoothing: int = 2
    #: The least growth around a mask, in pixels, and the most; around its shadow; and of its penumbra.
    growth: int = 14
    most_growth: int = 70
    halo: int = 6
    penumbra: int = 3

    @staticmethod
    def of(side: int) -> Sizes:
        return Sizes(side, max(8, int(0.06 * side)), halo=max(6, int(0.04 * side)))


#: The share of the frame beyond which components aren't added, and how many are kept.
MOST_SHARE, MOST_COMPONENTS = 0.42, 3
SOFT, SOLID, WHITE = 40.0, 80.0, 248.0


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mask(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def where(values: Column, on: Column) -> Column:
    """The values at the pixels of a mask."""
    pairs = F.filter(F.zip_with(values, on, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda p: p["m"] >= 1)
    return F.transform(pairs, lambda p: p["v"])


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def no(a: Column) -> Column:
    return F.transform(a, lambda x: 1.0 - x)


def share(a: Column) -> Column:
    return total(a) / F.size(a)


def quantile(values: Column, q: float, otherwise: float) -> Column:
    """By linear interpolation; ``otherwise`` of no values."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * q
        low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return F.when(F.size(s) > 0, low + (high - low) * (at - F.floor(at))).otherwise(otherwise)

    return let(F.array_sort(values), of)


def deviation(values: Column, mean: Column) -> Column:
    squares = F.transform(values, lambda v: (v - mean) * (v - mean))
    return F.sqrt(total(squares) / F.size(values))


def by_pixel(columns: list[str], body) -> Column:
    """An array of ``body`` of a struct of the columns' values at each pixel."""
    return F.transform(F.arrays_zip(*columns), body)


def repeated(x: Column, times: int, step) -> Column:
    for _ in range(times):
        x = let(x, step)
    return x


def grown(on: Column, side: int, steps: Column) -> Column:
    """The mask dilated ``steps`` times by a cross, or until it doesn't change."""
    start = F.struct(on.alias("now"), F.lit(False).alias("done"))

    def again(state: Column, _: Column) -> Column:
        new = let(state["now"], lambda now: let(neighbourhood.dilated(now, side), lambda n: F.struct(n.alias("now"), (n == now).alias("done"))))
        return F.when(state["done"], state).otherwise(new)

    rounds = F.filter(F.sequence(F.lit(0), steps.cast("int")), lambda k: k > 0)
    return F.aggregate(rounds, start, again)["now"]


def ring(side: int, width: int) -> Column:
    inner = lambda k: k.between(width, side - 1 - width)
    return neighbourhood.pixels(side, lambda y, x: mask(~(inner(y) & inner(x))))


def boxed(side: int, box: Column, margin_y: Column, margin_x: Column) -> Column:
    """A mask of the box, wider by the margins."""
    inside = lambda k, low, high, m: k.between(low - m, high + m)
    return neighbourhood.pixels(side, lambda y, x: mask(inside(y, box["top"], box["bottom"], margin_y) & inside(x, box["left"], box["right"], margin_x)))


def background(pictures: DataFrame, size: Sizes) -> DataFrame:
    """Luma, edges and texture of ``r``, ``g``, ``b``, the background's luma, spread and colour in the border ring, and the distances to it."""
    c, side = F.col, size.side
    lit = pictures.withColumn("luma", by_pixel(["r", "g", "b"], lambda p: 0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]))
    lit = lit.withColumns({"edge": neighbourhood.gradient(c("luma"), side), "texture": filters.local_std(c("luma"), side, side, 2), "ring": ring(side, size.ring)})
    lit = lit.withColumn("border", where(c("luma"), c("ring")))
    mean = lambda name: share(where(c(name), c("ring")))
    lit = lit.withColumns({"bg_luma": quantile(c("border"), 0.5, 220.0), "bg_std": deviation(c("border"), share(c("border"))), "bg_r": mean("r"), "bg_g": mean("g"), "bg_b": mean("b")})
    apart = lambda p, k: (p[k] - c(f"bg_{k}")) * (p[k] - c(f"bg_{k}"))
    colour = by_pixel(["r", "g", "b"], lambda p: F.sqrt(apart(p, "r") + apart(p, "g") + apart(p, "b")))
    white = by_pixel(["r", "g", "b"], lambda p: mask((p["r"] >= WHITE) & (p["g"] >= WHITE) & (p["b"] >= WHITE)))
    return lit.withColumns({"d_luma": F.transform("luma", lambda v: F.abs(v - c("bg_luma"))), "d_colour": colour, "white": white}).drop("ring", "border")


def largest(labels: Column, side: int, least: float) -> Column:
    """The mask of the largest components: at most three of at least ``least`` pixels, until they hold enough of the frame; or else the largest alone.

    Of equally large ones the one that ends later counts as larger.
    """
    kinds = F.array_distinct(F.filter(labels, lambda v: v > 0))
    sized = F.transform(kinds, lambda k: F.struct(F.size(F.filter(labels, lambda v: v == k)).alias("n"), k.alias("label")))
    start = F.struct(F.lit(0.0).alias("held"), F.array().cast("array<double>").alias("kept"))

    def take(state: Column, part: Column) -> Column:
        fits = (part["n"] >= least) & (state["held"] / float(side * side) < MOST_SHARE)
        return F.when(fits, F.struct((state["held"] + part["n"]).alias("held"), F.array_append(state["kept"], part["label"]).alias("kept"))).otherwise(state)

    def chosen(order: Column) -> Column:
        kept = F.aggregate(F.slice(order, 1, MOST_COMPONENTS), start, take)["kept"]
        return F.when(F.size(kept) > 0, kept).otherwise(F.transform(F.slice(order, 1, 1), lambda p: p["label"]))

    names = let(F.reverse(F.array_sort(sized)), chosen)
    return let(names, lambda kept: F.transform(labels, lambda v: mask(F.array_contains(kept, v))))


def raw_prior(lit: DataFrame, size: Sizes) -> DataFrame:
    """``prior``: what stands out from the background, without any mask.  Weak edges or texture alone don't make a product."""
    c, side, k = F.col, size.side, size.smoothing

    def salient(p: Column) -> Column:
        like = (p["d_luma"] <= F.greatest(F.lit(16.0), c("bg_std") * 1.8)) & (p["d_colour"] <= 26.0)
        dark = p["luma"] <= c("bg_luma") - F.greatest(F.lit(22.0), c("bg_std") * 0.85)
        bright = p["luma"] >= c("bg_luma") + F.greatest(F.lit(28.0), c("bg_std") * 1.1)
        formed = (p["edge"] >= 16.0) & (p["texture"] >= 7.0) & (p["d_luma"] >= 14.0)
        return mask((p["white"] < 1) & ~like & (dark | bright | (p["d_colour"] >= 42.0) | formed))

    bigger, smaller = (lambda m: neighbourhood.dilated(m, side)), (lambda m: neighbourhood.eroded(m, side))
    made = lit.withColumn("salient", by_pixel(["luma", "edge", "texture", "d_luma", "d_colour", "white"], salient))
    made = made.withColumn("salient", repeated(repeated(c("salient"), k, smaller), k, bigger))
    made = made.withColumn("salient", repeated(repeated(c("salient"), k, bigger), k, smaller))
    labels = made.withColumn("labels", neighbourhood.components(c("salient"), side))
    return labels.withColumn("prior", largest(c("labels"), side, max(size.enough, size.least_share * side * side))).drop("salient", "labels")


def support(made: DataFrame, size: Sizes, portion: float, margin_y, margin_x) -> DataFrame:
    """``support``: the soft mask grown by a portion of its extent, within its box and a margin, which is given by height and width."""
    c, side = F.col, size.side
    held = made.withColumn("box", neighbourhood.box(c("soft"), side))
    held = held.withColumns({"box_h": c("box.bottom") - c("box.top") + 1, "box_w": c("box.right") - c("box.left") + 1})
    steps = F.least(F.lit(size.most_growth), F.greatest(F.lit(size.growth), F.floor(portion * F.greatest("box_h", "box_w") / 3.0)))
    room = boxed(side, c("box"), margin_y(c("box_h"), c("box_w")), margin_x(c("box_h"), c("box_w")))
    return held.withColumn("support", both(grown(c("soft"), side, steps), room)).drop("box", "box_h", "box_w")


def anchored_prior(lit: DataFrame, size: Sizes) -> DataFrame:
    """``mask_prior``: formed pixels near the mask ``alpha``, whose own edges and texture say what counts as formed; of a mask that has
    collapsed the raw prior (which ``raw_prior`` added)."""
    c = F.col
    soft = lit.withColumn("soft", F.transform("alpha", lambda a: mask(a >= SOFT)))
    margin = lambda h, w: F.floor(0.22 * F.greatest(h, w))
    made = support(soft, size, 0.12, margin, margin)
    enough = total(c("soft")) >= size.enough
    bar = lambda name, q, least: F.when(enough, F.greatest(F.lit(least), quantile(where(c(name), c("soft")), q, 0.0)))
    bars = F.struct(bar("edge", 0.50, 5.5).alias("edge"), bar("texture", 0.48, 4.0).alias("texture"))
    formed = lambda p, b: (p["edge"] >= b["edge"]) | (p["texture"] >= b["texture"]) | (p["alpha"] >= SOLID)
    names = ["support", "white", "edge", "texture", "alpha"]
    near = let(bars, lambda b: by_pixel(names, lambda p: mask((p["support"] >= 1) & (p["white"] < 1) & formed(p, b))))
    return made.withColumn("mask_prior", F.when(enough, near).otherwise(c("prior"))).drop("soft", "support")


def contact_shadow(lit: DataFrame, size: Sizes) -> DataFrame:
    """``shadow``: darker than the background, hardly formed and hardly coloured, around the solid part of the mask."""
    c, side = F.col, size.side
    made = lit.withColumns({"soft": F.transform("alpha", lambda a: mask(a >= SOFT)), "solid": F.transform("alpha", lambda a: mask(a >= SOLID))})
    made = made.withColumns({"halo": grown(c("soft"), side, F.lit(size.halo)), "near": grown(c("soft"), side, F.lit(size.penumbra))})

    def judged(p: Column) -> Column:
        darker = (p["solid"] < 1) & (p["luma"] <= c("bg_luma") - F.greatest(F.lit(8.0), c("bg_std") * 0.35))
        flat = (p["edge"] < 10.0) & (p["texture"] < 6.5) & (p["d_colour"] < 28.0) & (p["white"] < 1)
        faint = (p["edge"] < 8.0) & (p["texture"] < 5.0) & (p["d_luma"] < 55.0)
        return mask(darker & (((p["halo"] >= 1) & flat) | ((p["near"] >= 1) & faint)))

    names = ["luma", "edge", "texture", "d_luma", "d_colour", "white", "solid", "halo", "near"]
    return made.withColumn("shadow", by_pixel(names, judged)).drop("soft", "solid", "halo", "near")


def product_evidence(lit: DataFrame, size: Sizes, unreliable: Column) -> DataFrame:
    """``evidence`` of the product from the picture, with ``evidence_mode``, how much of it is formed, what the shadow took and what the parts added.

    A raw prior that can be relied on is the evidence, without white and shadow.  Else it is what is formed or coloured near the mask, unlike the
    background and, where there is a prior, in it or in the mask; solid pixels are kept though they be plain.  Darkness alone never counts.
    Needs ``prior`` and ``shadow``.
    """
    c = F.col
    soft, solid = F.transform("alpha", lambda a: mask(a >= SOFT)), F.transform("alpha", lambda a: mask(a >= SOLID))
    made = support(lit.withColumns({"soft": soft, "solid": solid}), size, 0.14, lambda h, w: F.floor(0.28 * h), lambda h, w: F.floor(0.28 * w))
    made = made.withColumns({"prior_share": share(c("prior")), "any_soft": total(c("soft")) > 0, "clear": both(no(c("white")), no(c("shadow")))})
    made = made.withColumn("core", F.when(total(c("solid")) > 0, c("solid")).otherwise(c("soft")))
    bar = lambda name, q, least, weak: F.when(total(c("core")) >= size.enough, F.greatest(F.lit(least), quantile(where(c(name), c("core")), q, 0.0))).otherwise(weak)
    made = made.withColumns({"edge_bar": bar("edge", 0.52, 7.0, 9.0), "texture_bar": bar("texture", 0.50, 5.0, 7.0)})
    formed = lambda p: (p["edge"] >= c("edge_bar")) | (p["texture"] >= c("texture_bar")) | (p["d_colour"] >= 36.0)
    dark = lambda p: (p["luma"] <= c("bg_luma") - F.greatest(F.lit(18.0), c("bg_std") * 0.7)) & (p["d_colour"] >= 36.0) & (p["edge"] >= 6.0)
    like = lambda p: (p["d_luma"] <= F.greatest(F.lit(14.0), c("bg_std") * 1.6)) & (p["d_colour"] <= 24.0)
    names = ["luma", "edge", "texture", "d_luma", "d_colour"]
    made = made.withColumns({"formed": by_pixel(names, lambda p: mask(formed(p))), "unlike": by_pixel(names, lambda p: mask(~like(p) & (formed(p) | dark(p))))})
    found = both(both(c("support"), c("clear")), c("unlike"))
    has_prior = (c("prior_share") > 0) & (c("prior_share") < 0.85)
    made = made.withColumn("found", F.when(c("any_soft"), found))
    made = made.withColumn("agreed", F.when(has_prior, both(c("found"), either(c("prior"), c("soft")))).otherwise(c("found")))
    made = made.withColumns({"plain": both(c("prior"), c("clear")), "near": either(c("agreed"), both(c("solid"), c("clear")))})
    trusted = ~unreliable & (c("prior_share") <= MOST_SHARE) & (c("prior_share") > 0)
    made = made.withColumns({"trusted": trusted, "evidence": F.when(trusted | ~c("any_soft"), c("plain")).otherwise(c("near"))})
    count = lambda x: total(x).cast("int")
    told = made.withColumns({
        "evidence_mode": F.when(c("trusted"), "independent_prior").otherwise("structured_near_support"),
        "evidence_pixels": count(c("evidence")), "soft_pixels": count(c("soft")),
        "structured_evidence_frac": F.when(c("trusted"), 1.0).when(~c("any_soft"), 0.0).otherwise(total(both(c("evidence"), c("formed"))) / F.greatest(F.lit(1.0), total(c("evidence")))),
        "prior_shadow_excluded": share(c("shadow")),
        "left_out": F.when(c("trusted") | ~c("any_soft"), total(c("prior")) - total(c("plain"))).otherwise(total(c("found")) - total(c("agreed"))).cast("int"),
        "kept_solid": F.when(c("trusted") | ~c("any_soft"), 0).otherwise(count(c("near")) - count(c("agreed"))),
        "overlap": total(both(c("evidence"), c("soft"))) / F.greatest(F.lit(1.0), total(c("soft"))),
    })
    return told.drop("soft", "solid", "support", "any_soft", "clear", "core", "edge_bar", "texture_bar", "formed", "unlike", "found", "agreed", "plain", "near", "trusted")
