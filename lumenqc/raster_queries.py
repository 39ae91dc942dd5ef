"""Registered queries that filter and measure rasters, each with its SQL over rows of pixels.

The vectors of the table are 8 x 8 rasters; a picture's red, green, blue and alpha are those of four ids that follow one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqc import oracles
from lumenqc.functions import filters, text
from lumenqc.plans import analysis, gates, measures, priors, spatial
from lumenqc.queries import _CUTOUT_RULES, _INTEGRITY_RULES, GREY_SQL, NEIGHBOURS_SQL, _labels_sql, _spoken_sql, grey, neighbours, query, r, read

SIDE = 8
#: The gates' sizes for rasters this small.
SIZE = priors.Sizes(SIDE, ring=1, enough=6, smoothing=1, growth=1, most_growth=3, halo=2, penumbra=1)
NEED = measures.Need(foreground=6, solid=3, band=3, band_radius=1, prior=6, fallback=4, tones=4, selective=8, edges=4)


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", grey().alias("x"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, r, g, b, alpha)."""
    one, made = rasters(spark, sf_dir), None
    for k, name in enumerate(("r", "g", "b", "alpha")):
        part = one.select((F.col("vec_id") - k).alias("vec_id"), F.col("x").alias(name))
        made = part if made is None else made.join(part, "vec_id")
    return made


def _near(list_: str, y: str, x: str) -> str:
    """The value of an SQL list at a place, or the nearest one inside."""
    return f"{list_}[greatest(0, least(7, {y})) * 8 + greatest(0, least(7, {x})) + 1]"


PIXELS_SQL = f"g AS (SELECT vec_id, {GREY_SQL} AS v FROM embeddings), px AS (SELECT vec_id, v, i, i // 8 AS y, i % 8 AS x FROM (SELECT *, unnest(range(64)) AS i FROM g))"


@query(f"""WITH {PIXELS_SQL}, m AS (SELECT vec_id, y, x, v[i + 1] AS own FROM px WHERE v[i + 1] >= 200),
n AS (SELECT p.vec_id, p.i, m.own, (p.y - m.y) * (p.y - m.y) + (p.x - m.x) * (p.x - m.x) AS d2, row_number() OVER (PARTITION BY p.vec_id, p.i ORDER BY (p.y - m.y) * (p.y - m.y) + (p.x - m.x) * (p.x - m.x), m.y DESC, m.x DESC) AS k FROM px p LEFT JOIN m USING (vec_id))
SELECT vec_id, round(sum(coalesce(sqrt(d2), 1000000.0)), 4)::DOUBLE AS distance, coalesce(max(d2), -1)::BIGINT AS farthest, sum(coalesce(own, 0) * (i + 1))::BIGINT AS nearest_sum FROM n WHERE k = 1 GROUP BY 1""")
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean distance of each pixel to the nearest bright one, and that one's value."""
    near = filters.nearest_member(F.transform("x", lambda v: F.when(v >= 200, 1.0).otherwise(0.0)), SIDE, SIDE)
    found = rasters(spark, sf_dir).withColumn("n", near)
    values = F.transform(filters.nearest_values(F.col("n"), F.col("x")), lambda v, i: v * (i + 1))
    farthest = F.coalesce(F.array_max(F.transform("n", lambda p: p["high"])), F.lit(-1.0)).cast("long")
    return found.select("vec_id", r(priors.total(filters.distances(F.col("n")))).alias("distance"), farthest.alias("farthest"), priors.total(values).cast("long").alias("nearest_sum"))


def _window_sql(value: str, radius: int) -> str:
    """The mean of a window over the list ``value`` around place i."""
    n = 2 * radius + 1
    return f"list_sum(list_transform(range({n * n}), lambda k: {_near(value, f'i // 8 + k // {n} - {radius}', f'i % 8 + k % {n} - {radius}')})) / {float(n * n)}"


@query(f"""WITH {NEIGHBOURS_SQL}, s AS (SELECT vec_id, list_transform(z, lambda p: p[1] / 255.0) AS g, list_transform(z, lambda p: p[2] / 255.0) AS s FROM n), px AS (SELECT *, unnest(range(64)) AS i FROM s),
w AS (SELECT vec_id, i, g[i + 1] AS own, {_window_sql("g", 2)} AS mg, {_window_sql("s", 2)} AS ms, {_window_sql("list_transform(g, lambda v: v * v)", 2)} AS mgg, {_window_sql("list_transform(list_zip(g, s), lambda v: v[1] * v[2])", 2)} AS mgs FROM px),
f AS (SELECT vec_id, list(a ORDER BY i) AS a, list(ms - a * mg ORDER BY i) AS b, list(own ORDER BY i) AS own FROM (SELECT *, (mgs - mg * ms) / (greatest(0.0, mgg - mg * mg) + 0.001) AS a FROM w) GROUP BY 1),
o AS (SELECT vec_id, i, ({_window_sql("a", 2)}) * own[i + 1] + {_window_sql("b", 2)} AS v FROM (SELECT *, unnest(range(64)) AS i FROM f))
SELECT vec_id, round(sum(v), 4)::DOUBLE AS total, round(max(v), 4)::DOUBLE AS most, round(min(v), 4)::DOUBLE AS least, round(sum(v * (i + 1)), 3)::DOUBLE AS placed FROM o GROUP BY 1""")
def guided_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster as an alpha, smoothed along the edges of its neighbour."""
    unit = lambda name: F.transform(name, lambda v: v / 255.0)
    pairs = neighbours(spark, sf_dir).select("vec_id", unit("x").alias("guide"), unit("y").alias("alpha"))
    found = pairs.select("vec_id", filters.guided(F.col("guide"), F.col("alpha"), SIDE, SIDE, 2, 0.001).alias("v"))
    placed = priors.total(F.transform("v", lambda v, i: v * (i + 1)))
    return found.select("vec_id", r(priors.total(F.col("v"))).alias("total"), r(F.array_max("v")).alias("most"), r(F.array_min("v")).alias("least"), r(placed, 3).alias("placed"))


@query(f"""WITH {PIXELS_SQL}, k AS (SELECT d, exp(-0.5 * (d / 0.8::DOUBLE) * (d / 0.8::DOUBLE)) AS w FROM (SELECT unnest(range(-3, 4)) AS d)), t AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
b AS (SELECT p.vec_id, p.i, sum(a.w * c.w * {_near("p.v", "p.y + a.d", "p.x + c.d")}) AS v FROM px p, t a, t c GROUP BY ALL),
e AS (SELECT vec_id, list_max(list_transform(range(9), lambda k: {_near("v", "y + k // 3 - 1", "x + k % 3 - 1")})) AS high, list_min(list_transform(range(9), lambda k: {_near("v", "y + k // 3 - 1", "x + k % 3 - 1")})) AS low FROM px)
SELECT vec_id, blurred, most_blurred, range_sum FROM (SELECT vec_id, round(sum(v * (i + 1)), 3)::DOUBLE AS blurred, round(max(v), 4)::DOUBLE AS most_blurred FROM b GROUP BY 1) JOIN (SELECT vec_id, sum(high - low)::BIGINT AS range_sum FROM e GROUP BY 1) USING (vec_id)""")
def separable_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian blur, and the range of values in each pixel's neighbourhood."""
    made = rasters(spark, sf_dir).withColumns({"g": filters.gaussian(F.col("x"), SIDE, SIDE, 0.8), "h": filters.maximum(F.col("x"), SIDE, SIDE, 1), "l": filters.minimum(F.col("x"), SIDE, SIDE, 1)})
    blurred = priors.total(F.transform("g", lambda v, i: v * (i + 1)))
    return made.select("vec_id", r(blurred, 3).alias("blurred"), r(F.array_max("g")).alias("most_blurred"), (priors.total(F.col("h")) - priors.total(F.col("l"))).cast("long").alias("range_sum"))


def _taps_sql(name: str, size: int, to: int, kernel: str) -> str:
    """Table ``name`` (k, i, w): the weight of old pixel i in new pixel k."""
    stretch = max(1.0, size / to)
    x = f"((i + 0.5::DOUBLE - (k + 0.5::DOUBLE) * {size / to}::DOUBLE) / {stretch}::DOUBLE)"
    sinc = lambda t: f"CASE WHEN {t} = 0 THEN 1.0 ELSE sin(pi() * {t}) / (pi() * {t}) END"
    weight = f"greatest(0.0, 1.0 - abs({x}))" if kernel == "bilinear" else f"CASE WHEN abs({x}) < 3 THEN ({sinc(x)}) * ({sinc(f'({x} / 3)')}) ELSE 0.0 END"
    return f"{name}_raw AS (SELECT k, i, {weight} AS w FROM (SELECT unnest(range({to})) AS k), (SELECT unnest(range({size})) AS i)), {name} AS (SELECT k, i, w / sum(w) OVER (PARTITION BY k) AS w FROM {name}_raw WHERE w <> 0)"


@query(f"""WITH {PIXELS_SQL}, {_taps_sql("s", 8, 5, "bilinear")}, {_taps_sql("l", 8, 13, "lanczos")},
small AS (SELECT p.vec_id, a.k * 5 + c.k AS i, sum(a.w * c.w * p.v[p.i + 1]) AS v FROM px p JOIN s a ON a.i = p.y JOIN s c ON c.i = p.x GROUP BY ALL), large AS (SELECT p.vec_id, a.k * 13 + c.k AS i, sum(a.w * c.w * p.v[p.i + 1]) AS v FROM px p JOIN l a ON a.i = p.y JOIN l c ON c.i = p.x GROUP BY ALL)
SELECT * FROM (SELECT vec_id, round(sum(v * (i + 1)), 3)::DOUBLE AS small_sum, round(max(v), 4)::DOUBLE AS small_most FROM small GROUP BY 1) JOIN (SELECT vec_id, round(sum(v * (i + 1)), 3)::DOUBLE AS large_sum, round(min(v), 4)::DOUBLE AS large_least FROM large GROUP BY 1) USING (vec_id)""")
def resampled_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster made smaller by a triangle kernel and larger by a windowed sinc."""
    made = rasters(spark, sf_dir).withColumns({"s": filters.resampled(F.col("x"), SIDE, SIDE, 5, 5), "l": filters.resampled(F.col("x"), SIDE, SIDE, 13, 13, "lanczos")})
    weighed = lambda name: r(priors.total(F.transform(name, lambda v, i: v * (i + 1))), 3)
    return made.select("vec_id", weighed("s").alias("small_sum"), r(F.array_max("s")).alias("small_most"), weighed("l").alias("large_sum"), r(F.array_min("l")).alias("large_least"))


@query(f"""WITH {PIXELS_SQL}, {_taps_sql("l", 8, 12, "lanczos")}, big AS (SELECT p.vec_id, a.k AS y, c.k AS x, greatest(0.0, least(255.0, round(sum(a.w * c.w * p.v[p.i + 1]), 3))) AS v FROM px p JOIN l a ON a.i = p.y JOIN l c ON c.i = p.x GROUP BY ALL),
m AS (SELECT vec_id, CASE WHEN sum(v) > 1 THEN sum(y * v) / sum(v) ELSE 6.0 END AS cy, CASE WHEN sum(v) > 1 THEN sum(x * v) / sum(v) ELSE 6.0 END AS cx FROM big GROUP BY 1)
SELECT vec_id, round(cy, 4)::DOUBLE AS cy, round(cx, 4)::DOUBLE AS cx, greatest(0, least(8, round_even(10.0 - cx, 0)))::INT AS "left", greatest(0, least(8, round_even(10.0 - cy, 0)))::INT AS top FROM m""")
def centroid_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster, as an alpha, enlarged and placed by its mass on a canvas of 20."""
    large = F.transform(filters.resampled(F.col("x"), SIDE, SIDE, 12, 12, "lanczos"), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(v, 3))))
    made = rasters(spark, sf_dir).select("vec_id", large.alias("a")).select("vec_id", analysis.centroid(F.col("a"), 12, 12).alias("c"))
    return made.select("vec_id", r("c.cy").alias("cy"), r("c.cx").alias("cx"), analysis.placed(F.col("c"), 12, 12, 20).alias("at")).select("vec_id", "cy", "cx", "at.*")


# ---- pictures

LUMA = "(0.299::DOUBLE * r[{0}] + 0.587::DOUBLE * g[{0}] + 0.114::DOUBLE * b[{0}])"
PICTURES_SQL = f"""v AS (SELECT vec_id, {GREY_SQL} AS x FROM embeddings), q AS (SELECT a.vec_id, a.x AS r, b.x AS g, c.x AS b, d.x AS al FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2 JOIN v d ON d.vec_id = a.vec_id + 3),
lu AS (SELECT *, list_transform(range(64), lambda i: {LUMA.format("i + 1")}) AS l FROM q), p0 AS (SELECT *, unnest(range(64)) AS i FROM lu)"""
_GX, _GY = f"({_near('l', 'i // 8', 'i % 8 + 1')} - {_near('l', 'i // 8', 'i % 8 - 1')})", f"({_near('l', 'i // 8 + 1', 'i % 8')} - {_near('l', 'i // 8 - 1', 'i % 8')})"


def _eroded(name: str, of: str) -> str:
    return f"{name} AS (SELECT s.vec_id, s.y, s.x FROM {of} s JOIN {of} t ON t.vec_id = s.vec_id AND abs(s.y - t.y) + abs(s.x - t.x) <= 1 GROUP BY ALL HAVING count(*) = 5)"


def _grown(name: str, of: str, steps: str = "1") -> str:
    return f"{name} AS (SELECT DISTINCT p.vec_id, p.y, p.x FROM px p JOIN {of} s ON s.vec_id = p.vec_id AND abs(s.y - p.y) + abs(s.x - p.x) <= {steps})"


def _support(name: str, portion: float, margin_y: str, margin_x: str) -> str:
    """The soft mask grown by a portion of its extent, within its box and margins."""
    return f"""{name}_box AS (SELECT vec_id, min(y) AS top, max(y) AS bottom, min(x) AS le, max(x) AS ri, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM px WHERE al >= 40 GROUP BY 1),
{name} AS (SELECT DISTINCT p.vec_id, p.y, p.x FROM px p JOIN {name}_box o USING (vec_id) JOIN px s ON s.vec_id = p.vec_id AND s.al >= 40 AND abs(s.y - p.y) + abs(s.x - p.x) <= least(3, greatest(1, floor({portion} * greatest(h, w) / 3.0)))
WHERE p.y BETWEEN top - {margin_y} AND bottom + {margin_y} AND p.x BETWEEN le - {margin_x} AND ri + {margin_x})"""


def _on(table: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} t WHERE t.vec_id = p.vec_id AND t.y = p.y AND t.x = p.x)"


BACKGROUND_SQL = f"""{PICTURES_SQL}, p1 AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, r[i + 1] AS r, g[i + 1] AS g, b[i + 1] AS b, al[i + 1] AS al, l[i + 1] AS luma, sqrt(({_GX} * 0.5) * ({_GX} * 0.5) + ({_GY} * 0.5) * ({_GY} * 0.5)) AS edge,
sqrt(greatest(0.0, {_window_sql("list_transform(l, lambda v: v * v)", 2)} - ({_window_sql("l", 2)}) * ({_window_sql("l", 2)}))) AS texture FROM p0),
bg AS (SELECT vec_id, median(luma) AS bl, stddev_pop(luma) AS bs, avg(r) AS br, avg(g) AS bgr, avg(b) AS bb FROM p1 WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY 1),
px AS MATERIALIZED (SELECT p1.*, bl, bs, abs(luma - bl) AS dl, sqrt((r - br) * (r - br) + (g - bgr) * (g - bgr) + (b - bb) * (b - bb)) AS dc, r >= 248 AND g >= 248 AND b >= 248 AS white FROM p1 JOIN bg USING (vec_id))"""
PRIOR_SQL = f"""{BACKGROUND_SQL}, s0 AS (SELECT vec_id, y, x FROM px WHERE NOT white AND NOT (dl <= greatest(16.0, bs * 1.8) AND dc <= 26.0) AND (luma <= bl - greatest(22.0, bs * 0.85) OR luma >= bl + greatest(28.0, bs * 1.1) OR dc >= 42.0 OR (edge >= 16.0 AND texture >= 7.0 AND dl >= 14.0))),
{_eroded("s1", "s0")}, {_grown("s2", "s1")}, {_grown("s3", "s2")}, {_eroded("fore", "s3")}, {_labels_sql("k", "fore")},
parts AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, las DESC) AS place, coalesce(sum(n) OVER (PARTITION BY vec_id ORDER BY n DESC, las DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM (SELECT vec_id, root, count(*) AS n, max(y * 8 + x) AS las FROM k_cells GROUP BY ALL)),
chosen AS (SELECT vec_id, root FROM parts WHERE (place <= 3 AND n >= 6 AND held / 64.0 < 0.42) OR place = 1), prior AS (SELECT c.vec_id, c.y, c.x FROM k_cells c JOIN chosen USING (vec_id, root))"""


@query(f"""WITH RECURSIVE {PRIOR_SQL}, {_support("near", 0.12, "floor(0.22 * greatest(h, w))", "floor(0.22 * greatest(h, w))")},
bars AS (SELECT vec_id, count(*) FILTER (WHERE al >= 40) AS soft, greatest(5.5, quantile_cont(edge, 0.50) FILTER (WHERE al >= 40)) AS eb, greatest(4.0, quantile_cont(texture, 0.48) FILTER (WHERE al >= 40)) AS tb FROM px GROUP BY 1),
o AS (SELECT p.*, {_on("prior")} AS pr, CASE WHEN soft < 6 THEN {_on("prior")} ELSE {_on("near")} AND NOT white AND (edge >= eb OR texture >= tb OR al >= 80) END AS mp FROM px p JOIN bars USING (vec_id))
SELECT vec_id, count(*) FILTER (WHERE pr) AS prior_pixels, coalesce(sum(i) FILTER (WHERE pr), 0)::BIGINT AS prior_places, count(*) FILTER (WHERE mp) AS mask_prior_pixels, coalesce(sum(i) FILTER (WHERE mp), 0)::BIGINT AS mask_prior_places, round(any_value(bl), 4)::DOUBLE AS bg_luma, round(any_value(bs), 4)::DOUBLE AS bg_std FROM o GROUP BY 1""")
def product_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the product stands out from the background, and where it is formed near the mask."""
    c = F.col
    made = priors.anchored_prior(priors.raw_prior(priors.background(pictures(spark, sf_dir), SIZE), SIZE), SIZE)
    places = lambda name: priors.total(F.transform(name, lambda v, i: v * i)).cast("long")
    return made.select(
        "vec_id", priors.total(c("prior")).cast("long").alias("prior_pixels"), places("prior").alias("prior_places"), priors.total(c("mask_prior")).cast("long").alias("mask_prior_pixels"),
        places("mask_prior").alias("mask_prior_places"), r("bg_luma").alias("bg_luma"), r("bg_std").alias("bg_std"),
    )


@query(f"""WITH RECURSIVE {PRIOR_SQL}, soft AS (SELECT vec_id, y, x FROM px WHERE al >= 40), {_grown("halo", "soft", "2")}, {_grown("penumbra", "soft")}, {_support("near", 0.14, "floor(0.28 * h)", "floor(0.28 * w)")},
a AS MATERIALIZED (SELECT p.*, al >= 40 AS so, al >= 80 AS sd, {_on("prior")} AS pr, {_on("near")} AS su, al < 80 AND luma <= bl - greatest(8.0, bs * 0.35) AND (({_on("halo")} AND edge < 10 AND texture < 6.5 AND dc < 28 AND NOT white) OR ({_on("penumbra")} AND edge < 8 AND texture < 5 AND dl < 55)) AS sh FROM px p),
u AS (SELECT vec_id, count(*) FILTER (WHERE pr) / 64.0 AS ps, count(*) FILTER (WHERE so) AS ns, count(*) FILTER (WHERE sd) AS nd FROM a GROUP BY 1),
e AS (SELECT vec_id, CASE WHEN count(*) >= 6 THEN greatest(7.0, quantile_cont(edge, 0.52)) ELSE 9.0 END AS eb, CASE WHEN count(*) >= 6 THEN greatest(5.0, quantile_cont(texture, 0.50)) ELSE 7.0 END AS tb FROM a JOIN u USING (vec_id) WHERE CASE WHEN nd > 0 THEN sd ELSE so END GROUP BY 1),
w AS (SELECT a.*, ps, ns, vec_id % 3 <> 0 AND ps <= 0.42 AND ps > 0 AS trusted, edge >= coalesce(eb, 9.0) OR texture >= coalesce(tb, 7.0) OR dc >= 36 AS fo, NOT white AND NOT sh AS clear FROM a JOIN u USING (vec_id) LEFT JOIN e USING (vec_id)),
z AS (SELECT *, CASE WHEN trusted OR ns = 0 THEN pr AND clear ELSE (su AND clear AND NOT (dl <= greatest(14.0, bs * 1.6) AND dc <= 24.0) AND (fo OR (luma <= bl - greatest(18.0, bs * 0.7) AND dc >= 36 AND edge >= 6)) AND (NOT (ps > 0 AND ps < 0.85) OR pr OR so)) OR (sd AND clear) END AS ev FROM w),
s AS (SELECT vec_id, any_value(trusted) AS trusted, any_value(ps) AS ps, count(*) FILTER (WHERE ev) AS n, coalesce(sum(i) FILTER (WHERE ev), 0)::BIGINT AS places, any_value(ns) AS ns, count(*) FILTER (WHERE sh) AS shadow_pixels, count(*) FILTER (WHERE ev AND so) / greatest(1.0, any_value(ns)) AS overlap,
CASE WHEN any_value(trusted) THEN 1.0 WHEN any_value(ns) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE ev AND fo) / greatest(1.0, count(*) FILTER (WHERE ev)) END AS formed FROM z GROUP BY 1)
SELECT vec_id, CASE WHEN trusted THEN 'independent_prior' ELSE 'structured_near_support' END AS evidence_mode, n::INT AS evidence_pixels, places, ns::INT AS soft_pixels, shadow_pixels::BIGINT AS shadow_pixels, round(overlap, 4)::DOUBLE AS overlap, round(formed, 4)::DOUBLE AS formed,
CASE WHEN n * 16 < 120 THEN 'LOW' WHEN vec_id % 3 <> 0 AND trusted AND ps <= 0.42 AND overlap >= 0.35 THEN 'HIGH' WHEN (formed >= 0.55 AND shadow_pixels / 64.0 < 0.08 AND overlap >= 0.40 AND n <= greatest(1, ns) * 2.8) OR (formed >= 0.40 AND overlap >= 0.50 AND n <= greatest(1, ns) * 2.2) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""")
def product_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the product without its contact shadow, and how far it can be trusted; a pixel stands for 4 x 4 of the picture."""
    c, unreliable = F.col, F.col("vec_id") % 3 == 0
    made = priors.contact_shadow(priors.raw_prior(priors.background(pictures(spark, sf_dir), SIZE), SIZE), SIZE)
    told = priors.product_evidence(made, SIZE, unreliable)
    scaled = {"evidence_pixels": c("evidence_pixels") * 16, "soft_pixels": c("soft_pixels") * 16, "prior_frac": c("prior_share")}
    level = gates.evidence_confidence(lambda name: scaled.get(name, c(name)), c("evidence_mode"), unreliable)
    return told.select(
        "vec_id", "evidence_mode", "evidence_pixels", priors.total(F.transform("evidence", lambda v, i: v * i)).cast("long").alias("places"), "soft_pixels",
        priors.total(c("shadow")).cast("long").alias("shadow_pixels"), r("overlap").alias("overlap"), r("structured_evidence_frac").alias("formed"), level.alias("confidence"),
    )


def _slope(high: str, low: str, at: str) -> str:
    return f"(({high} - {low}) / CASE WHEN {at} IN (0, 7) THEN 1.0 ELSE 2.0 END)"


_SX, _SY = _slope(_near("l", "i // 8", "i % 8 + 1"), _near("l", "i // 8", "i % 8 - 1"), "i % 8"), _slope(_near("l", "i // 8 + 1", "i % 8"), _near("l", "i // 8 - 1", "i % 8"), "i // 8")
_ANALYSIS_SQL = ", ".join(f"round({v}, 4)::DOUBLE AS {k}" for k, v in {
    "exposure_score": "ml / 255", "mean_luma": "ml", "std_luma": "sl", "highlight_clip": "hc", "shadow_clip": "sc", "contrast": "least(2.0, sl / 64)", "cast_rg": "rg", "cast_gb": "gb", "cast_rb": "rb", "sharpness": "least(3.0, ms / 40)",
    "noise_level": "mn / 255", "background_brightness": "bm", "background_uniformity": "greatest(0.0, 1 - bd / 40)", "object_size_hint": "n / 64.0", "edge_complexity": "ec", "saturation_mean": "sat",
}.items())


@query(f"""WITH {PICTURES_SQL}, p AS (SELECT vec_id, r[i + 1] AS r, g[i + 1] AS g, b[i + 1] AS b, al[i + 1] AS a, l[i + 1] AS l, sqrt({_SX} * {_SX} + {_SY} * {_SY}) AS s, abs(l[i + 1] - {_window_sql("l", 1)}) AS z FROM p0),
n AS (SELECT *, count(*) FILTER (WHERE a >= 40) OVER w AS n, count(*) FILTER (WHERE a < 20) OVER w AS nb FROM p WINDOW w AS (PARTITION BY vec_id)), k AS (SELECT *, n = 0 OR a >= 40 AS f, nb = 0 OR a < 20 AS h FROM n),
m AS (SELECT vec_id, any_value(n) AS n, avg(l) FILTER (WHERE f) AS ml, stddev_pop(l) FILTER (WHERE f) AS sl, CASE WHEN any_value(n) = 0 THEN 0 ELSE avg((l >= 250)::INT) FILTER (WHERE f) END AS hc, CASE WHEN any_value(n) = 0 THEN 0 ELSE avg((l <= 8)::INT) FILTER (WHERE f) END AS sc,
avg(r) FILTER (WHERE f) - avg(g) FILTER (WHERE f) AS rg, avg(g) FILTER (WHERE f) - avg(b) FILTER (WHERE f) AS gb, avg(r) FILTER (WHERE f) - avg(b) FILTER (WHERE f) AS rb, avg(s) FILTER (WHERE f) AS ms, avg(z) FILTER (WHERE f) AS mn, avg((s > 25)::INT) FILTER (WHERE f) AS ec,
avg(CASE WHEN greatest(r, g, b) > 0.001 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END) FILTER (WHERE f) AS sat, avg(l) FILTER (WHERE h) AS bm, stddev_pop(l) FILTER (WHERE h) AS bd FROM k GROUP BY 1)
SELECT vec_id, {_ANALYSIS_SQL}, CASE WHEN abs(rg) < 6 AND abs(gb) < 6 THEN 'neutral' WHEN rg > 8 AND rb > 8 THEN 'warm' WHEN rb < -8 AND gb < -4 THEN 'cool' WHEN gb > 8 THEN 'green' WHEN rg < -8 THEN 'magenta' ELSE 'neutral' END AS wb_tendency FROM m""")
def image_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light, colour, sharpness, noise and background of each picture."""
    made = analysis.analysed(pictures(spark, sf_dir), SIDE)
    return made.select("vec_id", *("wb_tendency" if k == "wb_tendency" else r(k).alias(k) for k in analysis.MEASURES))


# ---- gates on measured pictures

_SIDES = "(CASE WHEN y = 0 THEN 1 ELSE 0 END + CASE WHEN y = 7 THEN 1 ELSE 0 END + CASE WHEN x = 0 THEN 1 ELSE 0 END + CASE WHEN x = 7 THEN 1 ELSE 0 END)"
_CONFIDENCE = [
    ("ns / 64.0 < 0.01", 0.55, "tiny_foreground"), ("ns / 64.0 > 0.55", 0.35, "full_frame_mask"), ("border > 0.15", 0.18, "border_clipping"), ("pieces >= 8", 0.22, "fragmented"),
    ("pieces BETWEEN 4 AND 7", 0.10, "multi_component"), ("nd > 0 AND 1 - nd / greatest(ns, 1) > 0.45", 0.08, "many_holes"), ("fog / greatest(ns, 1) > 0.55", 0.15, "foggy_alpha"), ("alpha < 95", 0.12, "weak_alpha"),
]


@query(f"""WITH RECURSIVE {PIXELS_SQL}, one AS (SELECT vec_id, y, x, v[i + 1] AS a FROM px), solid AS (SELECT vec_id, y, x FROM one WHERE a >= 128), {_labels_sql("k", "solid")}, c AS (SELECT vec_id, count(*) AS pieces FROM k GROUP BY 1),
m AS (SELECT vec_id, count(*) FILTER (WHERE a >= 40) AS ns, count(*) FILTER (WHERE a >= 128) AS nd, count(*) FILTER (WHERE a >= 40 AND a < 140) AS fog, coalesce(avg(a) FILTER (WHERE a >= 40), 0) AS alpha,
coalesce(sum({_SIDES}) FILTER (WHERE a >= 40), 0) / 32.0 AS border FROM one GROUP BY 1), w AS (SELECT m.*, coalesce(pieces, 0) AS pieces FROM m LEFT JOIN c USING (vec_id))
SELECT vec_id, round(border, 4)::DOUBLE AS border_hit, pieces::INT AS n_components, round(alpha, 4)::DOUBLE AS mean_alpha, round(greatest(0.0, 1.0 - ({" + ".join(f"CASE WHEN {w} THEN {cost}::DOUBLE ELSE 0 END" for w, cost, _ in _CONFIDENCE)})), 4)::DOUBLE AS confidence,
array_to_string(list_filter([{", ".join(f"CASE WHEN {w} THEN '{tag}' END" for w, _, tag in _CONFIDENCE)}], lambda t: t IS NOT NULL), ';') AS warnings FROM w""")
def mask_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each raster can be trusted as a mask, and why not."""
    made = measures.mask_confidence(rasters(spark, sf_dir).withColumnRenamed("x", "alpha"), SIDE)
    return made.select("vec_id", r("border_hit").alias("border_hit"), "n_components", r("mean_alpha_soft").alias("mean_alpha"), r("confidence").alias("confidence"), text.joined(F.col("warnings")).alias("warnings"))


_REACH = "(least(8, {1} + 1 + greatest(1, floor(({1} - {0} + 1) * 0.03))) - greatest(0, {0} - greatest(1, floor(({1} - {0} + 1) * 0.03))))"
_CUT_MEASURES = ("fog_of_fg", "solid_of_fg", "roi_solid_fill", "visibility", "solid_std", "near_white_in_solid", "edge_band_frac", "edge_band_mean_alpha")


@query(f"""WITH {PICTURES_SQL}, p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, r[i + 1] AS r, g[i + 1] AS g, b[i + 1] AS b, al[i + 1] AS a, list_max(list_transform(range(9), lambda k: {_near("al", "i // 8 + k // 3 - 1", "i % 8 + k % 3 - 1")})) >= 160 AS ring FROM p0),
n AS (SELECT vec_id, count(*) FILTER (WHERE a >= 40) AS nf, count(*) FILTER (WHERE a >= 160) AS nd, count(*) FILTER (WHERE a >= 40 AND a < 150) AS fog, {_REACH.format("(min(y) FILTER (WHERE a >= 40))", "(max(y) FILTER (WHERE a >= 40))")} * {_REACH.format("(min(x) FILTER (WHERE a >= 40))", "(max(x) FILTER (WHERE a >= 40))")} AS area,
avg(255 - least(r, g, b)) FILTER (WHERE a >= 160) AS seen, count(*) FILTER (WHERE a >= 160 AND least(r, g, b) >= 245) AS white, count(*) FILTER (WHERE ring AND a >= 40 AND a < 160) AS nb, avg(a) FILTER (WHERE ring AND a >= 40 AND a < 160) AS ba FROM p GROUP BY 1),
t AS (SELECT vec_id, stddev_pop(v) AS spread FROM (SELECT vec_id, unnest([r, g, b]) AS v FROM p WHERE a >= 160) GROUP BY 1),
m AS (SELECT vec_id, vec_id % 3 = 0 AS difficult, nf, nd, CASE WHEN nf > 0 THEN fog / nf ELSE 1 END AS fog_of_fg, nd / greatest(nf, 1) AS solid_of_fg, CASE WHEN nf > 0 THEN nd / area END AS roi_solid_fill, CASE WHEN nd >= 3 THEN seen END AS visibility, CASE WHEN nd >= 3 THEN spread END AS solid_std,
CASE WHEN nd >= 3 THEN white / nd END AS near_white_in_solid, CASE WHEN nd >= 3 AND nf > nd AND nb >= 3 THEN nb / nf END AS edge_band_frac, CASE WHEN nd >= 3 AND nf > nd AND nb >= 3 THEN ba END AS edge_band_mean_alpha FROM n LEFT JOIN t USING (vec_id)),
s AS (SELECT *, {_spoken_sql(_CUTOUT_RULES)} FROM m)
SELECT vec_id, {", ".join(f"round({k}, 4)::DOUBLE AS {k}" for k in _CUT_MEASURES)}, CASE WHEN nf < 6 THEN 'foreground_too_small' WHEN nd < 3 THEN concat_ws(';', nullif(bads, ''), 'foggy_alpha_edges') ELSE bads END AS bads, CASE WHEN nf < 6 THEN '' ELSE warns END AS warns, CASE WHEN nf < 6 THEN '' ELSE posits END AS posits FROM s""")
def cutout_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutout gate on every picture: measured and tagged; a third of them counts as difficult scenes."""
    made = measures.cutout_measures(pictures(spark, sf_dir), SIDE, NEED)
    said = measures.cutout_said(F.col("vec_id") % 3 == 0, NEED)
    return made.select("vec_id", *(r(k).alias(k) for k in _CUT_MEASURES), *(text.joined(v).alias(k) for k, v in said.items()))


_ON_WHITE = "list_transform(range(1, 65), lambda i: floor(({0}[i] * al[i] + (255 - al[i]) * 255) / 255.0::DOUBLE + 0.5))"
_OX, _OY = (e.replace("l[", "lo[") for e in (_GX, _GY))
_KEPT = "prior_kept_frac"
_INTEGRITY_MEASURES = (_KEPT, "prior_wipe_frac", "mid_prior_wipe", "dark_prior_wipe", "texture_ratio", "edge_energy_ratio", "strong_edge_keep", "whiteout_frac", "blown_frac")
_clamp = oracles.clamp


@query(f"""WITH RECURSIVE {PRIOR_SQL}, {_support("near", 0.12, "floor(0.22 * greatest(h, w))", "floor(0.22 * greatest(h, w))")},
bars AS (SELECT vec_id, count(*) FILTER (WHERE al >= 40) AS soft, greatest(5.5, quantile_cont(edge, 0.50) FILTER (WHERE al >= 40)) AS eb, greatest(4.0, quantile_cont(texture, 0.48) FILTER (WHERE al >= 40)) AS tb FROM px GROUP BY 1),
o AS MATERIALIZED (SELECT p.*, {_on("prior")} AS pr, CASE WHEN soft < 6 THEN {_on("prior")} ELSE {_on("near")} AND NOT white AND (edge >= eb OR texture >= tb OR al >= 80) END AS mp FROM px p JOIN bars USING (vec_id)),
w0 AS (SELECT vec_id, {_ON_WHITE.format("r")} AS r, {_ON_WHITE.format("g")} AS g, {_ON_WHITE.format("b")} AS b FROM q), w1 AS (SELECT *, list_transform(range(64), lambda i: {LUMA.format("i + 1")}) AS lo, unnest(range(64)) AS i FROM w0),
fin AS MATERIALIZED (SELECT vec_id, i, lo[i + 1] AS ol, sqrt(({_OX} * 0.5) * ({_OX} * 0.5) + ({_OY} * 0.5) * ({_OY} * 0.5)) AS oe, sqrt(greatest(0.0, {_window_sql("list_transform(lo, lambda v: v * v)", 2)} - ({_window_sql("lo", 2)}) * ({_window_sql("lo", 2)}))) AS ot, least(r[i + 1], g[i + 1], b[i + 1]) >= 248 AS ow FROM w1),
u AS (SELECT vec_id, count(*) FILTER (WHERE pr) / 64.0 > 0.42 AS unsure, count(*) FILTER (WHERE pr) AS np, count(*) FILTER (WHERE mp) AS nm FROM o GROUP BY 1), u2 AS (SELECT *, CASE WHEN unsure THEN nm ELSE np END < 6 AS few FROM u),
e AS (SELECT o.vec_id, al, luma, edge, texture, ol, oe, ot, ow FROM o JOIN u2 USING (vec_id) JOIN fin USING (vec_id, i) WHERE CASE WHEN few THEN al >= 40 WHEN unsure THEN mp ELSE pr END),
z AS (SELECT e.*, bar FROM e JOIN (SELECT vec_id, greatest(6.0, quantile_cont(edge, 0.70)) AS bar FROM e GROUP BY 1) USING (vec_id)),
a AS (SELECT vec_id, count(*) AS n, count(*) FILTER (WHERE al >= 80) AS k, count(*) FILTER (WHERE al < 48) AS gone, count(*) FILTER (WHERE luma BETWEEN 95 AND 220) AS mid, count(*) FILTER (WHERE luma BETWEEN 95 AND 220 AND al < 48) AS mid_gone, count(*) FILTER (WHERE luma < 95) AS dark, count(*) FILTER (WHERE luma < 95 AND al < 48) AS dark_gone,
avg(ot) FILTER (WHERE al >= 80) AS t1, avg(texture) FILTER (WHERE al >= 80) AS t0, avg(oe) FILTER (WHERE al >= 80) AS e1, avg(edge) FILTER (WHERE al >= 80) AS e0, count(*) FILTER (WHERE edge >= bar) AS strong, count(*) FILTER (WHERE edge >= bar AND al >= 80) AS strong_kept, count(*) FILTER (WHERE luma < 245) AS lit,
count(*) FILTER (WHERE luma < 245 AND al >= 40 AND ow AND ot < 3.5) AS whiteout, count(*) FILTER (WHERE luma < 200 AND al >= 80 AND ol >= 245 AND ot < 5) AS blown FROM z GROUP BY 1),
m AS (SELECT vec_id, CASE WHEN few THEN 'alpha_fallback' WHEN unsure THEN 'mask_anchored' ELSE 'independent' END AS prior_mode, coalesce(n, 0) AS n, few AND coalesce(n, 0) < 4 AS small, coalesce(mid, 0) AS mid, coalesce(k, 0) / greatest(1, coalesce(n, 0)) AS {_KEPT}, coalesce(gone, 0) / greatest(1, coalesce(n, 0)) AS prior_wipe_frac,
CASE WHEN mid >= 4 THEN mid_gone / mid ELSE 0 END AS mid_prior_wipe, CASE WHEN dark >= 4 THEN dark_gone / dark ELSE 0 END AS dark_prior_wipe, CASE WHEN k > 0 THEN t1 / greatest(0.001, t0) ELSE 0 END AS texture_ratio, CASE WHEN k > 0 THEN e1 / greatest(0.001, e0) ELSE 0 END AS edge_energy_ratio,
CASE WHEN strong >= 4 THEN strong_kept / strong ELSE coalesce(k, 0) / greatest(1, coalesce(n, 0)) END AS strong_edge_keep, coalesce(whiteout / greatest(1, lit), 0) AS whiteout_frac, coalesce(blown / greatest(1, lit), 0) AS blown_frac FROM u2 LEFT JOIN a USING (vec_id)),
f AS (SELECT *, {_clamp(f"100.0 * {_KEPT} * (1.0 - 0.55 * prior_wipe_frac)")} AS foreground_survival_score, {_clamp(f"100.0 * {_KEPT} - 55.0 * greatest(0.0, prior_wipe_frac - 0.18) - CASE WHEN mid_prior_wipe >= 0.38 AND dark_prior_wipe <= 0.25 AND mid >= 8 THEN 35.0 ELSE 0.0 END")} AS shape,
50.0 * least(1.15, texture_ratio) + 50.0 * least(1.15, edge_energy_ratio) AS raw_detail, {_clamp("CASE WHEN strong_edge_keep < 0.40 THEN least(100.0 * strong_edge_keep, 30.0) ELSE 100.0 * strong_edge_keep END")} AS edges, greatest(whiteout_frac, blown_frac) AS white,
100.0 - 120.0 * greatest(whiteout_frac, 1.2 * blown_frac) AS raw_over FROM m), h AS (SELECT *, {_clamp("CASE WHEN texture_ratio < 0.32 THEN least(raw_detail, 28.0) WHEN texture_ratio < 0.55 THEN least(raw_detail, 55.0) ELSE raw_detail END")} AS detail, {_clamp("CASE WHEN white >= 0.28 THEN least(raw_over, 22.0) ELSE raw_over END")} AS over FROM f),
s AS (SELECT *, {_spoken_sql(_INTEGRITY_RULES)} FROM h)
SELECT vec_id, prior_mode, n::INT AS n_product, {", ".join(f"round({k}, 4)::DOUBLE AS {k}" for k in _INTEGRITY_MEASURES)}, CASE WHEN NOT small THEN round(0.30 * shape + 0.20 * detail + 0.15 * edges + 0.15 * over + 0.20 * least(100.0, foreground_survival_score), 4)::DOUBLE END AS integrity,
CASE WHEN small THEN 'empty_or_tiny_foreground' ELSE bads END AS bads, CASE WHEN small THEN '' ELSE warns END AS warns, CASE WHEN small THEN '' ELSE posits END AS posits FROM s""")
def integrity_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture's cutout laid on white against the raw picture: what is left of the product, scored and tagged.  All wiped pixels count as one lost region."""
    c = F.col
    on_white = lambda name: F.zip_with(name, "alpha", lambda v, a: F.floor((v * a + (255.0 - a) * 255.0) / 255.0 + 0.5).cast("double"))
    shown = pictures(spark, sf_dir).withColumns({f"out_{k}": on_white(k) for k in "rgb"})
    made = measures.integrity_measures(priors.anchored_prior(priors.raw_prior(priors.background(shown, SIZE), SIZE), SIZE), SIDE, NEED)
    made = made.withColumn("foreground_survival_score", spatial.survival_score(c(_KEPT), c("prior_wipe_frac")))
    said = measures.integrity_said(NEED)
    return made.select(
        "vec_id", "prior_mode", "n_product", *(r(k).alias(k) for k in _INTEGRITY_MEASURES), r(said["raw_final_integrity"]).alias("integrity"), *(text.joined(said[k]).alias(k) for k in ("bads", "warns", "posits"))
    )
