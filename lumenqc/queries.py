"""The registered queries: each operator on the given tables, with the same query as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqc import oracles
from lumenqc.functions import neighbourhood, raster, scores, tags, text
from lumenqc.operators import analytics, batch, cases
from lumenqc.plans import decision, extraction, gates, profiles, schemas, spatial
from lumenqc.streaming import resume

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 4) -> Column:
    return F.round(x, digits)


# Fixed values of the stand-in score: symbols and shortness cost points.
SYMBOLS = "[^#*$%&|<>]"


def text_score() -> Column:
    share = F.length(F.regexp_replace("text", SYMBOLS, "")) / F.greatest(F.col("n_chars"), F.lit(1))
    return scores.clamp(96.0 - scores.ramp(share, 0.002, 0.03, 60) - scores.ramp(400.0 - F.col("n_chars"), 0.0, 350.0, 45))


def banded(x: Column, bar: float = 76.0, second: float = 58.0) -> Column:
    return F.when(x >= bar, "pass").when(x >= second, "second_pass").otherwise("review")


SCORE_SQL = """greatest(0.0, least(100.0, 96.0
    - CASE WHEN share <= 0.002 THEN 0.0 WHEN share >= 0.03 THEN 60.0 ELSE 60.0 * (share - 0.002) / 0.028 END
    - CASE WHEN 400.0 - n_chars <= 0 THEN 0.0 WHEN 400.0 - n_chars >= 350 THEN 45.0 ELSE 45.0 * (400.0 - n_chars) / 350.0 END))"""
SCORED_SQL = f"""scored AS (SELECT *, {SCORE_SQL} AS score FROM (SELECT *, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::DOUBLE / greatest(n_chars, 1) AS share FROM documents)),
decided AS (SELECT *, CASE WHEN score >= 76 THEN 'pass' WHEN score >= 58 THEN 'second_pass' ELSE 'review' END AS decision FROM scored)"""


@query(f"""WITH {SCORED_SQL}, j AS (SELECT d.decision = 'pass' AS p, l.quality = 1 AS g FROM decided d JOIN labels l USING (doc_id))
SELECT count(*) FILTER (WHERE g AND p) AS good_pass, count(*) FILTER (WHERE g AND NOT p) AS good_caught, count(*) FILTER (WHERE NOT g AND p) AS bad_pass, count(*) FILTER (WHERE NOT g AND NOT p) AS bad_caught,
round(count(*) FILTER (WHERE g = p) / greatest(count(*), 1)::DOUBLE, 6) AS accuracy FROM j""")
def qc_decision_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = read(spark, sf_dir, "documents").select("doc_id", banded(text_score()).alias("decision")).join(read(spark, sf_dir, "labels"), "doc_id")
    return analytics.confusion(judged, F.col("quality") == 1, F.col("decision") == "pass").withColumn("accuracy", r("accuracy", 6))


@query("""WITH s AS (SELECT l_returnflag, least(100.0, l_quantity * 2) AS a, greatest(0.0, 100.0 - CASE WHEN l_discount <= 0.02 THEN 0.0 WHEN l_discount >= 0.08 THEN 40.0 ELSE 40.0 * (l_discount - 0.02) / 0.06 END) AS b,
greatest(0.0, 100.0 - CASE WHEN l_tax <= 0.01 THEN 0.0 WHEN l_tax >= 0.07 THEN 60.0 ELSE 60.0 * (l_tax - 0.01) / 0.06 END) AS c FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg((0.5 * a + 0.3 * b + 0.4 * c) / 1.2), 4) AS mean_core, round(min((0.5 * a + 0.3 * b + 0.4 * c) / 1.2), 4) AS least_core FROM s GROUP BY 1""")
def qc_weighted_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(scores.clamp(F.col("l_quantity") * 2), 0.5), (scores.clamp(100.0 - scores.ramp(F.col("l_discount"), 0.02, 0.08, 40)), 0.3), (scores.clamp(100.0 - scores.ramp(F.col("l_tax"), 0.01, 0.07, 60)), 0.4)]
    core = read(spark, sf_dir, "lineitem").select("l_returnflag", scores.weighted(parts).alias("core"))
    return core.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("core")).alias("mean_core"), r(F.min("core")).alias("least_core"))


@query("""SELECT l_linestatus, round(avg(coalesce(nullif(l_discount, 0), 0.5)), 6) AS falsy_discount, round(avg(coalesce(l_discount, 0.5)), 6) AS strict_discount,
round(avg(coalesce(nullif(l_tax, 0), -1.0)), 6) AS falsy_tax, round(avg(coalesce(l_tax, -1.0)), 6) AS strict_tax, count(*) FILTER (WHERE l_tax = 0) AS n_zero_tax FROM lineitem GROUP BY 1""")
def falsy_default_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c, d, mode: r(F.avg(scores.given(F.col(c), d, mode)), 6)
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        mean("l_discount", 0.5, "falsy").alias("falsy_discount"), mean("l_discount", 0.5, "strict").alias("strict_discount"),
        mean("l_tax", -1.0, "falsy").alias("falsy_tax"), mean("l_tax", -1.0, "strict").alias("strict_tax"), F.count_if(F.col("l_tax") == 0).alias("n_zero_tax"),
    )


def text_tags() -> dict[str, Column]:
    """Stand-in tags of a text."""
    t = F.col("text")
    return {
        "dirty_background": t.rlike("[#*$%&|<>]"), "foreground_too_small": F.col("n_chars") < 200, "product_faded": t.rlike("!!"), "mask_near_full_frame": F.col("n_chars") > 8000,
        "foreground_fragmented": t.contains("\n"), "low_object_contrast": t.rlike("[0-9]{4}"),
    }


TAGS_SQL = """[CASE WHEN regexp_matches(text, '[#*$%&|<>]') THEN 'dirty_background' END, CASE WHEN n_chars < 200 THEN 'foreground_too_small' END, CASE WHEN contains(text, '!!') THEN 'product_faded' END,
CASE WHEN n_chars > 8000 THEN 'mask_near_full_frame' END, CASE WHEN contains(text, chr(10)) THEN 'foreground_fragmented' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'low_object_contrast' END]"""


@query(f"""WITH t AS (SELECT doc_id, lang, list_filter({TAGS_SQL}, lambda x: x IS NOT NULL) AS bads FROM documents),
w AS (SELECT doc_id, bads, list_filter(['foreground_fragmented', 'lang_' || lang, 'dirty_background'], lambda x: NOT list_contains(bads, x)) AS warns FROM t)
SELECT doc_id, array_to_string(bads, ';') AS bads, array_to_string(warns, ';') AS warns, len(bads)::BIGINT AS n_bads,
array_to_string(list_filter(bads, lambda x: x <> 'foreground_fragmented') || CASE WHEN list_contains(bads, 'product_faded') THEN [] ELSE ['quality_checked'] END, ';') AS moved FROM w""")
def tag_collect_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tags.raised(*((c, name) for name, c in text_tags().items()))
    soft = F.array(F.lit("foreground_fragmented"), F.concat(F.lit("lang_"), "lang"), F.lit("dirty_background"), F.lit("foreground_fragmented"))
    made = read(spark, sf_dir, "documents").select("doc_id", tags.collected(found, found, F.lit(None).cast("array<string>")).alias("bads"), soft.alias("soft"))
    made = made.withColumn("warns", tags.without(F.col("soft"), F.col("bads")))
    moved = tags.added(tags.removed(F.col("bads"), "foreground_fragmented"), "quality_checked", ~tags.has(F.col("bads"), "product_faded"))
    return made.select("doc_id", text.joined(F.col("bads")).alias("bads"), text.joined(F.col("warns")).alias("warns"), F.size("bads").cast("long").alias("n_bads"), text.joined(moved).alias("moved"))


@query("""WITH t AS (SELECT event_type, unnest(['k' || (k % 23)::VARCHAR, 'v' || (floor(value / 50))::BIGINT::VARCHAR]) AS tag FROM (SELECT *, (props->>'k')::BIGINT AS k FROM events)), c AS (SELECT event_type, tag, count(*) AS n FROM t GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, tag) AS rank FROM c) SELECT event_type, tag, n, rank FROM q WHERE rank <= 18""")
def tag_topk_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    both = F.array(F.concat(F.lit("k"), (k % 23).cast("string")), F.concat(F.lit("v"), F.floor(F.col("value") / 50).cast("string")))
    return analytics.tag_counts(read(spark, sf_dir, "events"), "event_type", both, 18).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def score_summary_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.summary(read(spark, sf_dir, "events"), "event_type", "value").withColumns({"mean": r("mean"), "median": r("median")})


RULE_SQL = {
    "dirty_background": "regexp_matches(text, '[#*$%&|<>]')", "foreground_too_small": "n_chars < 200", "product_faded": "contains(text, '!!')", "mask_near_full_frame": "n_chars > 8000",
    "foreground_fragmented": "contains(text, chr(10))", "low_object_contrast": "regexp_matches(text, '[0-9]{4}')",
}
_pairs = [(a, b) for i, a in enumerate(RULE_SQL) for b in list(RULE_SQL)[i:]]


@query("WITH f AS (SELECT " + ", ".join(f"{s} AS {n}" for n, s in RULE_SQL.items()) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{a}' AS rule_a, '{b}' AS rule_b, count(*) FILTER (WHERE {a} AND {b}) AS n FROM f" for a, b in _pairs))
def rule_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.co_occurrence(read(spark, sf_dir, "documents"), text_tags())


@query("""WITH d AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'second_pass' ELSE 'review' END AS old, CASE WHEN o_totalprice / 5000 >= 76 THEN 'pass' WHEN o_totalprice / 5000 >= 58 THEN 'second_pass' ELSE 'review' END AS new FROM orders)
SELECT old, count(*) FILTER (WHERE new = 'pass') AS pass, count(*) FILTER (WHERE new = 'second_pass') AS second_pass, count(*) FILTER (WHERE new = 'review') AS review, count(*) FILTER (WHERE old <> new) AS flips FROM d GROUP BY 1""")
def decision_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "second_pass").otherwise("review")
    rescored = read(spark, sf_dir, "orders").select(old.alias("was"), banded(F.col("o_totalprice") / 5000).alias("now"))
    return analytics.transitions(rescored, "was", "now", ["pass", "second_pass", "review"])


@query("""WITH c AS (SELECT unnest([60, 64, 68, 72, 76, 80]) AS bar, unnest([50, 50, 54, 58, 58, 62]) AS second), s AS (SELECT least(100.0, l_quantity * 1.6 + 100 * l_discount + 200 * l_tax) AS score FROM lineitem)
SELECT bar::BIGINT AS bar, count(*) FILTER (WHERE score >= bar) AS n_pass, count(*) FILTER (WHERE score >= second AND score < bar) AS n_second, count(*) FILTER (WHERE score < second) AS n_review FROM s, c GROUP BY bar""")
def config_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each threshold set would decide, in one pass over the rows: a few counts a set, no row is multiplied."""
    score = F.least(F.lit(100.0), F.col("l_quantity") * 1.6 + 100 * F.col("l_discount") + 200 * F.col("l_tax"))
    sets = list(zip([60, 64, 68, 72, 76, 80], [50, 50, 54, 58, 58, 62], strict=True))
    scored = read(spark, sf_dir, "lineitem").select(score.alias("score"))
    counts = [f(bar, second).alias(f"{n}{bar}") for bar, second in sets for n, f in (("p", lambda b, s: F.count_if(F.col("score") >= b)), ("s", lambda b, s: F.count_if((F.col("score") >= s) & (F.col("score") < b))), ("r", lambda b, s: F.count_if(F.col("score") < s)))]
    rows = F.array(*(F.struct(F.lit(b).cast("long").alias("bar"), F.col(f"p{b}").alias("n_pass"), F.col(f"s{b}").alias("n_second"), F.col(f"r{b}").alias("n_review")) for b, _ in sets))
    return scored.agg(*counts).select(F.explode(rows).alias("x")).select("x.*")


@query("""WITH t AS (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS mean,
count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS remaining FROM events WHERE value > 0)
SELECT event_id, round(mean, 8) AS mean, remaining, round(mean * remaining, 8) AS eta, round(60.0 / mean, 8) AS per_minute FROM t""")
def rolling40_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = batch.rolling_rate(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return rates.select("event_id", r("mean", 8).alias("mean"), F.col("left").alias("remaining"), r("eta", 8).alias("eta"), r("per_minute", 8).alias("per_minute"))


@query("""WITH q AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 4) AS p95, round(median(value), 4) AS median, min(value) AS least, max(value) AS most,
max(value) FILTER (WHERE k = least(n, greatest(1, round(0.95 * (n - 1)) + 1))) AS p95_nearest, max(value) FILTER (WHERE k = greatest(1, floor(0.95 * n))) AS p95_cut FROM q GROUP BY 1""")
def stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.stage_profile(read(spark, sf_dir, "events"), "event_type", "value")
    return found.withColumns({c: r(c) for c in ("mean", "p95", "median")})


@query("""WITH t AS (SELECT event_type AS stage, sum(value) AS seconds FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT stage, round(seconds, 2) AS seconds, round(seconds / n, 4) AS mean, round(100 * (SELECT sum(seconds) FROM t WHERE stage = 'error') / (SELECT sum(seconds) FROM t), 4) AS part_percent FROM t, n""")
def stage_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage seconds as a map by user, then averaged over the users with any."""
    by = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("s")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("timings"))
    return analytics.stage_means(by, "timings", "error").select("stage", r("seconds", 2).alias("seconds"), r("mean").alias("mean"), r("part_percent").alias("part_percent"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS "n_F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "n_O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "n_P",
round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(1, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O'))), 4) AS "percent_F", round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / greatest(1, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O'))), 4) AS "percent_O",
round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / greatest(1, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O'))), 4) AS "percent_P" FROM orders""")
def production_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.production(read(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"], ["F", "O"])
    return found.withColumns({c: r(c) for c in ("percent_F", "percent_O", "percent_P")})


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS at, count(*) AS n, round(avg((value > 12)::INT), 6) AS review_rate, round(avg((value < 2)::INT), 6) AS pass_rate, count(*) >= 8 AND avg((value > 12)::INT) > 0.90 AND avg((value < 2)::INT) < 0.05 AS alarm FROM events GROUP BY 1""")
def anomaly_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.alarms(read(spark, sf_dir, "events"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm"), F.col("value") > 12, F.col("value") < 2)
    return found.withColumns({"review_rate": r("review_rate", 6), "pass_rate": r("pass_rate", 6)})


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < 30) AS n_ok, round(avg(value) FILTER (WHERE value < 30), 4) AS mean_ok, max(value) AS peak, round(count(*) FILTER (WHERE value < 30) / greatest(count(*), 1)::DOUBLE, 6) AS accept_rate FROM events GROUP BY 1""")
def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.engine_summary(read(spark, sf_dir, "events"), "event_type", F.col("value") < 30, "value").withColumns({"mean_ok": r("mean_ok"), "accept_rate": r("accept_rate", 6)})


STEM_SQL = r"regexp_replace(list_last(string_split(replace(url, '\', '/'), '/')), '\.[^.]*$', '')"


@query(f"""WITH s AS (SELECT page_id, url, regexp_replace({STEM_SQL}, '[<>:"/\\\\|?*]', '_', 'g') AS safe FROM pages)
SELECT page_id, (CASE WHEN trim(safe) = '' THEN 'image' ELSE safe END) || '__' || substr(sha256(lower(replace(url, '\\', '/'))), 1, 6) AS id, lower(replace(url, '\\', '/')) AS normal_path,
regexp_replace(substr(sha256(url), 1, 3) || '__' || substr(sha256(url), 4, 8), '__[0-9a-f]{{4,10}}$', '', 'i') AS bare FROM s""")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = batch.with_ids(read(spark, sf_dir, "pages"), "url")
    hashed = F.sha2("url", 256)
    return named.select("page_id", "id", "normal_path", text.without_digest(F.concat(F.substring(hashed, 1, 3), F.lit("__"), F.substring(hashed, 4, 8))).alias("bare"))


@query("""SELECT substr(sha256(encode(n_chars::VARCHAR || ':' || doc_id::VARCHAR || ':' || 'free|' || lang || '|fast|' || source) || from_hex(substr(hex(encode(text)), 1, 131072))), 1, 16) AS fp, doc_id, 'free|' || lang || '|fast|' || source AS tag FROM documents""")
def fingerprint_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = read(spark, sf_dir, "documents").withColumn("tag", text.pipeline_tag("free", F.col("lang"), F.lit("fast"), F.col("source")))
    return tagged.select(text.fingerprint(F.col("n_chars"), F.col("doc_id"), F.col("tag"), F.encode("text", "UTF-8")).alias("fp"), "doc_id", "tag")


NAMED = {"error": "decode failed", "click": "washed out", "view": "empty mask", "purchase": "structure loss"}
BUCKETS = [("decode", "failed"), ("wash", "exposure"), ("mask", "mask"), ("structure", "structure")]


@query("""WITH e AS (SELECT event_id, 'QC: ' || event_type AS raw, event_type AS bare FROM events), n AS (SELECT event_id, CASE bare WHEN 'error' THEN 'decode failed' WHEN 'click' THEN 'washed out' WHEN 'view' THEN 'empty mask' WHEN 'purchase' THEN 'structure loss' ELSE bare END AS reason FROM e),
b AS (SELECT reason, CASE WHEN contains(reason, 'decode') THEN 'failed' WHEN contains(reason, 'wash') THEN 'exposure' WHEN contains(reason, 'mask') THEN 'mask' WHEN contains(reason, 'structure') THEN 'structure' ELSE 'other' END AS bucket FROM n)
SELECT reason, bucket, count(*) AS n FROM b GROUP BY ALL""")
def reason_normalize_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = text.normal_reason(F.concat(F.lit("QC: "), "event_type"), ["qc: ", "review: "], NAMED)
    named = read(spark, sf_dir, "events").select(reason.alias("reason"))
    return named.groupBy("reason", text.first_containing(F.col("reason"), BUCKETS, "other").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


PRIORITY = ["foreground_too_small", "product_faded", "dirty_background", "low_object_contrast"]


@query(f"""WITH t AS (SELECT doc_id, {TAGS_SQL} AS b FROM documents) SELECT doc_id, CASE WHEN list_contains(b, 'foreground_too_small') THEN 'foreground_too_small' WHEN list_contains(b, 'product_faded') THEN 'product_faded'
WHEN list_contains(b, 'dirty_background') THEN 'dirty_background' WHEN list_contains(b, 'low_object_contrast') THEN 'low_object_contrast' ELSE 'quality_uncertain' END AS reason FROM t""")
def primary_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tags.raised(*((c, name) for name, c in text_tags().items()))
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(tags.first_of(PRIORITY, found), F.lit("quality_uncertain")).alias("reason"))


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R' AND l.l_orderkey = o.o_orderkey AND l.l_linenumber = (o.o_orderkey % 3) + 1)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no returned line of the same fingerprint (here a line number) marks as done."""
    items = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 3 + 1).alias("fp"))
    done = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("fp"), (F.col("l_returnflag") == "R").alias("done"))
    return batch.pending(items, done).select("o_orderkey", "o_custkey")


@query("""WITH j AS (SELECT p_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS k FROM part LEFT JOIN lineitem ON l_partkey = p_partkey)
SELECT p_partkey, l_orderkey, l_linenumber, l_suppkey FROM j WHERE k = 1""")
def raw_pairing_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("l_partkey")), read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_extendedprice")
    ranks = [F.col("l_returnflag"), -F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return batch.best_match(left, right, "l_partkey", ranks).select("p_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT c_custkey, min(n_nationkey) AS n_nationkey, count(n_nationkey) AS n_matches FROM customer LEFT JOIN nation ON c_name LIKE '%' || substr(n_name, 8) || '%' GROUP BY 1""")
def like_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theta join: the nations whose number is part of a customer's name.  A fixed list of nations is broadcast; customers stay where they are."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.expr("substr(n_name, 8)").alias("needle"))
    if nations.limit(10_001).count() > 10_000:
        raise ValueError("a theta join with so many patterns would compare every customer with each of them")
    nations = F.broadcast(nations)
    found = read(spark, sf_dir, "customer").join(nations, F.col("c_name").contains(F.col("needle")), "left")
    return found.groupBy("c_custkey").agg(F.min("n_nationkey").alias("n_nationkey"), F.count("n_nationkey").alias("n_matches"))


@query("""WITH u AS (SELECT o_custkey::VARCHAR AS id FROM orders UNION SELECT c_custkey::VARCHAR FROM customer UNION SELECT l_suppkey::VARCHAR FROM lineitem UNION SELECT s_suppkey::VARCHAR FROM supplier UNION SELECT user_id::VARCHAR FROM events) SELECT trim(id) AS id FROM u WHERE trim(id) <> ''""")
def id_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.ids_of(*((read(spark, sf_dir, t), c) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("lineitem", "l_suppkey"), ("supplier", "s_suppkey"), ("events", "user_id"))))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 5 == 0).alias("gate_ok"), (F.col("role") != "system").alias("candidate"), (F.length("text") / 100.0).alias("seconds"))


ATTEMPTS_SQL = "a AS (SELECT conv_id, turn, length(text) % 5 = 0 AS gate_ok, role <> 'system' AS candidate, length(text) / 100.0 AS seconds FROM conversations)"


@query(f"""WITH {ATTEMPTS_SQL} SELECT conv_id, coalesce(min(turn) FILTER (WHERE gate_ok), max(turn) FILTER (WHERE candidate)) AS winner, min(turn) FILTER (WHERE gate_ok) IS NOT NULL AS gate_ok, count(*) AS attempts FROM a GROUP BY 1""")
def ladder_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.winner(attempts(spark, sf_dir), "conv_id", "turn", F.col("gate_ok"), F.col("candidate"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT conv_id, turn, max(gate_ok::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS seen FROM a""")
def seen_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.so_far(attempts(spark, sf_dir), "conv_id", "turn", F.col("gate_ok")).select("conv_id", "turn", "seen")


@query(f"""WITH {ATTEMPTS_SQL}, s AS (SELECT conv_id, min(turn) FILTER (WHERE gate_ok) AS stop FROM a GROUP BY 1) SELECT conv_id, round(sum(seconds), 4)::DOUBLE AS seconds, count(*) AS ran FROM a JOIN s USING (conv_id) WHERE stop IS NULL OR turn <= stop GROUP BY 1""")
def sum_to_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.spent(attempts(spark, sf_dir), "conv_id", "turn", F.col("gate_ok"), F.col("seconds")).withColumn("seconds", r("seconds"))


@query("""SELECT conv_id, turn, round(100.0 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id), 4)::DOUBLE AS percent FROM conversations""")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.progress(read(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", r("percent").alias("percent"))


def grey(x: str = "embedding") -> Column:
    """A vector as an 8 x 8 raster of values from 0 to 255."""
    return F.transform(x, lambda v: scores.clamp(F.bround((v.cast("double") + 0.5) * 255.0, 0), 0.0, 255.0))


GREY_SQL = "list_transform(embedding, lambda v: greatest(0.0, least(255.0, round_even((v::DOUBLE + 0.5) * 255.0, 0))))"


def alpha_measures(x: Column) -> dict[str, Column]:
    inner = F.filter(x, lambda v: v >= 150)
    return {
        "solid": raster.share(x, lambda v: v >= 150), "unsure": raster.share(x, lambda v: (v >= 32) & (v < 150)), "interior": F.when(F.size(inner) > 0, raster.total(inner) / F.size(inner) / 255.0).otherwise(0.0),
        "ghost": F.size(F.filter(x, lambda v: (v >= 8) & (v < 100))) / F.greatest(F.size(inner), F.lit(1)),
    }


MEASURES_SQL = f"""m AS (SELECT vec_id, label, len(list_filter(x, lambda v: v >= 150)) / 64.0 AS solid, len(list_filter(x, lambda v: v >= 32 AND v < 150)) / 64.0 AS unsure,
coalesce(list_sum(list_filter(x, lambda v: v >= 150)) / nullif(len(list_filter(x, lambda v: v >= 150)), 0) / 255.0, 0.0) AS interior, len(list_filter(x, lambda v: v >= 8 AND v < 100)) / greatest(len(list_filter(x, lambda v: v >= 150)), 1)::DOUBLE AS ghost FROM (SELECT vec_id, label, {GREY_SQL} AS x FROM embeddings))"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rasters = read(spark, sf_dir, "embeddings").select("vec_id", "label", grey().alias("x"))
    return rasters.select("vec_id", "label", "x", *(c.alias(n) for n, c in alpha_measures(F.col("x")).items()))


@query(f"WITH {MEASURES_SQL} SELECT vec_id, round(solid, 6)::DOUBLE AS solid, round(unsure, 6)::DOUBLE AS unsure, round(interior, 6) AS interior, round(ghost, 6) AS ghost FROM m")
def raster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("vec_id", *(r(c, 6).alias(c) for c in ("solid", "unsure", "interior", "ghost")))


QUALITY_SQL = """greatest(0.0, 1.0 - (CASE WHEN solid < 0.004 THEN 0.70 ELSE 0 END + CASE WHEN solid < 0.02 THEN 0.25 ELSE 0 END + CASE WHEN solid > 0.88 THEN 0.30 ELSE 0 END + CASE WHEN unsure > 0.14 THEN 0.18 ELSE 0 END
+ CASE WHEN interior < 0.82 THEN 0.16 ELSE 0 END + CASE WHEN ghost > 2.5 THEN 0.22 ELSE 0 END))::DOUBLE"""
GATE_SQL = """CASE WHEN solid < 0.012 OR solid > 0.93 OR (ghost > 3.5 AND interior < 0.55) OR (interior < 0.45 AND unsure > 0.18) THEN 'INVALID'
WHEN unsure > 0.11 OR interior < 0.84 OR solid < 0.028 OR solid > 0.78 OR ghost > 1.8 OR score < 0.62 THEN 'UNCERTAIN' ELSE 'GOOD' END"""


def gated(df: DataFrame) -> DataFrame:
    c, zero = F.col, F.lit(0.0)
    scored = df.withColumn("score", extraction.quality(c("solid"), c("unsure"), c("interior"), zero, c("ghost"), zero))
    return scored.withColumn("gate", extraction.gate(c("solid"), c("unsure"), c("interior"), zero, c("ghost"), c("score")))


@query(f"WITH {MEASURES_SQL}, q AS (SELECT *, {QUALITY_SQL} AS score FROM m) SELECT vec_id, round(score, 6) AS score, {GATE_SQL} AS gate, ({GATE_SQL}) <> 'GOOD' AS rescue, ({GATE_SQL}) = 'INVALID' AS rescue_fast FROM q")
def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(measured(spark, sf_dir)).select("vec_id", r("score", 6).alias("score"), "gate", extraction.needs_rescue(F.col("gate")).alias("rescue"), extraction.needs_rescue(F.col("gate"), "fast").alias("rescue_fast"))


@query(f"""WITH {MEASURES_SQL}, q AS (SELECT *, {QUALITY_SQL} AS score FROM m), g AS (SELECT *, {GATE_SQL} AS gate FROM q),
j AS (SELECT coalesce(p.vec_id, r.vec_id - 1) AS id, p.gate, p.solid AS p, r.solid AS r, p.unsure AS pu, r.unsure AS ru, p.interior AS pi, r.interior AS ri FROM (SELECT * FROM g WHERE vec_id % 2 = 0) p FULL JOIN (SELECT * FROM g WHERE vec_id % 2 = 1 AND solid >= 0.24) r ON p.vec_id = r.vec_id - 1),
w AS (SELECT id, CASE WHEN p IS NULL AND r IS NULL THEN 'no_candidate' WHEN p IS NULL THEN 'primary_missing' WHEN r IS NULL THEN 'rescue_missing' WHEN gate <> 'INVALID' AND r < 0.72 * p AND p >= 0.02 THEN 'rescue_lost_product'
WHEN (gate = 'INVALID' OR p < 0.02) AND r > greatest(0.03, 1.2 * p) THEN 'rescue_recovered_product' WHEN abs(r - p) / greatest(p, r, 0.0001) < 0.18 AND ru + 0.025 < pu AND ri + 0.02 >= pi THEN 'rescue_cleaner_edges'
WHEN abs(r - p) / greatest(p, r, 0.0001) < 0.18 THEN 'primary_comparable_keep' WHEN r > 1.15 * p AND ri >= least(0.75, pi) THEN 'rescue_more_complete' ELSE 'primary_default' END AS why FROM j)
SELECT id, CASE WHEN why IN ('primary_missing', 'rescue_recovered_product', 'rescue_cleaner_edges', 'rescue_more_complete') THEN 'rescue' ELSE 'primary' END AS chosen, why FROM w""")
def candidate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gated(measured(spark, sf_dir)).select("vec_id", "gate", "solid", "unsure", "interior")
    p = g.where("vec_id % 2 = 0").withColumnsRenamed({"vec_id": "id"})
    other = g.where("vec_id % 2 = 1 and solid >= 0.24").select((F.col("vec_id") - 1).alias("id"), F.col("solid").alias("r"), F.col("unsure").alias("ru"), F.col("interior").alias("ri"))
    side, why = extraction.choose(F.col("gate"), F.col("solid"), F.col("r"), F.col("unsure"), F.col("ru"), F.col("interior"), F.col("ri"))
    return p.join(other, "id", "full").select("id", side.alias("chosen"), why.alias("why"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster with that of the next id."""
    one = read(spark, sf_dir, "embeddings").select("vec_id", grey().alias("x"))
    return one.join(one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


NEIGHBOURS_SQL = f"g AS (SELECT vec_id, {GREY_SQL} AS x FROM embeddings), n AS (SELECT a.vec_id, list_zip(a.x, b.x) AS z FROM g a JOIN g b ON b.vec_id = a.vec_id + 1)"


@query(f"""WITH {NEIGHBOURS_SQL} SELECT vec_id, round(len(list_filter(z, lambda p: p[1] >= 128 AND p[2] >= 128)) / greatest(len(list_filter(z, lambda p: p[1] >= 128 OR p[2] >= 128)), 1)::DOUBLE, 6) AS iou FROM n""")
def raster_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("vec_id", r(raster.iou(F.col("x"), F.col("y"), 128.0), 6).alias("iou"))


@query(f"""WITH {NEIGHBOURS_SQL} SELECT vec_id, round(list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) / 64.0, 6) AS mae FROM n""")
def raster_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("vec_id", r(raster.mean_difference(F.col("x"), F.col("y")), 6).alias("mae"))


@query(f"""WITH {NEIGHBOURS_SQL}, c AS (SELECT vec_id, list_transform(range(16), lambda i: list_sum(list_transform(range(4), lambda k: z[((i // 4) * 2 + k // 2) * 8 + (i % 4) * 2 + k % 2 + 1][1])) / 4) AS a, list_transform(range(16), lambda i: list_sum(list_transform(range(4), lambda k: z[((i // 4) * 2 + k // 2) * 8 + (i % 4) * 2 + k % 2 + 1][2])) / 4) AS b FROM n),
l AS (SELECT vec_id, len(list_filter(list_zip(a, b), lambda p: p[1] > 0 AND p[2] < 0.8 * p[1])) AS lost, len(list_filter(a, lambda v: v > 0)) AS evidence FROM c) SELECT vec_id, lost::BIGINT AS lost_cells, round(1.0 - lost / greatest(evidence, 1)::DOUBLE, 6) AS survival FROM l""")
def grid_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = neighbours(spark, sf_dir).select("vec_id", raster.cells(F.col("x"), 8, 2).alias("a"), raster.cells(F.col("y"), 8, 2).alias("b"))
    share, lost = raster.survival(F.col("a"), F.col("b"), 0.8)
    return grids.select("vec_id", lost.cast("long").alias("lost_cells"), r(share, 6).alias("survival"))


def _lab_sql(i: int) -> str:
    lin = [f"CASE WHEN c[{i + k}] / 255 <= 0.04045 THEN c[{i + k}] / 255 / 12.92 ELSE pow((c[{i + k}] / 255 + 0.055) / 1.055, 2.4) END" for k in range(3)]
    rows = [((0.4124564, 0.3575761, 0.1804375), 0.95047), ((0.2126729, 0.7151522, 0.0721750), 1.0), ((0.0193339, 0.1191920, 0.9503041), 1.08883)]
    t = ["(" + " + ".join(f"{m} * ({x})" for m, x in zip(row, lin, strict=True)) + f") / {w}" for row, w in rows]
    f = [f"(CASE WHEN {x} > 0.008856 THEN cbrt({x}) ELSE 7.787 * ({x}) + 16.0 / 116 END)" for x in t]
    return f"[116 * {f[1]} - 16, 500 * ({f[0]} - {f[1]}), 200 * ({f[1]} - {f[2]})]"


@query(f"""WITH g AS (SELECT vec_id, {GREY_SQL} AS c FROM embeddings), l AS (SELECT vec_id, {_lab_sql(1)} AS a, {_lab_sql(4)} AS b FROM g)
SELECT vec_id, round(a[1], 3) AS lightness, round(sqrt(pow(a[1] - b[1], 2) + pow(a[2] - b[2], 2) + pow(a[3] - b[3], 2)), 3) AS delta_e FROM l""")
def lab_delta_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    colors = read(spark, sf_dir, "embeddings").select("vec_id", grey().alias("c"))
    a, b = (scores.lab(*(F.get("c", F.lit(i + k)) for k in range(3))) for i in (0, 3))
    return colors.select("vec_id", r(a[0], 3).alias("lightness"), r(scores.delta_e(a, b), 3).alias("delta_e"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, greatest(1, floor(count(*) OVER (PARTITION BY p_brand) / 7.0)) AS step FROM part) SELECT p_partkey, p_brand FROM k WHERE place % step = 0 AND place / step < 7""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.every_kth(read(spark, sf_dir, "part"), "p_brand", ["p_partkey"], 7).select("p_partkey", "p_brand")


@query("""WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(q) OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
sum(q) OVER (PARTITION BY l_suppkey) AS whole FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey)) SELECT l_suppkey, l_partkey, q, rank FROM k WHERE rank <= 60 AND before < 0.1 * whole""")
def running_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return batch.largest_until(sizes, "l_suppkey", "q", "l_partkey", 0.1, 60).select("l_suppkey", "l_partkey", "q", F.col("rank").cast("long").alias("rank"))


@query("""WITH old AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1), new AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'view' AND user_id NOT IN (SELECT user_id FROM old) GROUP BY 1)
SELECT user_id, event_id FROM old UNION ALL SELECT user_id, event_id FROM new""")
def manifest_insert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    old = events.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    new = events.where("event_type <> 'view'")
    return batch.insert_once(new.select("user_id", "event_id", "ts"), old.withColumn("ts", F.lit(None).cast(new.schema["ts"].dataType)), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def qc_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.upsert(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH s AS (SELECT user_id, floor(sum(value))::BIGINT AS s FROM events GROUP BY 1) SELECT user_id, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{}:{:02d}', s // 60, s % 60) END AS spent FROM s""")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = batch.whole_sums(read(spark, sf_dir, "events"), "user_id", "value", ["event_id"])
    return spent.select("user_id", scores.duration(F.col("whole").cast("double")).alias("spent"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_quantity / 50 <= 0.2 THEN 0 WHEN l_quantity / 50 >= 0.78 THEN 1 ELSE pow((l_quantity / 50 - 0.2) / 0.58, 2) * (3 - 2 * (l_quantity / 50 - 0.2) / 0.58) END, 6)::DOUBLE AS smooth,
CASE WHEN floor(l_discount * 12) / 1.2 <= 0 THEN 255.0 ELSE round_even(l_quantity * 5 * (floor(l_discount * 12) / 1.2) + 255 * (1 - floor(l_discount * 12) / 1.2), 0) END AS white,
round(CASE WHEN l_discount * 10 > 0.05 AND l_discount * 10 < 0.95 THEN greatest(0.0, least(255.0, (l_quantity * 5 - (1 - l_discount * 10) * 255.0) / (l_discount * 10))) ELSE l_quantity * 5 END, 4) AS unmixed, round(0.299 * l_quantity + 0.587 * l_discount * 100 + 0.114 * l_tax * 100, 4) AS luma, round((greatest(l_quantity, l_discount * 100, l_tax * 100) - least(l_quantity, l_discount * 100, l_tax * 100)) / greatest(l_quantity, l_discount * 100, l_tax * 100), 6) AS saturation,
round(greatest(l_quantity, l_discount * 100, l_tax * 100) - least(l_quantity, l_discount * 100, l_tax * 100), 4) AS chroma, round(l_extendedprice / greatest(l_tax * 100, 1), 6) AS ratio FROM lineitem""")
def pixel_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    white = scores.over_white(q * 5, F.floor(d * 12) / 1.2)
    own = scores.unmixed(q * 5, F.lit(255.0), d * 10)
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(scores.smoothstep(q / 50), 6).alias("smooth"), white.alias("white"), r(own).alias("unmixed"), r(scores.saturation(q, d * 100, t * 100), 6).alias("saturation"),
        r(scores.luma(q, d * 100, t * 100)).alias("luma"), r(scores.chroma(q, d * 100, t * 100)).alias("chroma"), r(scores.ratio(F.col("l_extendedprice"), t * 100), 6).alias("ratio"),
    )


def items_of_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision items measured on the rasters: each vector is a product's alpha, its successor the finished picture."""
    both = neighbours(spark, sf_dir).select("vec_id", "x", "y", *(c.alias(n) for n, c in alpha_measures(F.col("x")).items()))
    kept = raster.iou(F.col("x"), F.col("y"), 128.0)
    gap = raster.mean_difference(F.col("x"), F.col("y"))
    values = {
        "mask": {"soft_coverage": F.col("solid"), "solid_of_soft": F.col("solid") / F.greatest(F.lit(0.01), F.col("solid") + F.col("unsure")), "fog_ratio": F.col("unsure"), "mean_alpha_soft": 255 * F.col("interior"), "roi_fill": F.col("solid") + 0.1, "main_component_frac": F.lit(0.9), "bads": tags.raised((F.col("solid") < 0.05, "empty_mask"))},
        "cutout": {"fog_of_fg": F.col("unsure"), "visibility": gap, "solid_std": gap, "warns": tags.raised((F.col("unsure") > 0.8, "foggy_alpha_edges"))},
        "studio": {"product_mean": 255 * F.col("interior"), "light_grey_frac": F.col("solid"), "bg_dirty_frac": F.col("ghost") / 1000, "posits": tags.raised((F.col("solid") > 0.3, "dark_on_white"))},
        "structure": {"structure_loss": 0.3 * (1 - kept), "edge_drop": 0.2 * (1 - kept), "posits": tags.raised((kept > 0.3, "structure_preserved"))},
        "raw_final": {"structure_preservation_score": 60 + 40 * kept, "detail_retention_score": 65 + 40 * kept, "raw_final_edge_consistency_score": 70 + 30 * kept, "foreground_overexposure_score": 100 - gap / 3, "spatial_evidence_confidence": F.lit("MEDIUM"), "bads": tags.raised((kept < 0.02, "product_structure_destroyed"))},
    }

    def block(name: str) -> Column:
        return F.struct(*(F.coalesce(values[name].get(f.name, F.lit(None)).cast(f.dataType), F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.block(name)))

    return both.select(F.col("vec_id").cast("string").alias("filename"), (F.col("vec_id") % 2 == 0).alias("after_rescue"), *(block(n).alias(n) for n in schemas.MEASURES))


def _block_sql(name: str, values: dict[str, str]) -> str:
    """A struct of a block's fields, null where no value is given."""
    kinds = {"double": "DOUBLE", "string": "VARCHAR", "array<string>": "VARCHAR[]"}
    return "{" + ", ".join(f"'{f.name}': ({values.get(f.name, 'NULL')})::{kinds[f.dataType.simpleString()]}" for f in schemas.block(name)) + "}"


_ITEM_VALUES = {
    "mask": {"soft_coverage": "solid", "solid_of_soft": "solid / greatest(0.01, solid + unsure)", "fog_ratio": "unsure", "mean_alpha_soft": "255 * interior", "roi_fill": "solid + 0.1", "main_component_frac": "0.9", "bads": oracles.raised(("solid < 0.05", "empty_mask"))},
    "cutout": {"fog_of_fg": "unsure", "visibility": "gap", "solid_std": "gap", "warns": oracles.raised(("unsure > 0.8", "foggy_alpha_edges"))},
    "studio": {"product_mean": "255 * interior", "light_grey_frac": "solid", "bg_dirty_frac": "ghost / 1000", "posits": oracles.raised(("solid > 0.3", "dark_on_white"))},
    "structure": {"structure_loss": "0.3 * (1 - kept)", "edge_drop": "0.2 * (1 - kept)", "posits": oracles.raised(("kept > 0.3", "structure_preserved"))},
    "raw_final": {
        "structure_preservation_score": "60 + 40 * kept", "detail_retention_score": "65 + 40 * kept", "raw_final_edge_consistency_score": "70 + 30 * kept", "foreground_overexposure_score": "100 - gap / 3",
        "spatial_evidence_confidence": "'MEDIUM'", "bads": oracles.raised(("kept < 0.02", "product_structure_destroyed")),
    },
}
ENGINE_SQL = f"""{MEASURES_SQL}, {NEIGHBOURS_SQL}, both_sides AS (SELECT m.*, len(list_filter(z, lambda p: p[1] >= 128 AND p[2] >= 128)) / greatest(len(list_filter(z, lambda p: p[1] >= 128 OR p[2] >= 128)), 1)::DOUBLE AS kept,
list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) / 64.0 AS gap FROM n JOIN m USING (vec_id)),
items AS (SELECT vec_id::VARCHAR AS filename, vec_id % 2 = 0 AS after_rescue, {", ".join(f"{_block_sql(b, v)} AS {b}" for b, v in _ITEM_VALUES.items())} FROM both_sides),
{oracles.engine_sql("items")}"""


@query(f"""WITH {ENGINE_SQL} SELECT filename, decision, zone, round(final_score, 1) AS final_score, round(core_score, 1) AS core_score, round(aesthetic_score, 1) AS aesthetic_score, processing_profile, reason, array_to_string(triggered_rules, ';') AS triggered,
CASE WHEN decision = 'pass' THEN '' ELSE array_to_string({oracles.distinct("(bads || triggered_rules)")}, ';') END AS explained FROM reports""")
def decision_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine on every raster."""
    found = decision.decide(items_of_rasters(spark, sf_dir))
    return found.select("filename", "decision", "zone", *(r(f"{k}_score", 1).alias(f"{k}_score") for k in ("final", "core", "aesthetic")), "processing_profile", "reason", text.joined(F.col("triggered_rules")).alias("triggered"), text.joined(decision.explained(F.col("bads"), F.col("triggered_rules"), F.col("decision"))).alias("explained"))


@query(f"""WITH {ENGINE_SQL}, t AS (SELECT decision, unnest(triggered_rules) AS tag FROM reports), c AS (SELECT decision, tag, count(*) AS n FROM t GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY decision ORDER BY n DESC, tag) AS rank FROM c""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and their tags, counted."""
    found = decision.decide(items_of_rasters(spark, sf_dir))
    return analytics.tag_counts(found, "decision", F.col("triggered_rules")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH g AS (SELECT vec_id, {GREY_SQL} AS x FROM embeddings), p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS v FROM g)),
d AS (SELECT vec_id, y, x, v, 0.5 * (lead(v, 1, v) OVER r - lag(v, 1, v) OVER r) AS gx, 0.5 * (lead(v, 1, v) OVER c - lag(v, 1, v) OVER c) AS gy FROM p WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, round(avg(sqrt(gx * gx + gy * gy)), 4) AS mean_edge, round(max(sqrt(gx * gx + gy * gy)), 4) AS most_edge FROM d GROUP BY 1""")
def raster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "embeddings").select("vec_id", neighbourhood.gradient(grey(), 8).alias("g"))
    return edges.select("vec_id", r(raster.total(F.col("g")) / 64).alias("mean_edge"), r(F.array_max("g")).alias("most_edge"))


@query(f"""WITH g AS (SELECT vec_id, list_transform({GREY_SQL}, lambda v: CASE WHEN v >= 128 THEN 1 ELSE 0 END) AS m FROM embeddings), p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(m) AS v FROM g)),
d AS (SELECT *, greatest(v, lead(v, 1, 0) OVER r, lag(v, 1, 0) OVER r, lead(v, 1, 0) OVER c, lag(v, 1, 0) OVER c) AS big, least(v, lead(v, 1, 0) OVER r, lag(v, 1, 0) OVER r, lead(v, 1, 0) OVER c, lag(v, 1, 0) OVER c) AS small FROM p WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, sum(v)::BIGINT AS area, sum(big)::BIGINT AS dilated, sum(small)::BIGINT AS eroded, round(sum(CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN v ELSE 0 END) / 28.0, 6)::DOUBLE AS border, min(y) FILTER (WHERE v = 1)::INT AS top, max(x) FILTER (WHERE v = 1)::INT AS right_most FROM d GROUP BY 1""")
def raster_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = read(spark, sf_dir, "embeddings").select("vec_id", grey().alias("g")).select("vec_id", F.transform("g", lambda v: F.when(v >= 128, 1.0).otherwise(0.0)).alias("m"))
    area = lambda m: raster.total(m).cast("long")
    n, m = neighbourhood, F.col("m")
    return masks.select("vec_id", area(m).alias("area"), area(n.dilated(m, 8)).alias("dilated"), area(n.eroded(m, 8)).alias("eroded"), r(n.border_share(m, 8), 6).alias("border"), n.box(m, 8).alias("b")).select("vec_id", "area", "dilated", "eroded", "border", F.col("b.top").alias("top"), F.col("b.right").alias("right_most"))


def _labels_sql(name: str, cells: str) -> str:
    """Table ``name`` (vec_id, root, n): components, by 4 neighbours, of the cells (vec_id, y, x) of table ``cells``."""
    return f"""{name}_reach AS (SELECT vec_id, y, x, y * 100 + x AS root FROM {cells} UNION SELECT c.vec_id, c.y, c.x, r.root FROM {name}_reach r JOIN {cells} c ON c.vec_id = r.vec_id AND abs(c.y - r.y) + abs(c.x - r.x) = 1),
{name}_cells AS (SELECT vec_id, y, x, min(root) AS root FROM {name}_reach GROUP BY ALL), {name} AS (SELECT vec_id, root, count(*) AS n FROM {name}_cells GROUP BY ALL)"""


def _mask_sql(bar: int) -> str:
    """Components ``k`` of the mask of values from ``bar`` on, and ``h``: its holes' pixels, background that doesn't reach the frame around the raster."""
    return f"""px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest({GREY_SQL}) AS v FROM embeddings)),
fore AS (SELECT vec_id, y, x FROM px WHERE v >= {bar}), back AS (SELECT vec_id, y, x FROM px WHERE v < {bar} UNION ALL SELECT vec_id, f // 10 - 1 AS y, f % 10 - 1 AS x FROM (SELECT vec_id, unnest(range(100)) AS f FROM embeddings) WHERE f // 10 IN (0, 9) OR f % 10 IN (0, 9)),
{_labels_sql("k", "fore")}, {_labels_sql("b", "back")}, h AS (SELECT vec_id, coalesce(sum(n) FILTER (WHERE root <> -101), 0) AS holes FROM b GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_mask_sql(150)}, s AS (SELECT vec_id, count(*) AS n, max(n) AS largest FROM k GROUP BY 1)
SELECT vec_id, coalesce(s.n, 0)::INT AS n_components, coalesce(largest, 0)::INT AS largest, holes::BIGINT AS hole_pixels FROM h LEFT JOIN s USING (vec_id)""")
def raster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each mask and its holes."""
    masks = read(spark, sf_dir, "embeddings").select("vec_id", grey().alias("g")).select("vec_id", F.transform("g", lambda v: F.when(v >= 150, 1.0).otherwise(0.0)).alias("m"))
    found = masks.select("vec_id", "m", neighbourhood.sizes(neighbourhood.components(F.col("m"), 8)).alias("sizes"), neighbourhood.filled(F.col("m"), 8).alias("full"))
    return found.select("vec_id", F.size("sizes").alias("n_components"), F.coalesce(F.get("sizes", F.lit(0)), F.lit(0)).alias("largest"), (raster.total(F.col("full")) - raster.total(F.col("m"))).cast("long").alias("hole_pixels"))


@query(f"""WITH g AS (SELECT label, vec_id, {GREY_SQL} AS x FROM embeddings), p AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(x) AS v FROM g), c AS (SELECT label, v, v - (i % 3) * 8 AS w FROM p),
l AS (SELECT label, 0.299 * v + 0.587 * v + 0.114 * w AS luma, greatest(v, w) - least(v, w) AS chroma FROM c), s AS (SELECT label, avg(luma) AS mean, stddev_pop(luma) AS std, quantile_cont(luma, 0.95) AS p95, quantile_cont(luma, 0.05) AS p5, avg((luma >= 230)::INT) AS high, avg((chroma < 18)::INT) AS low FROM l GROUP BY 1)
SELECT label, round(mean, 3) AS mean_luma, round(std, 3) AS std_luma, round(p95, 3) AS p95, round(p5, 3) AS p5, round(high, 6) AS highlights, round(low, 6) AS low_chroma, (mean >= 155 AND std <= 52) OR (p95 >= 242 AND mean >= 140) OR (high >= 0.12 AND std >= 35) OR (low >= 0.55 AND mean >= 150)
OR (p95 - p5 < 55 AND mean >= 140) OR (low >= 0.85 AND mean BETWEEN 90 AND 175) OR (std <= 48 AND mean >= 110 AND low >= 0.70) AS difficult FROM s""")
def scene_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes: all rasters of a label as one picture, the third channel shifted a little."""
    each = read(spark, sf_dir, "embeddings").select("label", F.posexplode(grey()).alias("i", "v")).select("label", "v", (F.col("v") - F.col("i") % 3 * 8).alias("w"))
    v, w = F.col("v"), F.col("w")
    found = profiles.scene(each, "label", scores.luma(v, v, w), scores.chroma(v, v, w))
    return found.select("label", *(r(c, 3).alias(c) for c in ("mean_luma", "std_luma", "p95", "p5")), *(r(c, 6).alias(c) for c in ("highlights", "low_chroma")), "difficult")


@query(f"""WITH {MEASURES_SQL}, t AS (SELECT vec_id, list_filter([CASE WHEN 255 * interior <= 85 THEN 'dark_object' END, CASE WHEN 255 * interior >= 175 THEN 'white_object' END, CASE WHEN ghost > 2 THEN 'reflective' END, CASE WHEN unsure >= 0.72 THEN 'mesh' END, CASE WHEN unsure >= 0.64 THEN 'thin_complex_edges' END], lambda x: x IS NOT NULL) AS tags FROM m)
SELECT vec_id, CASE WHEN len(tags) = 0 THEN 'normal' ELSE array_to_string(tags, ';') END AS tags, CASE WHEN list_contains(tags, 'mesh') THEN 'mesh' WHEN list_contains(tags, 'white_object') THEN 'white_object' WHEN list_contains(tags, 'dark_object') THEN 'dark_object'
WHEN list_contains(tags, 'reflective') THEN 'reflective' WHEN list_contains(tags, 'thin_complex_edges') THEN 'thin_complex_edges' ELSE 'normal' END AS profile, CASE WHEN list_contains(tags, 'mesh') THEN 0.82 WHEN list_contains(tags, 'dark_object') THEN 0.86 ELSE 0.85 END::DOUBLE AS product_fill FROM t""")
def product_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    no, c = F.lit(False), F.col
    found = profiles.profile_tags(255 * c("interior"), F.lit(0.5), F.lit(0.0), F.lit(0.0), c("unsure") / 4, F.lit(1.0), F.lit(1.0), F.lit(0.0), no, c("ghost") > 2, no, no)
    tagged = measured(spark, sf_dir).select("vec_id", found.alias("tags"))
    return tagged.select("vec_id", text.joined(c("tags")).alias("tags"), profiles.primary(c("tags")).alias("profile"), profiles.handling(c("tags"))["product_fill"].alias("product_fill"))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 2) AS seconds FROM events GROUP BY 1""")
def stream_resume_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into a table, twice over: the restart adds nothing, so the table equals the batch."""
    out, state, again = (resume.shared_path(spark, n) for n in ("stream-out", "stream-state", "stream-again"))
    source = read(spark, sf_dir, "events")
    for at in (state, state, again):  # first run, restart from its checkpoint, and a new run over the same rows
        stream = resume.arriving(spark, sf_dir, source.schema, "events*.parquet")
        resume.run_once(stream, lambda rows: rows.select("event_id", "event_type", "value"), out, at, "event_id")
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("seconds"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 5 AS loss, l_tax * 5 AS edge, l_quantity / 100 AS texture, l_discount * 6 AS middle, l_tax * 3 AS dark FROM lineitem),
t AS (SELECT *, CASE WHEN loss >= 0.38 OR (edge >= 0.45 AND texture >= 0.28) OR (middle >= 0.40 AND dark <= 0.22 AND loss >= 0.24) THEN 'bad' WHEN loss >= 0.24 OR edge >= 0.28 THEN 'warn' WHEN texture >= 0.42 THEN 'bad' WHEN texture >= 0.28 THEN 'warn' ELSE 'none' END AS verdict,
loss <= 0.12 AND edge <= 0.15 AS kept FROM s) SELECT verdict, kept, count(*) AS n FROM t GROUP BY ALL""")
def structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure gate on every line; measurements that the table lacks are zero."""
    stand_in = {"structure_loss": F.col("l_discount") * 5, "edge_drop": F.col("l_tax") * 5, "texture_loss": F.col("l_quantity") / 100, "midtone_loss": F.col("l_discount") * 6, "dark_loss": F.col("l_tax") * 3}
    made = gates.structure(lambda name: stand_in.get(name, F.lit(0.0)))
    said = read(spark, sf_dir, "lineitem").select(*(v.alias(k) for k, v in made.items()))
    verdict = F.when(F.size("bads") > 0, "bad").when(F.size("warns") > 0, "warn").otherwise("none")
    return said.groupBy(verdict.alias("verdict"), tags.has(F.col("posits"), "structure_preserved").alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def _spoken_sql(groups: list[list[tuple[str, str, str]]]) -> str:
    """bads, warns and posits, joined: of a group the first rule that holds speaks."""
    said = ", ".join("CASE " + " ".join(f"WHEN {w} THEN '{kind}:{tag}'" for w, kind, tag in group) + " END" for group in groups)
    return ", ".join(f"array_to_string(list_transform(list_filter([{said}], lambda x: starts_with(x, '{kind}:')), lambda x: x[{len(kind) + 2}:]), ';') AS {name}" for name, kind in (("bads", "bad"), ("warns", "warn"), ("posits", "good")))


_FRAG = "foreground_fragmented"
_SPRAY, _EXTREME, _SEVERAL = "(pieces >= 5 AND main < 0.40 AND tiny >= 12)", "(every >= 25 AND pieces <= 3 AND tiny >= 15)", "(pieces BETWEEN 2 AND 12 AND tiny <= greatest(8, pieces * 2) AND main >= 0.08)"
_FINE = f"({_SEVERAL} AND NOT {_SPRAY} AND NOT {_EXTREME})"
_MASK_RULES = [
    [("soft < 0.008", "bad", "weak_mask_small_area")], [("strong < 0.004", "bad", "weak_mask_low_opacity")], [("soft > 0.55", "bad", "mask_near_full_frame"), ("soft > 0.45", "warn", "mask_near_full_frame")],
    [("soft > 0.42 AND fill > 0.72", "warn", "mask_near_full_frame")], [("fill < 0.08 AND soft < 0.015", "bad", _FRAG), ("fill < 0.22", "warn", _FRAG)],
    [("1 - solid >= 0.65 AND solid < 0.35", "bad", "foggy_soft_mask"), ("1 - solid >= 0.50 AND solid < 0.42", "warn", "foggy_soft_mask")], [("solid < 0.18", "bad", "weak_mask_low_opacity"), ("solid < 0.30", "warn", "weak_mask_low_opacity")],
    [("alpha < 75", "bad", "weak_mask_mean_alpha"), ("alpha < 100", "warn", "weak_mask_mean_alpha")], [("aspect > 16 AND soft < 0.06", "bad", "bbox_implausibly_thin")], [(_FINE, "good", "multi_object_ok")],
    [(f"{_FINE} AND pieces >= 6 AND main < 0.25", "warn", _FRAG), (_FINE, "-", ""), (f"{_SPRAY} OR {_EXTREME} OR (pieces >= 5 AND main < 0.22 AND tiny >= 14)", "bad", _FRAG), ("(pieces >= 3 AND main < 0.30 AND tiny >= 8) OR (pieces >= 4 AND main < 0.28)", "warn", _FRAG)],
    [(f"(main >= 0.85 AND pieces <= 2) OR {_SEVERAL}", "good", "strong_main_component")],
    [("hole_frac BETWEEN 0.05 AND 0.55 AND holes >= 200 AND solid >= 0.45", "good", "legitimate_holes"), ("hole_frac >= 0.22 AND holes >= 25000 AND solid < 0.40", "bad", _FRAG), ("hole_frac >= 0.45 AND holes >= 12000 AND solid < 0.45", "warn", _FRAG)],
    [("solid >= 0.70 AND alpha >= 160", "good", "opaque_core")], [("soft BETWEEN 0.04 AND 0.45 AND solid >= 0.65", "good", "plausible_coverage")],
]


@query(f"""WITH RECURSIVE {_mask_sql(150)}, f AS (SELECT vec_id, count(*) FILTER (WHERE v >= 32) AS n_soft, count(*) FILTER (WHERE v >= 150) AS n_solid, coalesce(avg(v) FILTER (WHERE v >= 32), 0) AS alpha,
max(y) FILTER (WHERE v >= 32) - min(y) FILTER (WHERE v >= 32) + 1 AS height, max(x) FILTER (WHERE v >= 32) - min(x) FILTER (WHERE v >= 32) + 1 AS width FROM px GROUP BY 1),
c AS (SELECT vec_id, count(*) AS every, max(n) AS largest, count(*) FILTER (WHERE n >= 0.12 * n_solid) AS pieces, count(*) FILTER (WHERE n < 0.02 * n_solid) AS tiny FROM k JOIN f USING (vec_id) GROUP BY 1),
w AS (SELECT vec_id, n_soft / 64.0 AS soft, n_solid / 64.0 AS strong, n_solid / greatest(n_soft, 1)::DOUBLE AS solid, coalesce(n_soft / (height * width)::DOUBLE, 0.0) AS fill, alpha, coalesce(greatest(height, width) / least(height, width)::DOUBLE, 1.0) AS aspect,
coalesce(largest, 0) / greatest(n_solid, 1)::DOUBLE AS main, coalesce(pieces, 0) AS pieces, coalesce(tiny, 0) AS tiny, coalesce(every, 0) AS every, holes, holes / greatest(holes + n_solid, 1)::DOUBLE AS hole_frac FROM f JOIN h USING (vec_id) LEFT JOIN c USING (vec_id)),
t AS (SELECT vec_id, soft, fill, hole_frac, {_spoken_sql(_MASK_RULES)} FROM w)
SELECT vec_id, round(fill, 6) AS roi_fill, round(hole_frac, 6) AS hole_frac, CASE WHEN soft <= 0 THEN 'empty_mask' ELSE bads END AS bads, CASE WHEN soft <= 0 THEN '' ELSE warns END AS warns, CASE WHEN soft <= 0 THEN '' ELSE posits END AS posits FROM t""")
def mask_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask gate on every raster: measured, tagged, without a shuffle."""
    n, x = neighbourhood, F.col("x")
    over = lambda raster_, bar: F.transform(raster_, lambda v: F.when(v >= bar, 1.0).otherwise(0.0))
    base = read(spark, sf_dir, "embeddings").select("vec_id", grey().alias("x"))
    masks = base.select("vec_id", "x", over("x", 32).alias("soft"), over("x", 150).alias("solid"))
    found = masks.select("vec_id", "x", "soft", "solid", n.box(F.col("soft"), 8).alias("b"), n.sizes(n.components(F.col("solid"), 8)).alias("sizes"), raster.total(n.filled(F.col("solid"), 8)).alias("full"), raster.total(F.col("soft")).alias("n_soft"), raster.total(F.col("solid")).alias("n_solid"))
    height, width = F.col("b.bottom") - F.col("b.top") + 1, F.col("b.right") - F.col("b.left") + 1
    one, largest = F.lit(1.0), F.coalesce(F.get("sizes", F.lit(0)), F.lit(0))
    stats = {
        "soft_coverage": F.col("n_soft") / 64, "strong_coverage": F.col("n_solid") / 64, "solid_of_soft": F.col("n_solid") / F.greatest(F.col("n_soft"), one), "roi_fill": F.coalesce(F.col("n_soft") / (height * width), F.lit(0.0)),
        "fog_ratio": 1.0 - F.col("n_solid") / F.greatest(F.col("n_soft"), one), "mean_alpha_soft": raster.mean_where(x, lambda v: v >= 32), "bbox_aspect": F.coalesce(F.greatest(height, width) / F.least(height, width), one).cast("double"),
        "main_component_frac": largest / F.greatest(F.col("n_solid"), one), "n_significant_components": F.size(F.filter("sizes", lambda s: s >= 0.12 * F.col("n_solid"))).cast("double"),
        "n_tiny_components": F.size(F.filter("sizes", lambda s: s < 0.02 * F.col("n_solid"))).cast("double"), "n_solid_components": F.size("sizes").cast("double"),
        "hole_frac": (F.col("full") - F.col("n_solid")) / F.greatest(F.col("full"), one), "hole_pixels": F.col("full") - F.col("n_solid"),
    }
    told = found.select("vec_id", *(v.alias(k) for k, v in stats.items()))
    made = gates.mask(F.col, F.lit(False))
    return told.select("vec_id", r("roi_fill", 6).alias("roi_fill"), r("hole_frac", 6).alias("hole_frac"), *(text.joined(v).alias(k) for k, v in made.items()))


@query(f"""WITH {SCORED_SQL} SELECT doc_id, round(score, 4) AS score FROM decided WHERE decision = 'review' AND score >= 30 ORDER BY score DESC, doc_id LIMIT 8""")
def top_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the eight best items in review."""
    scored = read(spark, sf_dir, "documents").select("doc_id", text_score().alias("score")).withColumn("decision", banded(F.col("score")))
    return analytics.best_of(scored, (F.col("decision") == "review") & (F.col("score") >= 30), [F.desc("score"), F.col("doc_id")], 8).select("doc_id", r("score").alias("score"))


@query(f"""WITH {SCORED_SQL}, t AS (SELECT unnest(list_filter({TAGS_SQL}, lambda x: x IS NOT NULL)) AS tag FROM decided WHERE score <= 40), c AS (SELECT tag, count(*) AS n FROM t GROUP BY 1) SELECT 'floor' AS part, tag, n, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM c""")
def floor_reject_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the worst items are tagged with."""
    low = read(spark, sf_dir, "documents").where(text_score() <= 40).select(F.lit("floor").alias("part"), tags.raised(*((c, n) for n, c in text_tags().items())).alias("bads"))
    return analytics.tag_counts(low, "part", F.col("bads"), 10).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT l_partkey, max(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS "N", max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS "R", round(max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') - max(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 4) AS change FROM lineitem GROUP BY 1""")
def variant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.by_variant(read(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", ["N", "R"], "l_extendedprice").withColumn("change", r("change"))


@query("""SELECT s_suppkey, count(l_orderkey) AS n, coalesce(round(avg(l_quantity), 4), -1.0) AS mean FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1""")
def report_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the report of their worker, or an empty one: summed first, then joined."""
    found = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("l_orderkey").alias("n"), r(F.avg("l_quantity")).alias("mean"))
    return read(spark, sf_dir, "supplier").select("s_suppkey").join(found, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(-1.0)).alias("mean"))


@query("""SELECT event_type, min(event_id) AS first FROM events GROUP BY 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.first_seen(read(spark, sf_dir, "events"), "event_type", F.col("event_id"))


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, 'image_' || event_type AS key, round(value * 2, 4) AS doubled, CASE WHEN (props->>'k')::BIGINT > 50 THEN (props->>'k')::BIGINT ELSE -1 END AS large FROM events""")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON to a map, filtered and prefixed, and read again by key."""
    props = F.from_json("props", "map<string,bigint>")
    kept = F.map_filter(props, lambda _, v: v > 50)
    prefixed = F.transform_keys(F.create_map(F.col("event_type"), F.col("value") * 2), lambda k, _: F.concat(F.lit("image_"), k))
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.lit("k")).alias("k"), F.get(F.map_keys(prefixed), F.lit(0)).alias("key"), r(F.get(F.map_values(prefixed), F.lit(0))).alias("doubled"), F.coalesce(F.try_element_at(kept, F.lit("k")), F.lit(-1)).alias("large"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(round(l_discount * 100)::BIGINT * 1000 + l_linenumber * 10 + l_suppkey % 10)) AS x FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(x[1:5], ',') AS lowest FROM s""")
def lowest_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five lowest subscores of an item, which has a few."""
    coded = F.round(F.col("l_discount") * 100).cast("long") * 1000 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10
    some = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(coded)).alias("x"))
    return some.select("l_orderkey", F.array_join(F.slice("x", 1, 5).cast("array<string>"), ",").alias("lowest"))


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 0.2 WHEN p_size >= 40 THEN 0.9 ELSE 0.2 + (p_size - 10) * (0.7 / 30) END, 6) AS strength, greatest(1, floor(p_retailprice * least(1.0, 600 / greatest(p_retailprice, p_size * 30.0))))::INT AS width FROM part""")
def interpolated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    fitted = scores.fit_side(F.col("p_retailprice"), F.col("p_size") * 30.0, 600)
    return parts.select("p_partkey", r(scores.line(F.col("p_size"), 10, 0.2, 40, 0.9), 6).alias("strength"), fitted["width"].alias("width"))


SAID = ["mask_gate: empty_mask", "studio_gate:final_washed_out", "Cannot identify image file 'x'", "CUDA out of memory", "onnxruntime: bad node", "DmlFused 8007000E", "compose_failed at 3", "Unsupported pixel format", "mask_gate:", "low_object_contrast", "a plain remark"]
STAGES = ["decode", "gate", ""]
ERRORS = [None, "failed to decode: unsupported", "no such file x", "Permission denied", "OOM", "compose_failed", "mask_gate: empty_mask", "anything"]
_low = "lower(bare)"
_exhausted = "(" + " OR ".join(f"contains({{}}, '{x}')" for x in text.EXHAUSTED) + ")"


def _picked_sql(values: list[str | None], at: str) -> str:
    return f"[{', '.join('NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][{at}]"


def _reason_sql(raw: str) -> str:
    bare = f"trim(replace(replace({raw}, 'mask_gate:', ''), 'studio_gate:', ''))"
    low, table = f"lower({bare})", " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.REASON_NAMES.items())
    return f"""CASE WHEN contains({low}, 'failed to decode') OR contains({low}, 'cannot identify image') THEN 'decode_failed' WHEN contains({low}, 'unsupported') AND contains({low}, 'format') THEN 'unsupported_format'
    WHEN {_exhausted.replace("{}", low)} THEN 'inference_oom' WHEN contains({low}, 'compose_failed') THEN 'compose_failed' ELSE coalesce(CASE {bare} {table} END, CASE WHEN contains({low}, 'onnxruntime') OR contains({low}, 'dmlfused') THEN 'inference_runtime_error'
    WHEN {bare} = '' THEN 'segmentation_unreliable' ELSE substr({bare}, 1, 120) END) END"""


def _picked(values: list[str | None], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


@query(f"""WITH e AS (SELECT {_picked_sql([*SAID, *text.REASON_NAMES], f"event_id % {len(SAID) + len(text.REASON_NAMES)} + 1")} AS raw FROM events) SELECT {_reason_sql("raw")} AS reason, count(*) AS n FROM e GROUP BY 1""")
def reason_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by their one name: texts, tags and plain remarks."""
    said = [*SAID, *text.REASON_NAMES]
    named = read(spark, sf_dir, "events").select(text.qc_reason(_picked(said, F.col("event_id") % len(said))).alias("reason"))
    return named.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS (SELECT event_type, {_picked_sql(ERRORS, f"event_id % {len(ERRORS)} + 1")} AS error, {_picked_sql(STAGES, f"event_id // {len(ERRORS)} % {len(STAGES)} + 1")} AS stage FROM events),
f AS (SELECT event_type, CASE WHEN error IS NULL THEN 'no_candidate' WHEN stage = 'decode' OR contains(lower(error), 'failed to decode') THEN CASE WHEN contains(lower(error), 'unsupported') THEN 'unsupported_format' ELSE 'decode_failed' END
WHEN contains(lower(error), 'source not found') OR contains(lower(error), 'no such file') THEN 'source_unreadable' WHEN {_exhausted.replace("{}", "lower(error)")} THEN 'inference_oom' WHEN contains(lower(error), 'compose_failed') THEN 'compose_failed'
WHEN contains(lower(error), 'permission') THEN 'final_save_failed' ELSE {_reason_sql("error")} END AS reason, coalesce({_exhausted.replace("{}", "lower(error)")}, false) AS exhausted FROM e) SELECT event_type, reason, count(*) AS n, count(*) FILTER (WHERE exhausted) AS n_exhausted FROM f GROUP BY ALL""")
def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why items failed, by error text and stage."""
    at = F.col("event_id")
    failed = read(spark, sf_dir, "events").select("event_type", _picked(ERRORS, at % len(ERRORS)).alias("error"), _picked(STAGES, F.floor(at / len(ERRORS)) % len(STAGES)).alias("stage"))
    named = failed.select("event_type", text.failure_reason(F.col("error"), F.col("stage")).alias("reason"), text.is_exhaustion(F.col("error")).alias("exhausted"))
    return named.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("exhausted").alias("n_exhausted"))


CASE_SQL = "CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN 'IMG_' || p_partkey WHEN 2 THEN 'img_' || p_partkey ELSE 'day_img_' || p_partkey END"
FILE_SQL = "CASE o_orderkey % 3 WHEN 0 THEN '/raw/2024_IMG_' || o_orderkey || '.jpg' WHEN 1 THEN '/raw/day_img_' || o_orderkey || '.png' ELSE '/raw/IMG_' || o_orderkey || '.heic' END"


@query(f"""WITH c AS (SELECT p_partkey, {CASE_SQL} AS stem FROM part), f AS (SELECT path, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') AS name FROM (SELECT {FILE_SQL} AS path FROM orders)),
i AS (SELECT key, min(path) AS file FROM (SELECT name AS key, path FROM f UNION ALL SELECT 'IMG_' || list_last(string_split(upper(name), '_IMG_')), path FROM f WHERE contains(upper(name), '_IMG_') UNION ALL SELECT list_last(string_split(upper(name), '_IMG_')), path FROM f WHERE contains(upper(name), '_IMG_')) GROUP BY 1),
k AS (SELECT p_partkey, stem, unnest([stem, upper(stem), upper(stem), upper(stem), replace(stem, 'IMG_', ''), upper(replace(stem, 'IMG_', '')), 'IMG_' || stem, upper('IMG_' || stem)]) AS key, unnest(range(8)) AS rank FROM c)
SELECT p_partkey, stem, arg_min(file, rank) AS file FROM k JOIN i USING (key) GROUP BY ALL""")
def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and the files that they name, by the first of several keys."""
    key, order = F.col("p_partkey").cast("string"), F.col("o_orderkey").cast("string")
    stem = F.when(F.col("p_partkey") % 4 == 0, key).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("IMG_"), key)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("img_"), key)).otherwise(F.concat(F.lit("day_img_"), key))
    path = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/raw/2024_IMG_"), order, F.lit(".jpg"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/raw/day_img_"), order, F.lit(".png"))).otherwise(F.concat(F.lit("/raw/IMG_"), order, F.lit(".heic")))
    return cases.resolved(read(spark, sf_dir, "part").select("p_partkey", stem.alias("stem")), read(spark, sf_dir, "orders").select(path.alias("path"))).drop("key")


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE ends_with(path, '.heic')) AS n_heic, count(DISTINCT substr(path, 6)) AS n_relative, min(sha256(path)) AS least_digest FROM (SELECT {FILE_SQL} AS path FROM orders)""")
def listing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing's files: how many are HEIC, their paths below the folder, a digest of content."""
    order = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/raw/2024_IMG_"), order, F.lit(".jpg"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/raw/day_img_"), order, F.lit(".png"))).otherwise(F.concat(F.lit("/raw/IMG_"), order, F.lit(".heic")))
    listed = read(spark, sf_dir, "orders").select(path.alias("path"))
    return listed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("path").rlike(r"[.]hei[cf]$")).alias("n_heic"), F.count_distinct(text.relative_to(F.col("path"), F.lit("/raw/"))).alias("n_relative"), F.min(F.sha2("path", 256)).alias("least_digest"))


@query("""WITH t AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'view') AS processed, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS edited, CASE WHEN user_id % 3 > 0 THEN sum(value) ELSE 0 END AS elapsed,
avg(value) FILTER (WHERE event_type = 'error' AND value > 20) AS mean_edit FROM events GROUP BY 1), e AS (SELECT *, CASE WHEN mean_edit IS NOT NULL THEN mean_edit WHEN edited > 0 AND elapsed > 0 THEN elapsed / edited WHEN processed > 0 AND elapsed > 0 THEN elapsed / processed ELSE 0 END AS per_item, total - processed AS remaining FROM t)
SELECT user_id, remaining, round(per_item, 9)::DOUBLE AS per_item, round(remaining * per_item, 7)::DOUBLE AS eta, round(CASE WHEN per_item > 0 THEN 60.0 / per_item ELSE 0 END, 9)::DOUBLE AS per_minute, CASE WHEN processed > 0 THEN 'known' ELSE '--:--' END AS eta_kind FROM e""")
def batch_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time left by user, as if each were a batch: by edits, edited or processed items, whichever there are."""
    kind, v = F.col("event_type"), F.col("value")
    state = read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind != "view").alias("processed"), F.count_if(kind.isin("click", "error")).alias("edited"), F.sum(F.when(F.col("user_id") % 3 > 0, v).otherwise(0.0)).alias("elapsed"),
        F.avg(F.when((kind == "error") & (v > 20), v)).alias("mean_edit"),
    )
    timed = batch.timing(state)
    known = F.when(F.col("eta_text").rlike(r"^[0-9:]+$"), "known").otherwise(F.col("eta_text"))
    return timed.select("user_id", "remaining", r("per_item", 9).alias("per_item"), r("eta", 7).alias("eta"), r("per_minute", 9).alias("per_minute"), known.alias("eta_kind"))


@query("""WITH a AS (SELECT conv_id, turn, length(text) % 5 <> 0 AS gate, length(text) % 60 / 100.0 AS loss, 60.0 + length(text) % 30 AS score FROM conversations),
s AS (SELECT *, max((loss >= 0.48)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS seen FROM a),
v AS (SELECT *, gate AND ((loss >= 0.48 AND score < 72) OR (seen AND loss >= 0.42 AND score < 76)) AS vetoed FROM s) SELECT conv_id, count(*) FILTER (WHERE vetoed) AS n_vetoed, min(turn) FILTER (WHERE gate AND NOT vetoed) AS winner FROM v GROUP BY 1""")
def veto_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a ladder that passed their gate but are refused for the structure that they or an earlier one lost."""
    n = F.length("text")
    tried = read(spark, sf_dir, "conversations").select("conv_id", "turn", (n % 5 != 0).alias("gate"), (n % 60 / 100.0).alias("loss"), (60.0 + n % 30).alias("score"))
    seen = batch.so_far(tried, "conv_id", "turn", F.col("loss") >= 0.48).withColumn("vetoed", decision.vetoed(F.col("gate"), F.col("loss"), F.col("score"), F.col("seen")))
    return seen.groupBy("conv_id").agg(F.count_if("vetoed").alias("n_vetoed"), F.min(F.when(F.col("gate") & ~F.col("vetoed"), F.col("turn"))).alias("winner"))


_OCC = "list_transform(range(16), lambda i: len(list_filter(range(4), lambda k: z[((i // 4) * 2 + k // 2) * 8 + (i % 4) * 2 + k % 2 + 1][{side}] >= {bar})) / 4.0)"
LOSS_SQL = f"""{NEIGHBOURS_SQL}, o AS (SELECT vec_id, {_OCC.format(side=1, bar=140)} AS raw, {_OCC.format(side=2, bar=165)} AS fin FROM n), c AS (SELECT vec_id, i // 4 AS y, i % 4 AS x, r, f FROM (SELECT vec_id, unnest(range(16)) AS i, unnest(raw) AS r, unnest(fin) AS f FROM o)),
lost AS (SELECT vec_id, y, x FROM c WHERE (r >= 0.34 AND f <= 0.10) OR (r >= 0.28 AND f <= 0.08 AND r >= 0.03)),
reach AS (SELECT vec_id, y, x, y * 100 + x AS root FROM lost UNION SELECT l.vec_id, l.y, l.x, a.root FROM reach a JOIN lost l ON l.vec_id = a.vec_id AND abs(l.y - a.y) <= 1 AND abs(l.x - a.x) <= 1), root AS (SELECT vec_id, y, x, min(root) AS root FROM reach GROUP BY ALL),
big AS (SELECT vec_id, max(n) AS largest FROM (SELECT vec_id, root, count(*) AS n FROM root GROUP BY ALL) GROUP BY 1), n_lost AS (SELECT vec_id, count(*) AS n_lost FROM lost GROUP BY 1),
w AS (SELECT vec_id, count(*) FILTER (WHERE r >= 0.28) AS cells, avg(greatest(0.0, r - f)) FILTER (WHERE r >= 0.28) AS mean_short, quantile_cont(greatest(0.0, r - f), 0.75) FILTER (WHERE r >= 0.28) AS p75, sum(least(r, f)) / greatest(sum(r), 0.25) AS survival FROM c GROUP BY 1),
s AS (SELECT vec_id, coalesce(n_lost, 0) AS n_lost, cells, coalesce(n_lost, 0) / greatest(cells, 1)::DOUBLE AS share, coalesce(largest, 0) / greatest(cells, 1)::DOUBLE AS largest, least(100.0, 100.0 * (0.45 * coalesce(mean_short, 0) + 0.55 * coalesce(p75, 0))) AS regional, survival,
CASE vec_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS conf FROM w LEFT JOIN big USING (vec_id) LEFT JOIN n_lost USING (vec_id)),
t AS (SELECT *, greatest(0.0, least(100.0, 100.0 * survival * (1 - 0.55 * largest))) AS survival_score, (largest >= 0.18 AND n_lost >= 4 AND 1 - survival >= 0.12 AND survival <= 0.88) OR (largest >= 0.28 AND n_lost >= 6 AND survival <= 0.92) OR (share >= 0.30 AND largest >= 0.15 AND 1 - survival >= 0.18)
OR (conf = 'HIGH' AND survival <= 0.74 AND 1 - survival >= 0.20 AND 16 >= 400) AS candidate FROM s)"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of each raster and its successor: what is lost between them."""
    share = lambda x, bar: raster.cells(F.transform(x, lambda v: F.when(v >= bar, 1.0).otherwise(0.0)), 8, 2)
    grids = neighbours(spark, sf_dir).select("vec_id", share(F.col("x"), 140).alias("raw"), share(F.col("y"), 165).alias("fin"))
    cells = grids.withColumn("lost", spatial.lost_cells(F.col("raw"), F.col("fin"), F.col("raw")))
    told = cells.select("vec_id", "raw", "fin", *(v.alias(k) for k, v in spatial.regional(F.col("raw"), F.col("fin"), F.col("lost"), 4).items()))
    kept = raster.total(F.zip_with("raw", "fin", lambda a, b: F.least(a, b))) / F.greatest(raster.total(F.col("raw")), F.lit(0.25))
    told = told.withColumns({"survival": kept, "conf": F.get(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), (F.col("vec_id") % 3).cast("int"))})
    c = F.col
    return told.withColumns({
        "foreground_survival_score": spatial.survival_score(c("survival"), c("largest_missing_region_ratio")),
        "candidate": gates.large_loss(c("largest_missing_region_ratio"), c("n_lost_cells"), c("lost_cell_frac"), 1 - c("survival"), c("survival"), c("conf"), F.lit(16)),
    })


@query(f"""WITH RECURSIVE {LOSS_SQL} SELECT vec_id, n_lost::BIGINT AS n_lost, cells::BIGINT AS cells, round(share, 6) AS share, round(largest, 6) AS largest, round(regional, 4) AS regional, round(survival_score, 4) AS survival_score, candidate, candidate AND conf = 'HIGH' AS held FROM t""")
def regional_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost cells, the largest lost region and the loss by region of each raster against its successor."""
    c = F.col
    return losses(spark, sf_dir).select(
        "vec_id", c("n_lost_cells").cast("long").alias("n_lost"), c("n_raw_cells").cast("long").alias("cells"), r("lost_cell_frac", 6).alias("share"), r("largest_missing_region_ratio", 6).alias("largest"), r("regional_structure_loss_score").alias("regional"),
        r("foreground_survival_score").alias("survival_score"), "candidate", (c("candidate") & (c("conf") == "HIGH")).alias("held"),
    )


@query(f"""WITH RECURSIVE {LOSS_SQL}, v AS (SELECT *, 1000 + vec_id % 7 * 100 AS seen, vec_id % 5 * 150 AS missing, 1000 - vec_id % 11 * 60 AS same, vec_id % 4 * n_lost // 3 AS confirmed FROM t),
x AS (SELECT *, candidate AND conf <> 'HIGH' AS asked, same / seen::DOUBLE >= 0.82 AND missing / seen::DOUBLE < 0.08 AS ground FROM v),
y AS (SELECT *, asked AND NOT ground AND ((missing / seen::DOUBLE >= 0.12 AND missing >= 400) OR (confirmed / greatest(n_lost, 1)::DOUBLE >= 0.45 AND missing >= 200)) AS yes FROM x)
SELECT vec_id, CASE WHEN yes OR (candidate AND conf = 'HIGH') THEN 1.0 ELSE 0.0 END::DOUBLE AS held, CASE WHEN candidate AND (yes OR NOT asked) THEN 1.0 ELSE 0.0 END::DOUBLE AS candidate, CASE WHEN yes THEN 1.0 WHEN asked THEN 0.0 END::DOUBLE AS verified,
round(CASE WHEN asked AND NOT yes AND (conf = 'LOW' OR ground) THEN least(largest, 0.08) ELSE largest END, 6) AS largest, round(CASE WHEN asked AND NOT yes AND (conf = 'LOW' OR ground) THEN greatest(survival_score, 86.0) ELSE survival_score END, 4) AS survival_score,
CASE WHEN yes THEN 'large_contiguous_foreground_loss' ELSE '' END AS bads, CASE WHEN asked AND NOT yes THEN 'spatial_product_loss_warn' ELSE '' END AS warns FROM y""")
def loss_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspected losses after a second look, whose counts are stood in for by ids."""
    i, none = F.col("vec_id"), F.lit(None).cast("array<string>")
    found = losses(spark, sf_dir).withColumns({
        "spatial_evidence_confidence": F.col("conf"), "spatial_loss_candidate": F.when(F.col("candidate"), 1.0).otherwise(0.0), spatial.LARGE: F.when(F.col("candidate") & (F.col("conf") == "HIGH"), 1.0).otherwise(0.0), "bads": none, "warns": none, "triggered": none,
    })
    made = spatial.verified(F.col, 1000 + i % 7 * 100, i % 5 * 150, 1000 - i % 11 * 60, F.floor(i % 4 * F.col("n_lost_cells") / 3), F.col("n_lost_cells"))
    told = found.select("vec_id", *(v.alias(k) for k, v in made.items()))
    return told.select(
        "vec_id", F.col(spatial.LARGE).alias("held"), F.col("spatial_loss_candidate").alias("candidate"), F.col("spatial_verified").alias("verified"), r("largest_missing_region_ratio", 6).alias("largest"), r("foreground_survival_score").alias("survival_score"),
        text.joined(F.col("bads")).alias("bads"), text.joined(F.col("warns")).alias("warns"),
    )


@query(f"""WITH g AS (SELECT label, {GREY_SQL} AS c FROM embeddings), l AS (SELECT label, c[4] AS alpha, {_lab_sql(1)} AS lab FROM g) SELECT label, count(*) FILTER (WHERE alpha >= 80) AS n, round(avg(lab[1]) FILTER (WHERE alpha >= 80), 3) AS lightness,
round(avg(lab[2]) FILTER (WHERE alpha >= 80), 3) AS a, round(avg(lab[3]) FILTER (WHERE alpha >= 80), 3) AS b FROM l GROUP BY 1""")
def color_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean colour of each label's product pixels: a vector's first values as red, green, blue and alpha."""
    pixels = read(spark, sf_dir, "embeddings").select("label", grey().alias("c"))
    red, green, blue, alpha = (F.get("c", F.lit(i)) for i in range(4))
    found = profiles.color_signature(pixels.select("label", red.alias("r"), green.alias("g"), blue.alias("b"), alpha.alias("alpha")), "label")
    return found.select("label", "n", *(r(c, 3).alias(c) for c in ("lightness", "a", "b")))


@query(f"""WITH g AS (SELECT vec_id, {GREY_SQL} AS x FROM embeddings) SELECT vec_id, round(len(list_filter(range(4), lambda i: x[(i // 2) * 8 + i % 2 + 1] >= 180)) / 4.0, 4)::DOUBLE AS bg_purity, round(len(list_filter(x, lambda v: v >= 40)) / 64.0, 4)::DOUBLE AS fg_share FROM g""")
def compose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How white the corner is and how much of the frame the product takes."""
    return read(spark, sf_dir, "embeddings").select("vec_id", grey().alias("x")).select("vec_id", r(raster.corner_share(F.col("x"), 8, 2, 180.0)).alias("bg_purity"), r(raster.share(F.col("x"), lambda v: v >= 40)).alias("fg_share"))


@query(f"""WITH g AS (SELECT vec_id, vec_id % 3 AS e, {GREY_SQL} AS x FROM embeddings), a AS (SELECT vec_id, e, CASE e WHEN 0 THEN list_transform(x, lambda v: CASE WHEN v < 200 THEN 255.0 ELSE 0.0 END) WHEN 1 THEN list_transform(x, lambda v: greatest(0.0, least(255.0, 255.0 * (220 - v) / 100))) END AS alpha FROM g)
SELECT vec_id, CASE e WHEN 0 THEN 'luma' WHEN 1 THEN 'soft' ELSE 'absent' END AS engine, round(list_sum(alpha) / 64.0, 4)::DOUBLE AS mean_alpha FROM a""")
def engine_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster by the engine that its row names."""
    name = F.get(F.array(*map(F.lit, ("luma", "soft", "absent"))), (F.col("vec_id") % 3).cast("int"))
    made = read(spark, sf_dir, "embeddings").select("vec_id", name.alias("engine"), grey().alias("x"))
    return made.select("vec_id", "engine", extraction.extract(F.col("x"), F.col("engine")).alias("alpha")).select("vec_id", "engine", r(raster.total(F.col("alpha")) / 64).alias("mean_alpha"))


@query(f"""WITH {NEIGHBOURS_SQL}, s AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE z END AS z, z AS own, vec_id % 10 / 10.0 AS p, vec_id % 7 / 7.0 AS q, len(list_filter(z, lambda p: p[1] >= 128 AND p[2] >= 128)) / greatest(len(list_filter(z, lambda p: p[1] >= 128 OR p[2] >= 128)), 1)::DOUBLE AS iou FROM n),
m AS (SELECT *, CASE WHEN z IS NULL THEN list_transform(own, lambda p: p[1]) WHEN iou >= 0.35 THEN list_transform(z, lambda p: CASE WHEN p[1] >= 128 AND p[2] >= 128 THEN floor(0.5 * p[1] + 0.5 * p[2]) ELSE greatest(p[1], p[2]) END) WHEN p >= q THEN list_transform(z, lambda p: p[1]) ELSE list_transform(z, lambda p: p[2]) END AS mask FROM s)
SELECT vec_id, round(list_sum(mask) / 64.0, 4) AS mean_alpha, round(CASE WHEN z IS NULL THEN p WHEN iou >= 0.35 THEN 0.5 * greatest(p, q) + 0.5 * least(p, q) ELSE 0.9 * greatest(p, q) END, 6)::DOUBLE AS confidence, CASE WHEN z IS NULL THEN 'alone' WHEN iou >= 0.35 THEN 'ensemble_max' ELSE 'selected_by_confidence' END AS how FROM m""")
def mask_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster and its successor as two masks of one picture; some have no second."""
    i = F.col("vec_id")
    both = neighbours(spark, sf_dir).withColumn("y", F.when(i % 9 != 0, F.col("y")))
    made = extraction.ensemble(F.col("x"), F.col("y"), i % 10 / 10.0, i % 7 / 7.0, 0.35)
    told = both.select("vec_id", *(v.alias(k) for k, v in made.items()))
    return told.select("vec_id", r(raster.total(F.col("mask")) / 64).alias("mean_alpha"), r("confidence", 6).alias("confidence"), "how")


@query("""SELECT count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(count(*) FILTER (WHERE value > 80) / greatest(count(*), 1)::DOUBLE, 6) AS rescue_rate, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'error') AS n_error FROM events""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.bench_summary(read(spark, sf_dir, "events"), "value", F.col("value") > 80, "event_type", ["view", "error"])
    return found.withColumns({c: r(c) for c in ("mean", "p50", "p95")} | {"rescue_rate": r("rescue_rate", 6)})


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice / 5000 >= 76 ORDER BY o_totalprice DESC, o_orderkey LIMIT 8""")
def flip_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the first eight orders whose decision went from review to pass."""
    old = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "second_pass").otherwise("review")
    both = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", old.alias("was"), banded(F.col("o_totalprice") / 5000).alias("now"))
    return analytics.flips(both, "was", "now", "review", "pass", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


def _drawn(k: int, n: int, scale: float) -> str:
    """A stand-in measurement of a line, as SQL of either engine: n values from 0, a ``scale`` apart."""
    return f"(CAST((l_orderkey * {k} + l_linenumber * 5 + l_suppkey) % {n} AS DOUBLE) * CAST({scale} AS DOUBLE))"


CUTOUT = {"fog_of_fg": _drawn(3, 11, 0.1), "solid_of_fg": _drawn(7, 10, 0.1), "visibility": _drawn(2, 19, 5.0), "solid_std": _drawn(5, 8, 3.0), "near_white_in_solid": _drawn(11, 11, 0.1), "edge_band_frac": _drawn(13, 9, 0.06), "edge_band_mean_alpha": _drawn(17, 13, 12.0), "roi_solid_fill": _drawn(19, 7, 0.15)}
STUDIO = {
    "product_visibility": _drawn(3, 17, 5.0), "product_mean": _drawn(7, 14, 19.3), "product_std": _drawn(2, 9, 2.5), "studio_roi_fill": _drawn(5, 8, 0.1), "light_grey_frac": _drawn(11, 12, 0.09), "dark_frac": _drawn(13, 6, 0.02),
    "n_dark_components": _drawn(17, 11, 1.0), "main_dark_frac": _drawn(19, 13, 0.08), "n_dark_tiny": _drawn(23, 15, 1.0), "edge_inner_light_frac": _drawn(29, 10, 0.07), "bg_dirty_frac": _drawn(31, 5, 0.02), "bg_shadow_frac": _drawn(37, 5, 0.015),
}
EVIDENCE = {"evidence_pixels": _drawn(3, 13, 60.0), "soft_pixels": _drawn(7, 9, 45.0), "overlap": _drawn(2, 10, 0.07), "structured_evidence_frac": _drawn(5, 11, 0.08), "prior_frac": _drawn(11, 8, 0.08), "prior_shadow_excluded": _drawn(13, 6, 0.03)}
INTEGRITY = {
    "prior_wipe_frac": _drawn(3, 11, 0.05), "texture_ratio": _drawn(7, 13, 0.1), "edge_energy_ratio": _drawn(2, 12, 0.11), "strong_edge_keep": _drawn(5, 11, 0.1), "mid_prior_wipe": _drawn(11, 7, 0.09), "dark_prior_wipe": _drawn(13, 7, 0.06),
    "prior_kept_frac": _drawn(17, 11, 0.1), "whiteout_frac": _drawn(19, 9, 0.05), "blown_frac": _drawn(23, 8, 0.045), "foreground_survival_score": _drawn(29, 12, 9.5),
}
SAID_SQL = "SELECT bads, warns, posits, count(*) AS n FROM s GROUP BY ALL"


def _lines_sql(measures: dict[str, str]) -> str:
    return f"m AS (SELECT l_linenumber = 1 AS difficult, l_linenumber % 3 AS kind, {', '.join(f'{v} AS {k}' for k, v in measures.items())} FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str, measures: dict[str, str]) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") == 1).alias("difficult"), (F.col("l_linenumber") % 3).alias("kind"), *(F.expr(v).alias(k) for k, v in measures.items()))


def _said(told: DataFrame, made: dict[str, Column]) -> DataFrame:
    kinds = ("bads", "warns", "posits")
    return told.select(*(text.joined(made[k]).alias(k) for k in kinds)).groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))


_FOGGY, _FADED = "foggy_alpha_edges", "product_faded"
_CUTOUT_RULES = [
    [("fog_of_fg >= 0.70 AND solid_of_fg < 0.30", "bad", _FOGGY), ("fog_of_fg >= 0.55 AND solid_of_fg < 0.38", "warn", _FOGGY)],
    [
        ("visibility < 8 OR (visibility < 14 AND near_white_in_solid >= 0.75) OR (near_white_in_solid >= 0.90 AND solid_std < 10 AND visibility < 22)", "bad", _FADED),
        ("difficult AND near_white_in_solid >= 0.85 AND visibility < 18", "warn", _FADED), ("difficult AND visibility < 18 AND solid_std < 12", "warn", "low_object_contrast"),
    ],
    [("visibility >= 40 AND solid_of_fg >= 0.55 AND fog_of_fg < 0.35", "good", "strong_visibility")], [("visibility >= 80 AND near_white_in_solid < 0.15", "good", "dark_high_contrast")],
    [("edge_band_frac >= 0.35 AND edge_band_mean_alpha < 85", "bad", _FOGGY), ("edge_band_frac >= 0.28 AND edge_band_mean_alpha < 90 AND fog_of_fg >= 0.45", "warn", _FOGGY), ("edge_band_frac < 0.15 AND edge_band_mean_alpha >= 100", "good", "coherent_edges")],
    [("roi_solid_fill >= 0.45 AND solid_of_fg >= 0.60", "good", "solid_roi")],
]


@query(f"WITH {_lines_sql(CUTOUT)}, s AS (SELECT {_spoken_sql(_CUTOUT_RULES)} FROM m) {SAID_SQL}")
def cutout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cutout gate says of each line's stand-in measurements, counted."""
    return _said(_lines(spark, sf_dir, CUTOUT), gates.cutout(F.col, F.col("difficult")))


_SHOT_SPRAY, _SHOT_KIT = "(n_dark_components >= 5 AND main_dark_frac < 0.35 AND n_dark_tiny >= 10)", "(n_dark_components BETWEEN 2 AND 12 AND n_dark_tiny <= greatest(6, n_dark_components * 2) AND main_dark_frac >= 0.08)"
_SHOT_FINE = f"({_SHOT_KIT} AND NOT {_SHOT_SPRAY})"
_STUDIO_RULES = [
    [
        ("product_visibility < 10 OR (product_mean >= 248 AND product_std <= 6) OR (product_mean >= 244 AND product_std <= 8 AND product_visibility < 14)", "bad", "final_washed_out"),
        ("difficult AND product_visibility < 16 AND product_std <= 12 AND studio_roi_fill < 0.25", "warn", "final_bright_product_vanished"),
    ],
    [("light_grey_frac >= 0.85 AND product_std < 12 AND product_visibility < 22", "bad", _FADED), ("light_grey_frac >= 0.80 AND product_visibility < 18 AND product_std < 14", "warn", _FADED)],
    [("dark_frac >= 0.04 AND product_visibility >= 50", "good", "dark_on_white")], [("product_visibility >= 40 AND light_grey_frac < 0.25 AND studio_roi_fill >= 0.30", "good", "readable_product")], [(_SHOT_FINE, "good", "multi_object_ok")],
    [
        (f"{_SHOT_FINE} AND n_dark_components <= 3 AND main_dark_frac >= 0.55", "good", "coherent_dark_core"), (_SHOT_FINE, "-", ""),
        (f"{_SHOT_SPRAY} OR (n_dark_components >= 8 AND main_dark_frac < 0.30) OR (n_dark_components >= 2 AND main_dark_frac < 0.35 AND n_dark_tiny >= 12)", "bad", _FRAG),
        ("n_dark_components >= 2 AND main_dark_frac < 0.62 AND n_dark_tiny >= 6", "warn", _FRAG), ("n_dark_components <= 2 AND main_dark_frac >= 0.70", "good", "coherent_dark_core"),
    ],
    [("bg_dirty_frac >= 0.06", "warn", "dirty_background")], [("bg_shadow_frac >= 0.045", "warn", "large_background_shadow")],
    [("dark_frac < 0.05 AND edge_inner_light_frac >= 0.55 AND light_grey_frac >= 0.45", "bad", _FOGGY), ("dark_frac < 0.05 AND edge_inner_light_frac >= 0.48 AND difficult AND light_grey_frac >= 0.40", "warn", _FOGGY)],
]


@query(f"WITH {_lines_sql(STUDIO)}, s AS (SELECT {_spoken_sql(_STUDIO_RULES)} FROM m) {SAID_SQL}")
def studio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate of the finished picture says of each line's stand-in measurements, counted."""
    return _said(_lines(spark, sf_dir, STUDIO), gates.studio(F.col, F.col("difficult")))


@query(f"""WITH {_lines_sql(EVIDENCE)} SELECT kind, CASE WHEN evidence_pixels < 120 THEN 'LOW' WHEN NOT difficult AND kind = 1 AND prior_frac <= 0.42 AND overlap >= 0.35 THEN 'HIGH'
WHEN (structured_evidence_frac >= 0.55 AND prior_shadow_excluded < 0.08 AND overlap >= 0.40 AND evidence_pixels <= greatest(1.0, soft_pixels) * 2.8) OR (structured_evidence_frac >= 0.40 AND overlap >= 0.50 AND evidence_pixels <= greatest(1.0, soft_pixels) * 2.2) THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS n FROM m GROUP BY ALL""")
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each line's stand-in evidence can be trusted, counted."""
    mode = F.when(F.col("kind") == 1, "independent_prior").otherwise("mask_prior")
    level = gates.evidence_confidence(F.col, mode, F.col("difficult"))
    return _lines(spark, sf_dir, EVIDENCE).groupBy("kind", level.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


_INTEGRITY_RULES = [
    [("prior_wipe_frac >= 0.38", "-", ""), ("prior_wipe_frac >= 0.18", "warn", "structure_integrity_warn")], [("texture_ratio < 0.32", "bad", "detail_destroyed"), ("texture_ratio < 0.55", "warn", "detail_retention_warn")],
    [("strong_edge_keep < 0.40", "bad", "edge_structure_lost"), ("strong_edge_keep < 0.62", "warn", "edge_consistency_warn")], [("white >= 0.28", "bad", "product_whiteout"), ("white >= 0.12", "warn", "product_whiteout_warn")],
    [("shape >= 85 AND detail >= 75 AND edges >= 80 AND over >= 80 AND foreground_survival_score >= 80", "good", "raw_final_integrity_ok")],
]
_CL = oracles.clamp


@query(f"""WITH {_lines_sql(INTEGRITY)}, a AS (SELECT *, {_CL("100.0 * prior_kept_frac - 55.0 * greatest(0.0, prior_wipe_frac - 0.18) - CASE WHEN mid_prior_wipe >= 0.38 AND dark_prior_wipe <= 0.25 THEN 35.0 ELSE 0.0 END")} AS shape,
50.0 * least(1.15, texture_ratio) + 50.0 * least(1.15, edge_energy_ratio) AS raw_detail, {_CL("CASE WHEN strong_edge_keep < 0.40 THEN least(100.0 * strong_edge_keep, 30.0) ELSE 100.0 * strong_edge_keep END")} AS edges, greatest(whiteout_frac, blown_frac) AS white,
100.0 - 120.0 * greatest(whiteout_frac, 1.2 * blown_frac) AS raw_over FROM m), b AS (SELECT *, {_CL("CASE WHEN texture_ratio < 0.32 THEN least(raw_detail, 28.0) WHEN texture_ratio < 0.55 THEN least(raw_detail, 55.0) ELSE raw_detail END")} AS detail,
{_CL("CASE WHEN white >= 0.28 THEN least(raw_over, 22.0) ELSE raw_over END")} AS over FROM a), s AS (SELECT 0.30 * shape + 0.20 * detail + 0.15 * edges + 0.15 * over + 0.20 * least(100.0, foreground_survival_score) AS whole, {_spoken_sql(_INTEGRITY_RULES)} FROM b)
SELECT bads, warns, posits, count(*) AS n, round(avg(whole), 4)::DOUBLE AS mean_integrity, round(min(whole), 4)::DOUBLE AS least_integrity FROM s GROUP BY ALL""")
def integrity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of the finished picture and its tags from each line's stand-in shares."""
    made = gates.integrity(F.col)
    kinds = ("bads", "warns", "posits")
    told = _lines(spark, sf_dir, INTEGRITY).select(made["raw_final_integrity"].alias("whole"), *(text.joined(made[k]).alias(k) for k in kinds))
    return told.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"), r(F.avg("whole")).alias("mean_integrity"), r(F.min("whole")).alias("least_integrity"))


@query("""SELECT doc_id, split_part(cached, '|', 1) AS fp, split_part(cached, '|', 2) AS bucket FROM (SELECT doc_id, substr(sha256(text), 1, 8) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '|' || source END AS cached FROM documents)""")
def cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and bucket of cached values, some of which have no bucket."""
    cached = F.concat(F.substring(F.sha2("text", 256), 1, 8), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("|"), "source")))
    fp, bucket = text.cached_parts(F.col("cached"))
    return read(spark, sf_dir, "documents").select("doc_id", cached.alias("cached")).select("doc_id", fp.alias("fp"), bucket.alias("bucket"))


@query(f"""WITH RECURSIVE {_mask_sql(150)}, c AS (SELECT vec_id, count(*) AS pieces FROM k GROUP BY 1), e AS (SELECT vec_id, count(*) FILTER (WHERE v >= 150) / 28.0 AS border FROM px WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY 1), {MEASURES_SQL},
q AS (SELECT *, greatest(0.0, 1.0 - (CASE WHEN solid < 0.004 THEN 0.70 ELSE 0 END + CASE WHEN solid < 0.02 THEN 0.25 ELSE 0 END + CASE WHEN solid > 0.88 THEN 0.30 ELSE 0 END + CASE WHEN unsure > 0.14 THEN 0.18 ELSE 0 END + CASE WHEN interior < 0.82 THEN 0.16 ELSE 0 END
+ CASE WHEN border > 0.22 THEN 0.12 ELSE 0 END + CASE WHEN ghost > 2.5 THEN 0.22 ELSE 0 END + CASE WHEN coalesce(pieces, 0) >= 18 AND solid < 0.04 THEN 0.12 ELSE 0 END))::DOUBLE AS score FROM m JOIN e USING (vec_id) LEFT JOIN c USING (vec_id))
SELECT vec_id, round(border, 6)::DOUBLE AS border, coalesce(pieces, 0)::INT AS pieces, round(score, 6) AS score, CASE WHEN solid < 0.012 OR solid > 0.93 OR (ghost > 3.5 AND interior < 0.55) OR (interior < 0.45 AND unsure > 0.18) THEN 'INVALID'
WHEN unsure > 0.11 OR interior < 0.84 OR border > 0.28 OR solid < 0.028 OR solid > 0.78 OR ghost > 1.8 OR score < 0.62 THEN 'UNCERTAIN' ELSE 'GOOD' END AS gate FROM q""")
def alpha_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction gate with all that it measures: border and pieces too."""
    c, solid = F.col, F.transform("x", lambda v: F.when(v >= 150, 1.0).otherwise(0.0))
    told = measured(spark, sf_dir).withColumn("mask", solid).withColumns({"border": neighbourhood.border_share(c("mask"), 8), "pieces": F.size(neighbourhood.sizes(neighbourhood.components(c("mask"), 8)))})
    told = told.withColumn("score", extraction.quality(c("solid"), c("unsure"), c("interior"), c("border"), c("ghost"), c("pieces")))
    return told.select("vec_id", r("border", 6).alias("border"), "pieces", r("score", 6).alias("score"), extraction.gate(c("solid"), c("unsure"), c("interior"), c("border"), c("ghost"), c("score")).alias("gate"))


@query(f"""WITH {NEIGHBOURS_SQL}, f AS (SELECT vec_id, list_filter(z, lambda p: p[1] >= 200) AS z FROM n) SELECT vec_id, len(z)::INT AS n, round(CASE WHEN len(z) > 0 THEN list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) / len(z) ELSE 0 END, 6)::DOUBLE AS mae FROM f""")
def masked_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference of two rasters where the first, as alpha, is solid."""
    kept = F.filter(F.zip_with("x", "y", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] >= 200)
    pairs = neighbours(spark, sf_dir).select("vec_id", kept.alias("kept"))
    apart = raster.mean_difference(F.transform("kept", lambda p: p["a"]), F.transform("kept", lambda p: p["b"]))
    return pairs.select("vec_id", F.size("kept").alias("n"), r(apart, 6).alias("mae"))


@query("""WITH p AS (SELECT p_partkey, p_size * 37 + 40 AS w, p_partkey % 900 + 60 AS h FROM part), s AS (SELECT *, least(600.0 / w, 400.0 / h) AS k FROM p), f AS (SELECT p_partkey, greatest(1, trunc(w * k))::INT AS width, greatest(1, trunc(h * k))::INT AS height FROM s)
SELECT p_partkey, width, height, ((600 - width) // 2)::INT AS "left", ((400 - height) // 2)::INT AS top FROM f""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures fitted into a frame and placed in its middle."""
    sizes = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 40).alias("w"), (F.col("p_partkey") % 900 + 60).alias("h"))
    return sizes.select("p_partkey", scores.letterboxed(F.col("w"), F.col("h"), 600, 400).alias("b")).select("p_partkey", "b.*")


@query("""WITH rest AS (SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, greatest(1, floor(count(*) OVER (PARTITION BY p_brand) / 5.0)) AS step FROM rest) SELECT p_partkey, p_brand FROM k WHERE place % step = 0 AND place / step < 5""")
def sample_of_the_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A systematic sample of the parts that weren't selected already."""
    chosen = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    rest = read(spark, sf_dir, "part").select("p_partkey", "p_brand").join(chosen, "p_partkey", "left_anti")
    return batch.every_kth(rest, "p_brand", ["p_partkey"], 5)
