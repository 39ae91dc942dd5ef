"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Rules judge the pages that they fit; those pages are also what the classifier learns from.  A host's names are
cut into words by unigram Viterbi with word counts from the pages' texts: the substrings of a distinct name are
joined with the counted words, so the dictionary is never held in one place, and the best cut is found among the words
that a name holds.  A word of over ``STUB`` letters meets names by its first ``STUB`` letters and is then looked for in them, so
words and names may have any length.  Words of the host and tokens of the path are then scored by multinomial naive
Bayes.  Tables that may be small (distinct hosts, tokens) are broadcast only after they have been counted; else common
keys are joined apart from the rest.

Special cases: a null URL, or one without ://, has an empty host and path and is judged by the prior alone; ties
allow; if rules leave a class without pages all others are allowed; repeated rows repeat their result; very long pages, hosts
and paths are read whole, in time linear in their length; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.llm.common import joined, written
from lumenqc.llm.warc import plain_text

LETTERS = re.compile(r"[^\W\d_]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STUB = 20  # letters of a substring at the most
ROOM = 2048  # places of a name whose substrings are held at once


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path

    def fits(self) -> Column:
        host, slash, path = self.text.partition("/")
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)


#: The rules of the registered query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path) by the first :// of the URL."""
    rest = F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    cut = pages.select(id_col, F.coalesce(F.col(url_col), F.lit("")).alias("u")).select(id_col, rest.alias("rest")).select(id_col, "rest", F.regexp_extract("rest", r"^[^/?#]*", 0).alias("raw"))
    return cut.select(id_col, F.translate("raw", UPPER, LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0).alias("path"))


def first_rule(rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(rule.fits(), F.lit(value(rule))).otherwise(out)
    return out


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n) of the letters-only words in the pages' texts, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for page in batch.column(0).to_pylist():
                n.update(LETTERS.findall(plain_text(page or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    return pages.select(html_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, word): the substrings of each name of up to ``STUB`` letters; of a long name some come again."""
    for batch in batches:
        for name in batch.column(0).to_pylist():
            for first in range(0, len(name), ROOM):
                words = {name[a:b] for a in range(first, min(first + ROOM, len(name))) for b in range(a + 1, min(a + STUB, len(name)) + 1)}
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(words)) if len(name) < 256 else pa.array([name] * len(words)), pa.array(words, pa.string())], names=["name", "word"])


def best_cut(name: str, known: dict[str, float], total: float) -> list[str]:
    """Viterbi: the most probable words whose concatenation is ``name``; an unknown word costs by its length, as if seen less than once."""
    logs = {w: math.log(p) for w, p in known.items()}
    ending: dict[int, list[int]] = {}  # words over STUB letters: their starts by end
    for w in logs:
        if len(w) > STUB:
            a = name.find(w)
            while a >= 0:
                ending.setdefault(a + len(w), []).append(a)
                a = name.find(w, a + 1)
    first, letter = -math.log(total), -math.log(10.0)
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    run, run_start = -math.inf, 0  # the best cut that ends in an unknown word here, and where that begins
    for b in range(1, len(name) + 1):
        if best[b - 1] + first >= run:
            run, run_start = best[b - 1] + first, b - 1
        run += letter
        best[b], back[b] = run, run_start
        for a in [*ending.get(b, ()), *range(max(0, b - STUB), b)]:
            p = logs.get(name[a:b])
            if p is not None and best[a] + p > best[b]:
                best[b], back[b] = best[a] + p, a
    out, b = [], len(name)
    while b:
        out.append(name[back[b] : b])
        b = back[b]
    return out[::-1]


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, host_tokens): each name of each distinct host in words."""
    names = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("at", "name")).where("name <> ''")
    distinct = written(names.select("name").distinct(), "names")
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + 1.0
    parts = distinct.mapInArrow(substrings, "name string, word string")
    longer = counts.where(F.length("word") > STUB).select(F.left("word", F.lit(STUB)).alias("stub"), F.col("word").alias("whole"), "n")
    met = parts.join(counts, "word").select("name", "word", "n").unionByName(parts.where(F.length("word") == STUB).join(longer, F.col("word") == F.col("stub")).select("name", F.col("whole").alias("word"), "n"))
    met = met.groupBy("name").agg(F.collect_set(F.struct("word", "n")).alias("known"))  # what one name holds
    kept = distinct.join(met, "name", "left").select("name", "known.word", "known.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [best_cut(name, {w: k / total for w, k in zip(word or (), n or (), strict=True)}, total) for name, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    words = written(kept.mapInArrow(run, "name string, words array<string>"), "cut-names")
    made = joined(names, words, "name", "inner").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
    return made.select("host", F.flatten(F.col("w.words")).alias("host_tokens"))


def path_tokens(path: Column) -> Column:
    """Words of the path, lower-cased; a number is its count of digits."""
    found = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.when(w.rlike(r"^[0-9]+$"), F.concat(F.lit("/#"), F.length(w).cast("string"))).otherwise(F.concat(F.lit("/"), w)))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, score): score is the log-odds to allow where no rule fits, else null."""
    ruled = parts(pages, id_col, url_col).withColumns({"rule": first_rule(rules, lambda r: r.text), "ruled": first_rule(rules, lambda r: r.verdict)})
    ruled = written(ruled.withColumn("row", F.monotonically_increasing_id()), "ruled")
    counts = written(word_counts(pages, html_col), "words")
    hosts = written(host_tokens(ruled.select("host").distinct(), counts), "hosts")
    shapes = joined(ruled.select("row", "host", "ruled", path_tokens(F.col("path")).alias("path_tokens")), hosts, "host")
    kind = F.concat(F.coalesce("host_tokens", F.array().cast("array<string>")), "path_tokens")
    tokens = written(shapes.select("row", "ruled", kind.alias("tokens")), "tokens")
    n = tokens.where("ruled is not null").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b")).first()
    if not n.a or not n.b:
        return ruled.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    seen = written(
        tokens.where("ruled is not null").select("ruled", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b")), "token-counts"
    )
    sums = seen.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("v")).first()
    odds = F.log((F.col("a") + 1.0) / ((sums.a or 0) + sums.v + 1.0)) - F.log((F.col("b") + 1.0) / ((sums.b or 0) + sums.v + 1.0))
    unseen = math.log(((sums.b or 0) + sums.v + 1.0) / ((sums.a or 0) + sums.v + 1.0))
    model = seen.select("token", odds.alias("odds"))
    parted = joined(tokens.where("ruled is null").select("row", F.explode("tokens").alias("token")), model, "token")
    scored = parted.groupBy("row").agg(F.sum(F.coalesce("odds", F.lit(unseen))).alias("sum"))
    prior = math.log(n.a / n.b)
    score = F.when(F.col("ruled").isNull(), F.coalesce("sum", F.lit(0.0)) + prior)
    out = ruled.join(scored, "row", "left").withColumn("score", score)
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0, "allow").otherwise("block")).alias("verdict"), "score")
