"""Quality rules: text statistics and a learned decision list, all in Spark expressions.

Sequential covering learns from labelled statistics which conjunctions of thresholds mark bad documents.
Each rule grows condition by condition by information gain on two thirds of the labelled rows, is pruned on
the rest, and is dropped, which ends the list, if it is wrong there more often than right.  Counts come from
one small aggregation a step over the labelled statistics; the driver sees features x bins counts only,
however many rows there are.  The list is emitted as one ordered conditional expression.

Special cases: a null text has no words; texts without words have statistics of zero and fail the base rule;
rows without labels are judged like others; null or repeated labels are ignored or count once each; without
bad labelled rows the list is empty and only the base rule decides; of conditions of equal gain the first by feature and
threshold is taken; very long texts are counted whole, by array functions over their words; repeated rows repeat their
result; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.llm.common import let, written

SPACE = r"[\x20\x09-\x0D]+"
#: Name: expression over the base statistics.  Ratios are per word or per character, so length alone decides little.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words stand in windows of ``size`` words that occur more than once in ``words``.

    Windows are sorted with their places; those equal to a neighbour are repeated.  In order of place each
    adds the words that the one before didn't cover.
    """
    places = F.sequence(F.lit(0), F.size(words) - size)
    windows = F.when(
        F.size(words) >= size,
        F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *(F.get(words, i + k) for k in range(size))).alias("w"), i.alias("i")))),
    )
    starts = let(
        windows,
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"])),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-size).alias("at")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(size), x - a["at"])).alias("n"), x.alias("at")),
        lambda a: a["n"],
    )
    return F.coalesce(covered, F.lit(0)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts and those that the features use."""
    only = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]+", "")).cast("long")
    split = docs.select(
        F.col(id_col),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select(
        id_col,
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return split.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        only("A-Z").alias("n_upper"),
        only("!?.,;:").alias("n_marks"),
        only("0-9").alias("n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of a condition that keeps p of p0 bad and n of n0 good rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, id_col: str = "doc_id", max_rules: int = 8, max_conditions: int = 3, bins: int = 24, least_bad: int = 8) -> list[Rule]:
    """Rules for ``labelled`` (statistics and ``bad``), by sequential covering.

    max_rules, max_conditions and bins (thresholds a feature, at even quantiles) bound the list and the work;
    least_bad is how many bad rows a rule must cover.
    """
    names = list(FEATURES)
    values = labelled.select(id_col, "bad", *(F.expr(FEATURES[n]).alias(n) for n in names))
    quantiles = values.agg(*(F.percentile_approx(n, [i / bins for i in range(1, bins)], 2000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(quantiles[n] or [])) for n in names}
    place = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts[n])), lambda t: t < F.col(n))) if cuts[n] else F.lit(0)
    rows = written(values.select("bad", (F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).alias("holdout"), F.array(*map(place, names)).alias("bins")), "labelled-bins")
    spot = {n: i for i, n in enumerate(names)}

    def test(c: Condition) -> Column:  # the same as c.column(), by bin
        b, k = F.get(F.col("bins"), F.lit(spot[c.feature])), cuts[c.feature].index(c.threshold)
        return b > k if c.above else b <= k

    def both(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & test(c)
        return out

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts: dict[str, dict[int, list[int]]] = {n: {} for n in names}
            at = rows.where(left & ~F.col("holdout") & both(rule)).select("bad", F.posexplode("bins").alias("f", "b"))
            for r in at.groupBy("f", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect():  # features x bins rows at most
                counts[names[r.f]][r.b] = [r.p, r.n]
            p0, n0 = (sum(x[i] for x in counts[names[0]].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best, most = None, 1e-9
            for name in names:
                p = n = 0
                for k, t in enumerate(cuts[name]):
                    p, n = p + counts[name].get(k, (0, 0))[0], n + counts[name].get(k, (0, 0))[1]
                    for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                        if x >= least_bad and (g := gain(x, y, p0, n0)) > most:
                            best, most = Condition(name, above, t), g
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        held = rows.where(left & F.col("holdout")).agg(*(F.count_if(both(x) & (F.col("bad") == bad)).alias(f"{k}{i}") for i, x in enumerate(prefixes) for k, bad in (("p", True), ("n", False)))).first()
        worth = [((held[f"p{i}"] - held[f"n{i}"]) / max(1, held[f"p{i}"] + held[f"n{i}"]), -i) for i in range(len(prefixes))]
        value, i = max(worth)
        if value <= 0:
            break
        rules.append(prefixes[-i])
        left = left & ~both(rules[-1])
    return rules


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """Statistics, base_failed, the rule that drops the document (else null) and kept."""
    counted = written(statistics(docs, id_col, text_col), "statistics")
    labelled = counted.join(labels.where(F.col(quality_col).isNotNull()).select(id_col, (F.col(quality_col) == 0).alias("bad")).distinct(), id_col)
    rules = learn(labelled, id_col)
    return counted.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules).isNull()).alias("kept"),
        verdict(rules).alias("rule"),
    )
