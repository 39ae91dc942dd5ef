import random
import re
from collections import Counter

from lumenqc.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["a", "bb", "ñ", "#", "$x", "\n", " ", "  ", "\t", "a b a b a b", "\na b\n", "\x0b", "\xa0", "😀"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(40)))) for i in range(400)] + [(400, "a b c " * 5000)]
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in q.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(9999)) for _ in range(80)]
        docs.append((i, " ".join(w + "$#" * (bad and rng.random() < 0.4) for w in words)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (0, None), (5, 1), (5, 1)], "doc_id long, quality int")


def test_learned_rules_hold_out(spark):
    docs, table, labels = labelled(spark)
    rows = q.judge(table, labels).collect()
    assert len(rows) == len(docs)
    wrong = [r.doc_id for r in rows if r.kept != (r.doc_id % 4 != 0)]
    assert len(wrong) <= 0.02 * len(rows)
    assert all((r.rule is None) == r.kept for r in rows if not r.base_failed)


def test_without_bad_labels_only_the_base_rule_decides(spark, docs, none):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = q.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.kept != r.base_failed for r in rows)
    assert {r.doc_id for r in rows if r.kept} == set()
    assert q.judge(none, labels).count() == 0


def test_plan_is_native(spark):
    _, table, labels = labelled(spark)
    plan = q.judge(table, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
