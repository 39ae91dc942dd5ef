import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lumenqc.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(totals, share=1.5, cap=2, weights=(3, 1, 2)):
    """The contract's targets, by plain resharing."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, got = share * sum(totals.values()), set(names), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * rate >= cap * totals[s]}
        if not full:
            return got | {s: weight[s] * rate for s in free}
        got |= {s: float(cap * totals[s]) for s in full}
        left -= sum(cap * totals[s] for s in full)
        free -= full
    return got


def tilt(sizes, target, cap=2):
    """The source's tilt by plain bisection."""
    x, low, high = sizes / sizes.mean(), -500.0, 500.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if (sizes * np.minimum(cap, np.exp(np.minimum(mid * x, 5)))).sum() < target else (low, mid)
    return (low + high) / 2


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("a", 900), ("b", 300), ("c", 30), (None, 200), ("ä", 60)):
        rows += [(len(rows) + k, s, " ".join(["w"] * min(4000, int(rng.paretovariate(0.9) * 20)))) for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    return rows, mixing.mix(table).collect(), table


def test_targets_and_bounds(mixed):
    rows, got, _ = mixed
    totals = defaultdict(int)
    for _, s, t in rows:
        totals[s] += len(WORD.findall(t))
    want = shared(totals)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == totals[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(60, 0.01 * want[s]), s


def test_rates_are_the_exponential_tilt(mixed):
    rows, got, _ = mixed
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    tilted = 0
    for of in by.values():
        sizes, target = np.array([r.size for r in of], float), of[0].target
        if target >= 2 * sizes.sum():
            assert {r.rate for r in of if r.size} == {2.0}
            continue
        want = np.minimum(2, np.exp(np.minimum(tilt(sizes, target) * sizes / sizes.mean(), 5)))
        assert np.allclose([r.rate for r in of], want, atol=1e-4)
        tilted += 1
        # copies follow the rates: over any range of sizes they differ by what was put right only
        order = np.argsort(sizes, kind="stable")
        assert np.abs(np.cumsum(want[order]) - np.cumsum(np.array([r.copies for r in of])[order])).max() < 12
    assert tilted >= 2


def test_reruns_agree(mixed):
    _, got, table = mixed
    again = mixing.mix(table.repartition(3, "text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_odd_rows(spark, docs, none):
    assert mixing.mix(none.withColumnRenamed("start", "source")).count() == 0
    got = mixing.mix(docs.withColumnRenamed("start", "source")).collect()
    assert len(got) == 11
    assert {r["size"] for r in got if r.doc_id in (2, 3, 4)} == {0} and all(r.taken == 0 for r in got if r.doc_id in (2, 3, 4))
    assert abs(sum(r.taken for r in got) - got[0].target) <= 15_000 and all(r.taken <= 2 * r["size"] for r in got)
    # (a text of 30,000 of 30,068 words comes once or twice: no sum of whole copies is nearer)
    empty = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0, 0, 0.0, 0)] * 2


def test_a_hot_group_of_copies(spark):
    """Thousands of rows of one size: the copies are exact, without gathering them."""
    rows = [(i, "hot", "one two three") for i in range(5000)] + [(5000 + i, f"s{i}", "w " * (50 + i)) for i in range(9)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)).collect()
    hot = [r for r in got if r.source == "hot"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 3
    assert len({r.copies for r in hot}) <= 2


def test_no_python_in_the_plan(spark, mixed):
    plan = mixing.mix(mixed[2])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
