import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqc.operators import analytics, batch, scale


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([0.0, 1.0, 1.0, 1.0, rng.random() * 50, None if i % 11 == 0 else -2.5])) for i in range(900)]
    return spark.createDataFrame([*made, (900, "empty", None), (901, "one", 4.0)], "n long, g string, x double").cache()


def groups(rows):
    out = {}
    for r in rows.orderBy("n").collect():
        out.setdefault(r.g, []).append(r)
    return out


def test_places(rows):
    got = {r.n: (r.place, r.of) for r in scale.numbered(rows, "g", ["n"], parts=8).collect()}
    assert got == {r.n: (k, len(some)) for some in groups(rows).values() for k, r in enumerate(some, 1)}
    ties = sorted((r.place for r in scale.numbered(rows.where("g = 'hot'"), "g", ["x", "n"], parts=5).collect()))
    assert ties == list(range(1, len(ties) + 1))


def test_quantiles(rows):
    found = {r.g: r for r in analytics.summary(rows, "g", "x").collect()}
    profile = {r.g: r for r in analytics.stage_profile(rows, "g", "x").collect()}
    for g, some in groups(rows).items():
        x = [r.x for r in some if r.x is not None]
        assert found[g].n == len(x)
        assert found[g].median == (pytest.approx(np.median(x)) if x else None)
        assert profile[g].p95 == (pytest.approx(np.percentile(x, 95)) if x else None)
        if x:
            assert profile[g].p95_nearest == sorted(x)[min(len(x), max(1, round(0.95 * (len(x) - 1)) + 1)) - 1]


def test_rows_before_cross_blocks(rows):
    placed = scale.numbered(rows.where("g is not null"), "g", ["n"], parts=6)
    got = {r.n: (r.s, r.c) for r in scale.last_rows(placed, "g", 5, lambda w: {"s": F.sum("n").over(w), "c": F.count("n").over(w)}, block=7).collect()}
    for g, some in groups(rows).items():
        if g is not None:
            for k, r in enumerate(some):
                last = [x.n for x in some[max(0, k - 4) : k + 1]]
                assert got[r.n] == (sum(last), len(last))


def test_samples_progress_and_bench(rows, spark):
    hot = [r.n for r in groups(rows)["hot"]]
    step = len(hot) // 9
    assert sorted(r.n for r in batch.every_kth(rows.where("g = 'hot'"), "g", ["n"], 9).collect()) == hot[::step][:9]
    assert {r.n: r.percent for r in batch.progress(rows.where("g = 'hot'"), "g", ["n"]).collect()}[hot[-1]] == 100.0
    one = analytics.bench_summary(rows, "x", F.col("x") > 1, "g", ["hot", "one"]).first()
    x = [r.x for some in groups(rows).values() for r in some if r.x is not None]
    assert (one.n, one.n_hot, one.n_one) == (902, len(hot), 1)
    assert (one.p50, one.p95) == (pytest.approx(np.median(x)), pytest.approx(np.percentile(x, 95)))
    assert scale.numbered(rows.where("false"), "g", ["n"]).count() == 0


def test_many_counts_are_joined_by_group_and_range(rows, spark, monkeypatch):
    want = {r.n: (r.place, r.of) for r in scale.numbered(rows, "g", ["n"], parts=4).collect()}
    monkeypatch.setattr(scale, "FEW_ROWS", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = scale.numbered(rows, "g", ["n"], parts=4)
        assert {r.n: (r.place, r.of) for r in placed.collect()} == want
        plan = placed._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and all("shiftright" in line or "part#" in line for line in dealt), dealt  # never by group alone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
