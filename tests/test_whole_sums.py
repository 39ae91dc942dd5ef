"""Sums of doubles rounded down: as added in the order of rows, however these are dealt out."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenqc import queries
from lumenqc.operators import batch, scale

KIND = "event_id long, user_id long, value double"


def drawn(n, users, seed=5):
    """Cents, so that one sum in a hundred is whole and its last bits decide."""
    rng = random.Random(seed)
    return [(i, rng.choice([rng.randrange(users), 7]) if i % 10 == 0 else rng.randrange(users), rng.randrange(30_000) / 100) for i in range(n)]


def in_order(rows):
    sums = {}
    for _, user, value in sorted(rows, key=lambda r: r[0]):
        sums[user] = sums.get(user, 0.0) + value
    return {user: math.floor(s) for user, s in sums.items()}


def test_duration_text_equals_sql_when_users_cross_files(spark, tmp_path):
    rows = drawn(30_000, 500)
    spark.createDataFrame(rows, KIND).repartition(7, F.col("event_id") % 7).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    want = dict(db.execute(queries.ORACLES["duration_text"]).fetchall())
    got = {r.user_id: r.spent for r in queries.duration_text(spark, str(tmp_path)).collect()}
    assert len(want) == 500 and got == want


@pytest.mark.parametrize("few", [scale.FEW_ROWS, -1])
def test_whole_sums(spark, monkeypatch, few):
    monkeypatch.setattr(scale, "FEW_ROWS", few)
    rows = drawn(20_000, 300) + [(20_000 + i, None, 0.1) for i in range(10)] + [(20_010 + i, 900 + i % 2, -0.1) for i in range(40)]
    nulls = [(30_000, 950, None), (30_001, 7, None), (30_002, None, None)]
    table = spark.createDataFrame(random.Random(1).sample(rows + nulls, len(rows) + 3), KIND).repartition(6)
    got = {r.user_id: r.whole for r in batch.whole_sums(table, "user_id", "value", ["event_id"]).collect()}
    assert got == in_order(rows) | {950: None}
    assert got[None] == 0  # ten times 0.1 is 0.9999999999999999
    exact = {}
    for _, user, value in rows:
        exact.setdefault(user, []).append(value)
    assert any(math.floor(math.fsum(x)) != got[user] for user, x in exact.items())


def test_equal_order_is_told_apart_by_value(spark):
    rows = [(0, 1, v) for v in (0.7, 0.1, 0.2)]
    want = math.floor(0.1 + 0.2 + 0.7)
    for k in range(3):
        table = spark.createDataFrame(rows[k:] + rows[:k], KIND).repartition(3)
        assert [tuple(r) for r in batch.whole_sums(table, "user_id", "value", ["event_id"]).collect()] == [(1, want)]
    assert batch.whole_sums(table.where("false"), "user_id", "value", ["event_id"]).count() == 0
