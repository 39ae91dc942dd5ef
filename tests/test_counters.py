import pytest
from pyspark.sql import functions as F

from lumenqc.streaming import counters, resume


def test_counters_outlive_restarts_and_many_batches(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")

    def go():
        progress = counters.Progress(spark, "counted", state, "seen")
        spark.streams.addListener(progress)
        stream = resume.arriving(spark, source, "id long", at_once=1).observe("seen", F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
        query = stream.writeStream.queryName("counted").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        got = counters.followed(query, progress)
        spark.streams.removeListener(progress)
        return got

    try:
        spark.range(0, 120).repartition(12).write.mode("append").parquet(source)
        first = go()
        assert (first["n"], first["total"], first["batches"]) == (120, sum(range(120)), 12)  # more batches than Spark remembers
        spark.range(120, 150).repartition(3).write.mode("append").parquet(source)
        second = go()
        assert (second["n"], second["total"], second["batches"]) == (150, sum(range(150)), 15)
        assert go() == second
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_a_repeated_batch_counts_once(spark, tmp_path):
    totals = counters.Totals(spark, str(tmp_path))
    assert totals.upto() == {}
    for batch, n in ((0, 5), (1, 7), (1, 7), (2, 1)):
        totals.add(batch, {"n": n})
    assert totals.upto() == {"n": 13} and totals.batches() == [1, 2]


@pytest.mark.parametrize("at_once", [1, 64])
def test_rolling_state(spark, tmp_path, at_once):
    source = str(tmp_path / "in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counters.ROCKS)
    try:
        for k in range(4):
            spark.range(k * 30, k * 30 + 30).selectExpr("id", "case when id % 10 = 0 then -1 else cast(id as double) end as seconds", "concat('k', id % 2) as kind").coalesce(1).write.mode("append").parquet(source)
        stream = resume.arriving(spark, source, "id long, seconds double, kind string", at_once=at_once)
        made = counters.rolling_state(stream, "kind", "seconds", size=7)
        query = made.writeStream.format("memory").queryName(f"rolled{at_once}").outputMode("update").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        query.awaitTermination()
        for key in (0, 1):
            values = [i for i in range(120) if i % 2 == key and i % 10 and i > 0]
            last = spark.table(f"rolled{at_once}").where(f"key = 'k{key}'").orderBy(F.desc("n")).first()
            # files may be taken up in any order, so one at a time fixes the numbers only
            assert last.n == len(values)
            if at_once == 64:
                assert 0 < last["mean"] < 120
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
