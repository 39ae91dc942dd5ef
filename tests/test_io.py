import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenqc.operators import batch, sinks
from lumenqc.sources import readers
from lumenqc.streaming import resume


def png(path, width, height, rgb):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    for d in ("in", "in/sub", "in/Review"):
        (tmp_path / d).mkdir()
    png(tmp_path / "in/B.PNG", 3, 2, (10, 20, 30))
    png(tmp_path / "in/sub/a.png", 1, 1, (200, 100, 50))
    png(tmp_path / "in/Review/c.png", 1, 1, (0, 0, 0))
    (tmp_path / "in/broken.jpg").write_bytes(b"not a picture")
    (tmp_path / "in/notes.txt").write_text("x")
    return tmp_path / "in"


def test_listing_and_decoding(spark, folder):
    files = [r.path.rsplit("/", 1)[-1] for r in readers.listing(spark, str(folder)).collect()]
    assert files == ["B.PNG", "broken.jpg", "a.png"]
    assert [r.path.rsplit("/", 1)[-1] for r in readers.listing(spark, str(folder), recursive=False).collect()] == ["B.PNG", "broken.jpg"]
    ids = [r.id for r in readers.listing(spark, str(folder)).collect()]
    assert ids[0].startswith("B__")
    assert len(set(ids)) == 3
    pictures = readers.pictures(spark, str(folder))
    assert {r.bucket for r in pictures.where("origin like '%broken%'").collect()} == {"failed"}
    pixels = readers.pixels(pictures).where("origin like '%B.PNG'").collect()
    assert len(pixels) == 6
    assert {(p.r, p.g, p.b) for p in pixels} == {(10, 20, 30)}


def test_text_readers(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/1.json").write_text(json.dumps({"review_id": "a", "final_score": 80.5}, indent=1))
    (tmp_path / "r/2.json").write_text("{broken")
    rows = readers.reports(spark, str(tmp_path / "r"), "review_id string, final_score double").where("review_id is not null").collect()
    assert [(r.review_id, r.final_score) for r in rows] == [("a", 80.5)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").where("a is not null").collect()) == [1, 2]
    (tmp_path / "m.csv").write_text("review_id,original_filename\n a ,x\n,y\na,z\n")
    assert [r.review_id for r in readers.manifest_ids(spark, str(tmp_path / "m.csv")).collect()] == ["a"]
    (tmp_path / "c.tsv").write_text("# comment\nmesh\tIMG_1\tnote\nonly\n")
    assert [tuple(r) for r in readers.cases(spark, str(tmp_path / "c.tsv")).collect()] == [("mesh", "IMG_1", "note")]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    for _ in range(2):
        sinks.append_once(rows, out, "id")
    sinks.append_once(spark.createDataFrame([("a", 9), ("c", 4)], "id string, n int"), out, "id")
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "n").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    versions = str(tmp_path / "versions")
    for n in (1, 2):
        sinks.append_version(spark.createDataFrame([("a", n)], "id string, n int"), versions)
    assert [tuple(r) for r in sinks.latest(spark, versions, rows.schema, "id", "n").collect()] == [("a", 2)]
    assert sinks.latest(spark, str(tmp_path / "none"), rows.schema, "id", "n").count() == 0
    report = spark.createDataFrame([("a", ["x", "y"], 1.5)], "id string, tags array<string>, s double")
    sinks.append_report(report, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().tags == "x;y"
    sinks.append_failures(spark.createDataFrame([("f.jpg", "bad")], "filename string, reason string"), str(tmp_path / "fail"))
    assert spark.read.text(str(tmp_path / "fail")).first().value == "f.jpg\tbad"
    made = sinks.manifest(report.select("id", F.col("tags").alias("reasons"), F.lit(True).alias("fallback"), F.lit(1.234).alias("seconds"), F.struct("s").alias("metrics"))).first()
    assert (made.review_reason, made.fallback_used, made.processing_time) == ("x;y", "yes", "1.23")


def test_stream_resumes(spark, tmp_path):
    source = tmp_path / "in"
    write = lambda lo, hi: spark.range(lo, hi).selectExpr("id as event_id", "cast(id as double) value", "concat('k', id % 2) kind").coalesce(1).write.mode("append").parquet(str(source))
    write(0, 50)
    schema = "event_id long, value double, kind string"
    go = lambda state: resume.run_once(resume.arriving(spark, str(source), schema), lambda d: d, str(tmp_path / "out"), str(tmp_path / state), "event_id")
    go("s1")
    write(40, 80)
    go("s1")
    go("s2")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).selectExpr("id as event_id").coalesce(1).write.mode("append").parquet(source)
    one = lambda: resume.arriving(spark, source, "event_id long", at_once=1)
    took = resume.run_once(one(), lambda d: d, out, state, "event_id", stop=lambda n: n >= 10)
    assert 10 <= took <= 60
    rest = resume.run_once(one(), lambda d: d, out, state, "event_id")
    assert rest >= 60 - took
    assert spark.read.parquet(out).select("event_id").distinct().count() == spark.read.parquet(out).count() == 60


def test_a_repeated_batch_replaces_what_it_left(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 3)], "id string, n int")
    sinks.append_once(rows.where("id = 'a'"), out, "id", "x-0")  # cut off half-way
    sinks.append_once(rows, out, "id", "x-0")
    sinks.append_once(rows, out, "id", "x-1")
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "n", "part").collect())) == [("a", 1, "x-0"), ("b", 3, "x-0")]


def test_logs_reports_and_soft_sinks(spark, tmp_path):
    log, view = str(tmp_path / "log"), str(tmp_path / "view")
    sinks.append_log(spark.createDataFrame([("a", 1.5, "more")], "id string, s double, other string"), log)
    sinks.append_log(spark.createDataFrame([("b", None)], "id string, s double"), log)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(log)
    sinks.log_view(spark, log, view, "id string, s double")
    assert sorted((r.id, r.s) for r in spark.read.option("header", "true").csv(view).collect()) == [("a", "1.5"), ("b", None)]
    rows = spark.createDataFrame([(1,), (2,)], "n int")
    sinks.harness_report(rows, rows.agg(F.sum("n").alias("total")), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/summary")).first().total == 3
    assert sinks.attempted(sinks.append_log, rows, log) is None
    assert "AnalysisException" in sinks.attempted(sinks.append_failures, rows, log)


def test_rolling_means_in_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(1, 101).selectExpr("id", "cast(id as double) value", "'k' kind").coalesce(1).write.parquet(str(source))
    stream = resume.rolling_means(resume.arriving(spark, str(source), "id long, value double, kind string"), "kind", "value")
    q = stream.writeStream.format("memory").queryName("rolling").outputMode("update").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("rolling").first()
    assert (row.n, row["mean"]) == (100, sum(range(61, 101)) / 40)


def test_alarm_windows(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(0, 120).selectExpr("timestamp_seconds(id * 60) as ts", "id < 60 as bad").coalesce(1).write.parquet(str(source))
    stream = resume.watch_alarms(resume.arriving(spark, str(source), "ts timestamp, bad boolean"), "ts", F.col("bad"), ~F.col("bad"))
    q = stream.writeStream.format("memory").queryName("alarms").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.window.start.minute, r.n) for r in spark.table("alarms").collect()] == [(0, 60)]


def test_ladder_and_anti_join_edge_cases(spark):
    none = spark.createDataFrame([], "key long, fp long, done boolean")
    items = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "key long, fp long")
    assert batch.pending(items, none).count() == 3
    cache = spark.createDataFrame([(1, 1, True), (2, 9, True), (2, 2, False), (3, None, True)], "key long, fp long, done boolean")
    assert sorted(r.key for r in batch.pending(items, cache).collect()) == [2, 3]
