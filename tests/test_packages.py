import os

import pytest
from pyspark.sql import functions as F

from lumenqc.operators import packages as p


def rows(spark, data):
    return spark.createDataFrame(data, p.ROWS)


def test_packages_are_files_and_manifest_rows(spark, tmp_path):
    (tmp_path / "o.jpg").write_bytes(b"original")
    out = f"file://{tmp_path}/out"
    original = f"file://{tmp_path}/o.jpg"
    p.write_packages(rows(spark, [("a", b"A", original, "{}"), ("b", b"B", f"file://{tmp_path}/none.jpg", "{}"), ("c", None, original, "{}"), ("d", b"D", None, None), (None, b"x", None, None), ("a", b"later", original, "{~}")]), out)
    got = {r.review_id: r for r in p.manifest(spark, out).collect()}
    assert set(got) == {"a", "b", "d"}
    read = lambda path: open(path.removeprefix("file://"), "rb").read()
    assert read(got["a"].edited_path) == b"A" and read(got["a"].original_path) == b"original" and got["a"].original_error is None
    assert read(got["b"].edited_path) == b"B" and got["b"].original_path is None and "FileNotFoundError" in got["b"].original_error
    assert [(r.review_id, r.error) for r in p.failures(spark, out).collect()] == [("c", "ValueError: no edited picture")]
    # the first write wins, and what failed may come again
    p.write_packages(rows(spark, [("a", b"other", None, None), ("c", b"C", original, "{}")]), out)
    again = {r.review_id: r for r in p.manifest(spark, out).collect()}
    assert again["a"].edited_path == got["a"].edited_path and read(again["c"].edited_path) == b"C"
    assert os.listdir(tmp_path / "out/_staging") == []


def test_a_job_that_fails_leaves_nothing_visible(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bad = rows(spark, [(str(k), b"x", None, None) for k in range(40)]).repartition(4)
    bad = bad.withColumn("manifest", F.when(F.col("review_id") == "7", F.raise_error(F.lit("lost")).cast("string")).otherwise("{}"))
    with pytest.raises(Exception, match="lost"):
        p.write_packages(bad, out)
    assert p.manifest(spark, out).count() == 0
    assert not os.path.isdir(tmp_path / "out/packages")


def test_nothing_to_write(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    p.write_packages(rows(spark, []), out)
    assert p.manifest(spark, out).count() == 0 and p.failures(spark, out).count() == 0
