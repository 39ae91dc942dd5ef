import random
import re
import time

from lumenqc.llm import decontam as d


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, window=20, identity=0.8):
    """Every alignment that shares a seed, by its definition; of items under 16 words every alignment."""
    found = set()
    for i, t in docs:
        for k, b in items:
            x, y = words(t), words(b)
            for shift in range(-len(y) + 1, len(x)):
                seeded = len(y) < 16 or any(
                    all(0 <= shift + p + o < len(x) and x[shift + p + o] == y[p + o] for o, c in enumerate(m) if c == "1")
                    for m in d.MASKS for p in range(len(y) - len(m) + 1) if 0 <= shift + p and shift + p + len(m) <= len(x)
                )
                hit = [0 <= shift + p < len(x) and x[shift + p] == w for p, w in enumerate(y)]
                width = min(window, len(y))
                if seeded and max(sum(hit[p : p + width]) for p in range(len(y) - width + 1)) >= identity * width:
                    found.add((i, k))
    return found


def cases():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, prose(n)) for k, n in enumerate([1, 2, 4, 5, 6, 7, 9, 11, 13, 15, 16, 20, 33, 49])]
    docs = []
    for i in range(60):
        text, (_, item) = prose(rng.randrange(5, 120)), rng.choice(items)
        put = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else rng.choice(vocabulary) for w in item]
        docs.append((i, ", ".join(text + (put[: rng.randrange(1, len(put) + 1)] if i % 3 else [])).upper()))
    return docs, [(k, " ".join(w)) for k, w in items]


def test_overlaps_against_brute_force(spark):
    docs, items = cases()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert want
    for rows in (500_000, 1):  # seeds broadcast, and shuffled
        got = {(r.doc_id, r.item_id) for r in d.overlaps(left, right, broadcast_rows=rows).collect()}
        assert got == want
    kept = {r.doc_id for r in d.decontaminate(left, right).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_substitutions_are_tolerated_and_clean_texts_left(spark):
    item = [f"a{i}" for i in range(30)]
    near = [w if i % 7 else "other" for i, w in enumerate(item)]
    far = [w if i % 2 else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(["x"] * 9 + near)), (2, " ".join(far)), (3, " ".join(item[:6]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "not here")], "item_id long, text string")
    assert [r.doc_id for r in d.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()] == [1]


def test_odd_rows(spark, docs, none):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the cat")], "item_id long, text string")
    rows = d.overlaps(docs, bench).collect()
    assert {r.doc_id for r in rows} == {1, 7}
    assert len(rows) == 2
    assert d.overlaps(none, bench).count() == 0
    assert d.overlaps(docs, bench.where("false")).count() == 0
    assert {r.doc_id for r in d.decontaminate(docs, bench).collect()} == {2, 3, 4, 5, 6, 8, 9, None}


def test_sql_form_agrees_on_short_items(spark, tmp_path):
    import duckdb

    from lumenqc.llm.entry import OP1_SQL

    docs, items = cases()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", left.toPandas())
    con.register("benchmark", right.toPandas())
    order = "doc_id, item_id, matched_words, n_item_words, round(identity, 9), first_word"
    want = con.sql(f"SELECT {order} FROM ({OP1_SQL}) ORDER BY ALL").fetchall()
    got = sorted(map(tuple, d.overlaps(left, right).selectExpr(*order.split(", ", 4)[:4], "round(identity, 9)", "first_word").collect()))
    assert got == want


def test_long_copies_and_repeated_words_are_verified_once(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))
    docs = spark.createDataFrame([(1, f"before {long} after"), (2, "the " * 2000), (3, "nothing of these")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "the " * 2000)], "item_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id): (r.matched_words, r.identity, r.first_word) for r in d.overlaps(docs, items).collect()}
    assert got == {(1, 1): (4000, 1.0, 1), (2, 2): (2000, 1.0, 0)}
    assert time.time() - began < 60
