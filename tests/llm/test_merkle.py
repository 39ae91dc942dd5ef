import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from lumenqc.llm import merkle

UPPER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root, and a list of (before, after) for each node."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, place, strict=True):
            first = k - k % 16
            p.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 16])))
        nodes, place = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [k // 16 for k in place]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = h(*map(field, r))
        altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        claim = h(*map(field, (*r[:4], r[4].translate(UPPER) if altered and r[4] is not None else r[4])))
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, claim))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = tree([made[g][0] for g in names])
    for g, top in zip(names, above, strict=True):
        for (known, i, leaf, claim), path in zip(sorted(groups[g]), made[g][1], strict=True):
            proof, node = path + top, claim
            for before, after in proof:
                node = h(before, node, after)
            yield (i if known else None, leaf, made[g][0], root, h("".join(b + a for b, a in proof)), node, node == root)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    docs = docs.select(*docs.columns, F.lit(1).alias("rank"), F.lit("x").alias("grp"), F.lit("y").alias("leaf"))
    key = lambda r: str(tuple(r))
    got = sorted((tuple(r) for r in merkle.audit(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "b", "ü", None]), rng.choice(["en", None]), rng.randrange(99), rng.choice([None, "", "Wörd " * rng.randrange(9), "low"])) for i in range(700)]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    long = "Ab " * 200_000
    check(spark, [(None, None, None, None, None), (5, "s", "en", 1, long), (5, "s", "en", 1, long), (5, "s", "de", 1, ""), (7, "one", None, None, "Alone")] + [(9, "t", "x", 0, "same")] * 40)
    check(spark, [(3, "only", "en", 1, "A")])


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.audit(docs).count() == 0


def test_rounds_of_the_exchange(spark, monkeypatch):
    """Small fanouts and ragged last runs: every count of leaves gives the paths of the plain tree."""
    monkeypatch.setattr(merkle, "FANOUT", 3)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "LISTED", 2)

    def plain(nodes):
        paths, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, k in zip(paths, place, strict=True):
                first = k - k % 3
                p.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 3])))
            nodes, place = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [k // 3 for k in place]
        return nodes[0], paths

    counts = {"a": 1, "b": 3, "c": 4, "d": 28, "e": 82, "f": 55, "g": 100}
    rows = [(g, i, h(g, str(i))) for g, n in counts.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "group string, key int, leaf string").withColumn("item", F.struct("group", "key"))
    got = {(r.item.group, r.item.key): (r.subroot, [tuple(s) for s in r.proof], r.root) for r in merkle.manifest(leaves).collect()}
    assert len(got) == len(rows)
    trees = {g: plain([h(g, str(i)) for i in range(n)]) for g, n in counts.items()}
    root, above = plain([trees[g][0] for g in counts])
    for k, (g, n) in enumerate(counts.items()):
        for i in range(n):
            assert got[g, i] == (trees[g][0], trees[g][1][i] + above[k], root), (g, i)


def test_proof_shows_change(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "Upper case") for i in range(300)], "doc_id long, source string, lang string, n_chars int, text string")
    got = merkle.audit(docs).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
