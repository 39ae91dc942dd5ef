import itertools
import random

import xxhash

from lumenqc.llm import simhash as s


def plain(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, values):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(zip(ids, values, strict=True), 2):
        if (x ^ y).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Abc", "de", "fgh", "é", "x", "yy", "zzz", "Q1", "ñ", "tt"]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 8, 200]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
                texts.append("\t".join(words))
    rows = [(i, t) for i, t in enumerate([*texts, None, "", *texts[:9]])]
    got = {r.doc_id: r for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [plain(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{x:016x}" for x in prints]
    want = smallest([i for i, _ in rows], prints)
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_of_close_fingerprints(spark):
    rng = random.Random(9)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(6):
            values.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    for segments in (2, 4):
        got = {(r.a, r.b) for r in s.links(spark.createDataFrame(signed, "fp long"), 3, segments).collect()}
        want = {(min(a, b), max(a, b)) for (a,), (b,) in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
        assert got == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.root for r in s.components(edges).collect()} == {0}


def test_odd_rows(docs, none):
    rows = s.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    assert s.near_duplicates(none).count() == 0
    kept = s.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 5) == [1, 1, 2]
    assert sum(r.doc_id is None for r in kept) == 1


def test_common_segments_are_joined_by_finer_parts(spark):
    rng = random.Random(5)
    low, high = rng.getrandbits(32), rng.getrandbits(32)
    values = {low | rng.getrandbits(32) << 32 for _ in range(150)} | {rng.getrandbits(32) | high << 32 for _ in range(150)}
    for v in list(values):  # near ones: bits change in both halves
        for _ in range(2):
            for k in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                v ^= 1 << k
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if 1 <= ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(want) > 100
    for segments in (2, 4):
        assert {(r.a, r.b) for r in s.links(nodes, segments=segments, common=20).collect()} == want


def test_hubs_and_common_fingerprints_meet_where_they_are(spark, monkeypatch):
    """With nothing but the rows of common keys counted as small, a hub's rows and those of a common fingerprint aren't shuffled."""
    from lumenqc.llm import common

    rows = [(i, "" if i % 3 else f"w{i} x{i % 7} y z") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    star = spark.createDataFrame([(-5, i) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(9)], "a long, b long")
    want = {r.doc_id: r.component_id for r in s.near_duplicates(docs).collect()}
    assert want == smallest([i for i, _ in rows], [plain(t) for _, t in rows])
    plainly, seen = common.is_small, []

    def few(df, rows=0, size=0):
        seen.append(plainly(df, 3))
        return seen[-1]

    monkeypatch.setattr(common, "is_small", few)
    roots = {r.node: r.root for r in s.components(star).collect()}
    assert roots == {i: -5 for i in (-5, *range(300))} | {1000 + i: 1000 for i in range(10)}
    assert {r.doc_id: r.component_id for r in s.near_duplicates(docs).collect()} == want
    assert True in seen and False in seen
