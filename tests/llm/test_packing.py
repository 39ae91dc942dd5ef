import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from lumenqc.llm import packing as k
from lumenqc.llm import tokens

TOKENIZER = path("word_bpe_49k.json")


def filled(counts, capacity):
    made, place = k.plan(counts, capacity), defaultdict(list)
    for length in range(1, capacity + 1):
        if counts[length]:
            sequence, offset = made.place(length, np.arange(counts[length]))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                place[s].append((o, length))
    for found in place.values():
        at = 0
        for o, length in sorted(found):
            assert o == at
            at += length
        assert at <= capacity
    assert len(place) == made.sequences
    return made.sequences


def best_fit_decreasing(counts, capacity):
    gaps = [0] * (capacity + 1)
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), capacity)
            if gap < capacity:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return sum(gaps)


def test_plans_are_gapless_and_close_to_the_bound():
    rng = random.Random(3)
    for capacity, top in ((64, 64), (64, 20), (4096, 4096), (128, 3)):
        counts = np.zeros(capacity + 1, np.int64)
        for _ in range(4000):
            counts[rng.randrange(1, top + 1)] += 1
        least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        got = filled(counts, capacity)
        assert got <= max(least + 2, least * 1.03)
        assert got <= best_fit_decreasing(counts, capacity) * 1.005 + 1


def test_small_cases_are_optimal():
    def best(items, capacity):
        bins, most = [], [len(items)]

        def go(i):
            if len(bins) >= most[0]:
                return
            if i == len(items):
                most[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[i] <= capacity:
                    bins[b] += items[i]
                    go(i + 1)
                    bins[b] -= items[i]
            bins.append(items[i])
            go(i + 1)
            bins.pop()

        go(0)
        return most[0]

    rng = random.Random(1)
    over = 0
    for _ in range(120):
        items = sorted((rng.randrange(1, 17) for _ in range(rng.randrange(1, 9))), reverse=True)
        over += filled(np.bincount(items, minlength=17), 16) - best(items, 16)
    assert 0 <= over <= 3
    assert filled(np.zeros(17, np.int64), 16) == 0


@pytest.mark.parametrize("text", ["á ́ b<|endoftext|>c  d\x1ce f g 'S it's", "ΑΣ ΑΣ'", "x\x0b\x0cy\x85z", "", " <|endoftext|> ", "<|startoftext|>a", "DON'T 123 don\u2019t 'll", "a" * 500])
def test_chunked_encoding_equals_the_librarys(text):
    plain = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert next(tokens.encoder(TOKENIZER).ids([text])).tolist() == plain
    assert next(tokens.encoder(path("byte_bpe_50k.json")).ids([text])).tolist() == Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_pack_against_brute_force(docs, none):
    rows = k.pack(docs, TOKENIZER, capacity=64).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, p, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64])) for p, a in enumerate(range(0, len(ids), 64))]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    place = defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for found in place.values():
        assert [o for o, _ in sorted(found)] == np.cumsum([0, *(n for _, n in sorted(found))])[:-1].tolist()
    assert len(place) <= -(-sum(r.length for r in rows) // 64) + 1
    assert k.pack(none, TOKENIZER).count() == 0


def test_pack_keeps_the_ids(docs):
    rows = k.pack(docs, TOKENIZER, capacity=64).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.select("doc_id", "text").collect()}
    sequences = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.ids == want[r.doc_id][r.start : r.start + 64]
        assert (r.length, r.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4")))
        assert r.offset == len(sequences[r.sequence_id])
        sequences[r.sequence_id] += r.ids
    assert sum(map(len, sequences.values())) == sum(len(want[r.doc_id]) for r in docs.select("doc_id").collect())


def test_places_are_the_same_when_firsts_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(300)], "doc_id long, text string").repartition(4, "doc_id")
    key = lambda df: sorted(map(str, df.drop("ids").collect()))
    small = key(k.pack(docs, TOKENIZER, 64))
    monkeypatch.setattr(k, "is_small", lambda df: False)
    assert key(k.pack(docs, TOKENIZER, 64)) == small
