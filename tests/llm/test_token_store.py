import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from lumenqc.llm import range_coder as c
from lumenqc.llm import token_store as s
from lumenqc.llm import tokens

TOKENIZER = path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70_000), st.integers(0, (1 << 32) - 1)), max_size=300))
def test_round_trip_of_any_ids(ids):
    ids = np.array(ids, "<u4")
    assert c.decode(b"".join(c.encode(ids))).tolist() == ids.tolist()


def test_round_trip_of_long_and_regular_ids():
    rng = np.random.default_rng(1)
    # much that repeats, so that new ids get small parts, and then only new ones: the longest codes
    worst = np.concatenate([np.tile([3, 3, 4], 300), rng.permutation(60_000)[:7000]] * 2)
    for ids in (np.tile([5, 6, 7, 8, 9], 9000), rng.integers(0, 49_408, 40_000), rng.geometric(0.01, 20_001), np.full(17_000, 65_535), np.arange(33_000), worst):
        ids = ids.astype("<u4")
        data = b"".join(c.encode(ids))
        assert (c.decode(data) == ids).all()
    assert len(b"".join(c.encode(np.tile(np.array([5, 6, 7, 8, 9], "<u4"), 9000)))) < 9000


def test_blocks_stand_alone_and_damage_is_seen(monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 16_384)
    ids = np.random.default_rng(2).integers(0, 900, 40_000).astype("<u4")
    blocks = c.encode(ids)
    assert len(blocks) == 3
    assert (c.decode(blocks[1]) == ids[c.BLOCK : 2 * c.BLOCK]).all()
    for at in (5, 30, len(blocks[1]) - 1):
        bad = bytearray(blocks[1])
        bad[at] ^= 1
        with pytest.raises(c.Corrupt):
            c.decode(bytes(bad))
    with pytest.raises(c.Corrupt):
        c.decode(blocks[1][:-3])


def test_files_against_brute_force(spark, docs, none):
    t = Tokenizer.from_file(TOKENIZER)
    rows = docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    got = sorted((tuple(r) for r in s.round_trip(docs, TOKENIZER).collect()), key=lambda r: r[1])
    assert got == want
    assert s.round_trip(none, TOKENIZER).count() == 0


def test_ids_come_back(spark, tmp_path):
    table = spark.createDataFrame([(i, f"text {i} of many") for i in range(50)], "doc_id long, text string")
    folder = f"file://{tmp_path}/out"
    files = s.write_tokens(table, folder, TOKENIZER, 2)
    back = s.read_tokens(spark, folder, files, with_ids=True).collect()
    t = Tokenizer.from_file(TOKENIZER)
    assert {r.doc_id: r.ids for r in back} == {i: [*t.encode(f"text {i} of many", add_special_tokens=False).ids, 2] for i in range(50)}


def test_large_ids_are_coded_too():
    ids = np.random.default_rng(3).geometric(0.01, 100_000).astype("<u4") * 40_000_000 // 7
    assert (c.decode(b"".join(blocks := c.encode(ids))) == ids).all()
    assert blocks[0][4] == c.CODED and len(blocks[0]) < 1.2 * len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x250), st.sampled_from(" \n's'TLL<|\u0301\u00a0\x1c😀日Σ")), max_size=40), max_size=5))
def test_encoder_against_the_whole_tokenizer(texts):
    texts += ["<|endoftext|> a<|startoftext|>b <|end", "'s 'Tis we'llx CAFÉ ½x²", "x\x85y\xadz 'LL"]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False) if texts else []
    assert [x.tolist() for x in tokens.encoder(TOKENIZER).ids(texts)] == [x.ids for x in want]


def test_encoder_begins_anew_when_it_holds_much(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    monkeypatch.setattr(tokens, "PIECE_CACHE", 12)
    monkeypatch.setattr(tokens, "LOT", 50)
    texts = [None, *(f"word{i} and other{i % 7}, WORD{i}" for i in range(60)), ""]
    t = Tokenizer.from_file(TOKENIZER)
    assert [x.tolist() for x in tokens.Encoder(TOKENIZER).ids(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_chunks_met_in_several_lots_outlast_a_full_store(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    monkeypatch.setattr(tokens, "PIECE_CACHE", 12)
    monkeypatch.setattr(tokens, "LOT", 50)
    made, learned, texts = tokens.Encoder(TOKENIZER), [], [f"usual rare{i} and other{i}" for i in range(60)]
    monkeypatch.setattr(made, "learn", lambda chunks, learn=made.learn: (learned.extend(chunks), learn(chunks)))
    t = Tokenizer.from_file(TOKENIZER)
    assert [x.tolist() for x in made.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert learned.count("usual") == learned.count("and") == 1
    assert len(made.known.number) < 25


def test_more_distinct_ids_than_the_tables_name_are_coded():
    rng = np.random.default_rng(3)
    some = np.unique(rng.integers(1 << 20, 1 << 32, 300_000, dtype=np.uint32))
    ids = np.concatenate([rng.permutation(some), some[np.minimum(rng.zipf(1.3, 700_000), len(some)) - 1]]).astype(np.uint32)
    made = c.encode(ids)
    modes = [c.HEADER.unpack_from(b)[1] for b in made]
    assert len(made) == 4 and modes[2:] == [c.CODED] * 2
    assert (c.decode(b"".join(made)) == ids).all()
    assert sum(map(len, made)) < 3.2 * len(ids)


def test_several_lots_at_once_look_up_fewer_chunks(monkeypatch):
    monkeypatch.setattr(tokens, "LOT", 50)
    texts, asked, want = [f"usual word{i % 9} and other{i % 7}" for i in range(60)], [], []
    for lots in (1, 3):
        made, n = tokens.Encoder(TOKENIZER), []
        monkeypatch.setattr(made, "flat_ids", lambda some, n=n, own=made.flat_ids: (n.append(len(some)), own(some))[1])
        want.append([x.tolist() for x in made.ids(texts, lots)])
        asked.append(len(n))
    assert want[0] == want[1] and asked[1] < asked[0] / 2
