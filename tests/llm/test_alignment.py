import hashlib
import random
from collections import Counter

import numpy as np
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lumenqc.llm import alignment as al

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def letters():
    """Bytes of the visible letters of byte-level vocabularies, from their published rule."""
    keep = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    out, n = {}, 0
    for b in range(256):
        out[chr(b) if b in keep else chr(256 + n)] = b
        n += b not in keep
    return out


def brute(texts):
    """Whole texts through both libraries; groups by the intersection of their ends."""
    a, b, byte = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), letters()
    a.encode_special_tokens = True
    made = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xs = [bytes(byte[c] for c in a.id_to_token(k)) for k in x]
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in y for p in [b.id_to_piece(k)]]
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            made.append((0, 0, [], []))
            continue
        ends_x, ends_y = np.cumsum([*map(len, xs)]).tolist(), np.cumsum([*map(len, ys)]).tolist()
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends_x) & set(ends_y)):
            p, q = ends_x.index(e, i) + 1, ends_y.index(e, j) + 1
            groups.append((x[i:p], y[j:q]))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        made.append((len(x), len(y), groups, links))
    count = Counter(p for m in made for p in m[3])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    for n_a, n_b, groups, links in made:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        yield (n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha), groups


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c ", "line\nnext\n\n  indented\r\n\tx", "it's they'll don't I'D", "x▁y ▁", "<s> <|endoftext|> </s>", "café niño straße ñandú", "é", "你好 世界 こんにちは", " nb  x 　 y  z",
    "Привет мир как дела", "a" * 1000 + " b", "0123456789 " * 5, "👩‍👩‍👧 🇩🇪 ok", "\x00\x01 \x7f", "..... ,,, !!! ??? ((( ", "word " * 300, "x" * 205 + "▁ " + "tail", "\u0085 q\u0085 r", "if (a == b) {\n    return c[0x1F];\n}",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def columns(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def drawn():
    rng = random.Random(4)
    parts = ["the", "tion", "über", " ", "  ", "\n", ".", "é", "你", "é", "'s", "12", "—", "a", "ing", " \n ", "\t", "▁"[:0], "Ж", " ", "­", "🙂", "x" * 30]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_against_whole_texts(spark):
    texts = TEXTS + drawn() + TEXTS
    table = rows(spark, texts)
    got = {r.doc_id: columns(r) for r in al.judged(table, A, B).collect()}
    want = list(brute(texts))
    for k, (w, _) in enumerate(want):
        assert got[k] == w, texts[k]
    for r in al.align(table, A, B).collect():
        groups, x, y = [], 0, 0
        for p, q in zip(r.a_ends, r.b_ends, strict=True):
            groups.append((r.a_ids[x:p], r.b_ids[y:q]))
            x, y = p, q
        assert groups == want[r.doc_id][1]


def test_division_finds_all_shared_ends():
    rng = np.random.default_rng(2)
    for dense_a, dense_b in ((0.5, 0.5), (0.9, 0.05), (0.02, 0.9), (0.3, 0.3), (0.01, 0.01)):
        a_all, b_all, a_last, b_last, base = [], [], [], [], 0
        for n in (1, 2, 3, 50, 3000):
            end = base + n
            a = np.union1d(base + np.flatnonzero(rng.random(n) < dense_a) + 1, end)
            b = np.union1d(base + np.flatnonzero(rng.random(n) < dense_b) + 1, end)
            a_all.append(a)
            b_all.append(b)
            a_last.append(sum(map(len, a_all)) - 1)
            b_last.append(sum(map(len, b_all)) - 1)
            base = end
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        i, j = al.divided(a, b, np.array(a_last), np.array(b_last))
        both = np.intersect1d(a, b)
        assert (a[i] == both).all() and (b[j] == both).all()


def test_an_interval_without_shared_ends_is_linear():
    n = 300_000
    a, b = np.append(np.arange(n) * 4 + 2, 4 * n), np.append(np.arange(n) * 4 + 3, 4 * n)
    i, j = al.divided(a, b, np.array([n]), np.array([n]))
    assert i.tolist() == [n] and j.tolist() == [n]


def test_number_of_links_is_bounded_by_the_vocabularies():
    two = al.Pair(A, B)
    assert 50_000 < two.most_links() < 500_000
    linked = {(x, y) for _, groups in brute([t for t in TEXTS + drawn()]) for g in groups for x, y in [(g[0][-1], g[1][-1])]}
    assert all(two.a_bytes[x].endswith(two.b_bytes[y]) or two.b_bytes[y].endswith(two.a_bytes[x]) for x, y in linked)


def test_odd_rows(docs, none):
    assert al.judged(none, A, B).count() == 0
    texts = [r.text for r in docs.collect()]
    got = sorted(str(columns(r)) for r in al.judged(docs, A, B).collect())
    assert got == sorted(str(w) for w, _ in brute(texts))


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(al, "KEPT", 20)
    two = al.Pair(A, B)
    for k in range(30):
        two.tokens([f"word{k} and some others {k * 7}"])
        assert len(two.a_ids.number) < 40


def test_chunks_met_in_several_lots_outlast_a_full_store(monkeypatch):
    monkeypatch.setattr(al, "KEPT", 20)
    two, learned = al.Pair(A, B), []
    monkeypatch.setattr(two, "learn", lambda chunks, learn=two.learn: (learned.extend(chunks), learn(chunks)))
    for k in range(40):
        text = f"and usual word{k} caf\u00e9\u2003x others{k * 7}"
        a, b, _, _, fine = two.tokens([text])
        if fine.all():
            assert a.tolist() == two.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == two.b.encode(text)
        assert fine.tolist() == two.singly([" " + text])[2]
    assert learned.count(" usual") == 1


def test_sums_are_made_without_a_sort(docs):
    assert "SortAggregate" not in al.judged(docs, A, B)._jdf.queryExecution().executedPlan().toString()
