import math
import random

import pytest
from public_tokenizers import path

from lumenqc.llm import language as g

PIECES = path("piece_bpe_32k.model")
WORDS = {"en": "the house and water there with thing would about people".split(), "de": "das haus und wasser nicht mit straße würde über leute".split(), "es": "la casa y agua donde con cosa señor sobre gente".split()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    return [(i, " ".join(rng.choices(WORDS[lang], k=30)) + "!", lang) for i in range(120) for lang in [rng.choice(list(WORDS))]]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return g.train(spark.createDataFrame([*corpus, (999, None, "en"), (998, "text", None)], "doc_id long, text string, lang string"), PIECES)


def enumerate_cuts(word, p, lang, vocabulary):
    """The sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(16, len(word)) + 1):
        k = vocabulary.get(word[:n], len(p) - 2 if n == 1 else None)
        if k is not None:
            total += p[k, lang] * enumerate_cuts(word[n:], p, lang, vocabulary)
    return total


def test_forward_sums_all_segmentations(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    words = ["▁the", "▁straße", "▁señor", "▁x", "▁你好", "▁water", "▁qzj"]
    got = model.scores(words)
    for w, row in zip(words, got, strict=True):
        for lang in range(len(model.langs)):
            assert math.isclose(row[lang], math.log(enumerate_cuts(w, model.p, lang, vocabulary)), rel_tol=1e-9)


def test_expectations_count_each_word_once(model):
    """However a word is cut, its pieces' lengths sum to its own."""
    vocabulary = g.vocabulary(PIECES)
    words = ["▁house", "▁there", "▁ab"]
    uses = model.expected(words, __import__("numpy").array([2.0, 1.0, 3.0]), 0)
    assert math.isclose((uses * vocabulary.lengths).sum(), 2 * 6 + 6 + 3 * 3, rel_tol=1e-9)


def test_held_out_accuracy(spark, corpus, model):
    rng = random.Random(7)
    fresh = [(i, " ".join(rng.choices(WORDS[lang], k=8)), lang) for i in range(200) for lang in [rng.choice(list(WORDS))]]
    got = {r.doc_id: r for r in g.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in fresh) >= 196
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(docs, none, model):
    rows = g.predict(docs, model).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4, 5}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert g.predict(none, model).count() == 0
    assert {r.lang_pred for r in g.predict(docs, None).collect()} == {"und"}
    kept = g.keep_known(docs, model, 0.0)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 1, 6, 7, 8, 9]
    assert g.train(docs.selectExpr("doc_id", "text", "cast(null as string) lang"), PIECES) is None


def test_sample_bound(spark, corpus):
    table = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    assert g.train(table, PIECES, max_rows=60).langs
