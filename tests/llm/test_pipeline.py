import itertools
import random

import pyarrow as pa
from public_tokenizers import path
from pyspark.sql.types import LongType, StringType, StructType
from tokenizers import Tokenizer

import corpus_pipeline as c
from lumenqc.llm import common, language, secret_scan, simhash
from lumenqc.llm.common import table
from tests.llm.test_language import WORDS
from tests.llm.test_simhash import plain, smallest


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda lang, n: " ".join(rng.choices(WORDS[lang], k=n))
    leak = " ".join(f"item{i}" for i in range(30))
    docs = [(i, f"{prose(lang, 40)} tag{i}", lang) for i in range(60) for lang in [rng.choice(list(WORDS))]]
    docs += [(60, docs[3][1], "en"), (61, docs[3][1], "en"), (62, f"{prose('en', 20)} {leak} {prose('en', 5)}", "en"), (63, "12345 678", "en"), (64, None, "en")]
    docs += [(65, f"{prose('en', 30)} password=abcdefgh1234", "en")]
    spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps, now = [], table(spark, str(tmp_path), "documents")
    columns = now.columns
    for k, (_, stage) in enumerate(c.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(now)
        assert k == len(c.STAGES) - 1 or now.columns == columns
    kept = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:4]]
    assert set(kept[0]) == {i for i, _, _ in docs} - {63, 64}
    least = smallest(sorted(kept[0]), [plain(kept[0][i]) for i in sorted(kept[0])])
    assert set(kept[1]) == {i for i in kept[0] if least[i] == i}
    assert not {60, 61} & set(kept[1])
    assert set(kept[2]) == set(kept[1]) - {62}
    assert kept[3] == {i: secret_scan.redact(t, secret_scan.scan(t)) for i, t in kept[2].items()}
    assert "[assign]" in kept[3][65]
    packed = steps[4].collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    for _, group in itertools.groupby(sorted(packed, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
    assert sorted(map(tuple, c.run(spark, str(tmp_path)).select("doc_id", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.length, r.ids_crc32) for r in packed)
    assert simhash.keep_one(steps[1]).count() == steps[1].count()


def test_unlearned_languages_go(spark, tmp_path):
    rng = random.Random(4)
    known = [(i, " ".join(rng.choices(WORDS[lang], k=30)), lang) for i in range(90) for lang in [rng.choice(list(WORDS))]]
    known += [(90, "the water and the house", None), (91, "mit leute und wasser", None)]
    strange = ["talo ja vesi ovat täällä ihmisten kanssa jotka tulivat eilen", "дом и вода здесь с людьми которые пришли вчера", "Το σπίτι και το νερό είναι εδώ με τους ανθρώπους", "这是一个房子和水", "kuća i voda ovdje s ljudima koji dolaze"]
    docs = spark.createDataFrame([*known, *((100 + i, t * 3, None) for i, t in enumerate(strange))], "doc_id long, text string, lang string")
    model = language.train(docs, path("piece_bpe_32k.model"))
    score = {r.doc_id: r.score for r in language.predict(docs, model).collect()}
    assert sum(score[100 + i] >= c.LEAST_SCORE for i in range(len(strange))) >= 3  # the share alone lets them pass
    assert {r.doc_id for r in c.language_id(spark, docs, "").collect()} == {i for i, _, _ in known}


def test_without_a_model_all_stay(spark):
    docs = spark.createDataFrame([(1, "the house", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in c.language_id(spark, docs, "").collect()} == {1, 2}


def test_the_ids_come_out(spark):
    docs = spark.createDataFrame([(1, "the house"), (2, None)], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in c.best_fit_packing(spark, docs, "").collect()}
    assert ids == {1: [*Tokenizer.from_file(path("word_bpe_49k.json")).encode("the house", add_special_tokens=False).ids, 1], 2: [1]}


def test_odd_rows_and_empty_tables_go_through(spark, tmp_path, docs, none):
    schema = "doc_id long, text string, lang string, source string, n_chars long, start string, ids string, task int, not_first string"
    for name, rows in (("odd", docs), ("none", none)):
        folder = f"{tmp_path}/{name}"
        made = rows.selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "1L n_chars", "start", "'i' ids", "3 task", "'n' not_first")
        assert made.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        made.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "no such passage"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    named = [r for r in rows if r[0] is not None]
    least = smallest([i for i, _ in named], [plain(t) for _, t in named])
    got = sorted((r.doc_id for r in c.run(spark, f"{tmp_path}/odd").where("piece = 0").collect()), key=str)
    assert got == sorted([i for i, _ in rows if i is None or least[i] == i], key=str)
    assert got.count(1) == 2
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_python_gets_small_batches(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "'a text' text").coalesce(1)
    for stage in (c.near_duplicates, c.secrets):
        for key in c.BATCH:
            spark.conf.unset(key)
        stage(spark, docs, "")
        sizes = docs.mapInArrow(lambda batches: (pa.record_batch({"n": [len(b)]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 5000 and max(r.n for r in sizes) <= 2000


class Given:
    """Instead of rows gives the function that a stage hands to its tasks."""

    columns, schema = ["doc_id", "text"], StructType().add("doc_id", LongType()).add("text", StringType())

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_gives_back_what_the_stage_before_kept():
    batch = pa.record_batch({"doc_id": pa.array(range(1200), pa.int64()), "text": ["a text"] * 1200})
    for make in (simhash.fingerprints, secret_scan.find_secrets, secret_scan.redact_secrets):
        common.sole("tables of the stage before", lambda: [0] * 1000)
        made = list(make(Given())(iter([batch])))
        assert "tables of the stage before" not in common._kept
        assert sum(map(len, made)) == 1200 and max(map(len, made)) <= 500
