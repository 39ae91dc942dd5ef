"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqc.llm import alignment, decontam, language, merkle, mixing, packing, pii, quality_rules, secret_scan, simhash, token_store, url_filter, warc
from lumenqc.llm.common import table


TOKENIZER = tokenizer_file("word_bpe_49k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")
BYTES = tokenizer_file("byte_bpe_50k.json")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = language.train(docs.where(~F.col("held_out")), PIECES)
    return language.predict(docs, model).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build(table(spark, sf_dir, "pages")).drop("about", "text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.judged(table(spark, sf_dir, "documents"), BYTES, PIECES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_decontam, op2_token_ids, op3_quality_rules, op4_language_id, op5_url_filter, op6_packing, op7_pii, op8_warc, op9_secret_scan, op10_simhash,
        op11_merkle, op12_mixing, op13_alignment,
    )
    return {f.__name__: f for f in made}


_SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SEEDS = " UNION ALL ".join(
    f"SELECT id, {m} AS m, p, concat_ws(' ', {', '.join(f'w[p + {k + 1}]' for k, c in enumerate(mask) if c == '1')}) AS seed FROM (SELECT id, w, unnest(range(len(w) - {len(mask) - 1})) AS p FROM {{}} WHERE len(w) >= {{}})" for m, mask in enumerate(decontam.MASKS)
)
OP1_SQL = f"""WITH d AS (SELECT doc_id AS id, {_SPLIT} AS w FROM documents), i AS (SELECT item_id AS id, {_SPLIT} AS w FROM benchmark), ds AS ({_SEEDS.format("d", 0, "d", 0)}), bs AS ({_SEEDS.format("i", decontam.SHORT, "i", decontam.SHORT)}),
long AS (SELECT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS shift FROM ds JOIN bs USING (m, seed)),
places AS (SELECT d.id AS doc_id, i.id AS item_id, unnest(range(1 - len(i.w), len(d.w))) AS shift FROM d JOIN i ON len(i.w) BETWEEN 1 AND {decontam.SHORT - 1}),
met AS (SELECT DISTINCT * FROM (SELECT * FROM long UNION ALL SELECT * FROM places)),
hits AS (SELECT doc_id, item_id, shift, len(i.w) AS n, least(len(i.w), 20) AS width, list_transform(range(len(i.w)), lambda k: CASE WHEN shift + k >= 0 AND d.w[shift + k + 1] = i.w[k + 1] THEN 1 ELSE 0 END) AS h FROM met JOIN d ON d.id = doc_id JOIN i ON i.id = item_id),
best AS (SELECT *, list_max(list_transform(range(n - width + 1), lambda k: list_sum(h[k + 1 : k + width]))) AS best FROM hits)
SELECT doc_id, item_id, max(list_sum(h))::BIGINT AS matched_words, max(n)::BIGINT AS n_item_words, max(best / width) AS identity, min(greatest(shift, 0))::BIGINT AS first_word FROM best WHERE best >= 0.8 * width GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    """The decontamination has an SQL form; learned models, fingerprints, tokenizers and spans have none and are tested against brute force."""
    return {"op1_decontam": OP1_SQL}
