"""Queries opN_<name>: each operator over its whole table, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, decontaminate, html_text, importance, langid, licenses, ngram_lm, pieces, secret_scan, shards, simhash, token_align, token_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op3_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.summary(shards.shuffle(_table(spark, sf_dir, "documents")))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op4_learned_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codes.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, fold=0))
    return found.select("doc_id", common.in_fold(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score", "rejected")


def op10_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


# words of a text, A to Z lower-cased
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i))),
docs AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
wanted AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
words AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT w FROM docs UNION SELECT w FROM wanted), crc_table),
corpus AS (SELECT bucket, count(*) AS s FROM docs JOIN words USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN words USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM docs) + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM corpus LEFT JOIN target USING (bucket)),
summed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM docs JOIN words USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight FROM documents LEFT JOIN summed USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * n // 100 THEN nth END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""


def _license_sql() -> str:
    sure: dict[str, list[str]] = {}
    for t in licenses.TEMPLATES:
        for label in {t.label, t.family} - {None}:
            sure.setdefault(label, []).append(licenses.expression(licenses.parse(t.markup)))
    told = ", ".join(f"CASE WHEN regexp_matches(joined, '(?:{'|'.join(p)})(?: |$)') THEN '{label}' END" for label, p in sorted(sure.items()))
    base = ", ".join(f"CASE WHEN regexp_matches(joined, ' {phrase}(?: |$)') THEN '{label}' END" for phrase, label in licenses.PHRASES.items())
    here = " OR ".join("(" + " AND ".join([f"{['w', 'w1', 'w2'][i]} = '{w}'" for i, w in enumerate(phrase.split())]) + ")" for phrase in licenses.PHRASES)
    return f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
told AS (SELECT doc_id, words, list_sort(list_filter([{base}], lambda x: x IS NOT NULL)) AS base, list_filter([{told}], lambda x: x IS NOT NULL) AS sure
    FROM (SELECT *, array_to_string(list_transform(words, lambda w: ' ' || w), '') AS joined FROM docs)),
placed AS (SELECT doc_id, i, w, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w2
    FROM (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM docs)),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM placed WHERE {here} GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    array_to_string(told.base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(told.base, sure))), ',') AS labels,
    CASE WHEN len(told.base) + len(sure) = 0 THEN 0.0 ELSE len(sure)::DOUBLE / len(list_distinct(list_concat(told.base, sure))) END::DOUBLE AS score
FROM told LEFT JOIN base USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_simhash_near_dedup,
        op2_secret_scan,
        op3_hypergeometric_sharding,
        op4_learned_partition_ann,
        op5_sentencepiece,
        op6_benchmark_decontamination,
        op7_token_codes,
        op8_html_main_text,
        op9_language_id,
        op10_bloom_lm_scores,
        op11_importance_resampling,
        op12_license_scan,
        op13_tokenizer_alignment,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": OP11_SQL, "op12_license_scan": _license_sql()}
