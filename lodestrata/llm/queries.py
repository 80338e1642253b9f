"""The registered queries of this package: thin digests of what its operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .common import materialize, read_table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All pieces of docs, without their ids: those stay in the table of pieces."""
    from . import packing

    cut = materialize(spark, packing.pieces(docs, _vocabulary("byte_bpe_50k.json")), "pieces")
    return packing.pack(spark, cut.drop("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    led = quality.ledger(read_table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejects("base").alias("base_failed"), (~quality.rejects("v1")).alias("kept"), "failures",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy drops, and drops alone, from a stored ledger."""
    from . import quality

    return quality.ablation(materialize(spark, quality.ledger(read_table(spark, sf_dir, "documents")), "ledger"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score_documents(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dedup

    return dedup.find_copies(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read_table(spark, sf_dir, "documents")).drop("spans")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfiles

    return tokenfiles.digests(tokenfiles.write_and_read(read_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import unigram

    return unigram.count_tokens(read_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.extract(read_table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.round_trip(read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_simhash, op3_quality_rules, quality_ablation, op4_lm_scoring, op5_exact_dedup, op6_license_scan, op7_token_files, op8_token_counts, op9_html_text, op10_bpe)
}
LEDGER = r"""
        WITH d AS MATERIALIZED (
          SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
          FROM documents),
        keyed AS MATERIALIZED (SELECT row_number() OVER () AS row_key, w FROM (SELECT DISTINCT w FROM d)),
        win AS (
          SELECT row_key, i, count(*) OVER (PARTITION BY row_key, a, b, c) AS n
          FROM (SELECT row_key, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
                FROM (SELECT row_key, w, unnest(range(1, len(w) - 1)) AS i FROM keyed))),
        cov AS (
          SELECT row_key, count(DISTINCT i + k) AS n
          FROM win, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY row_key),
        m AS (
          SELECT doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
                 length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                 coalesce(cov.n, 0)::BIGINT AS n_repeat_words
          FROM d JOIN keyed ON d.w = keyed.w LEFT JOIN cov USING (row_key)),
        b AS (
          SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > word_chars AS f2,
                 n_lines >= 4 AND 2 * n_dup_lines > n_lines AS f3,
                 n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS f4
          FROM m)"""
ORACLES = {
    "op6_license_scan": licenses.oracle_sql(),
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_quality_rules": LEDGER + r"""
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
               NOT (f0 OR f1 OR f2 OR f3 OR f4) AS kept,
               (f0::BIGINT + 2 * f1::BIGINT + 4 * f2::BIGINT + 8 * f3::BIGINT + 16 * f4::BIGINT) AS failures
        FROM b""",
    "quality_ablation": LEDGER + """
        , r AS (SELECT unnest([{'rule': 'few_words', 'bit': 1}, {'rule': 'repeated_words', 'bit': 2}, {'rule': 'many_symbols', 'bit': 4}, {'rule': 'duplicate_lines', 'bit': 8}, {'rule': 'word_length', 'bit': 16}]) AS r),
        x AS (SELECT f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT AS bits FROM b)
        SELECT (SELECT count(*) FROM x) AS rows, r.rule AS rule, count(*) FILTER (bits & r.bit <> 0) AS failed, count(*) FILTER (bits = r.bit) AS alone FROM x, r GROUP BY r.rule""",
}
