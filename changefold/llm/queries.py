"""The registered queries of the operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from changefold.llm import (
    byte_bpe,
    conversations,
    embeddings,
    html_text,
    language,
    lexical_search,
    line_templates,
    mixing,
    oracles,
    phrase_index,
    quality_rules,
    simhash,
    simple8b,
    warc_zstd,
)
from changefold.llm.common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_templates.dedup_lines(docs, **line_templates.LETTER)
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.judge(docs, _table(spark, sf_dir, "labels"))
    names = [*quality_rules.BASE, "base_failed", "kept"]
    return out.select("doc_id", *[F.col(f"__quality_{n}").alias(n) for n in names])


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_zstd.warc_round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_file_digests(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, max_bits=4)
    return out.select("doc_id", "fingerprint", "component_id")


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_components(_table(spark, sf_dir, "embeddings"), least=0.93)


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.bpe_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), best=50)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_source_mix, op2_line_templates, op3_quality_rules, op4_warc_archive, op5_token_files, op6_simhash,
        op7_embedding_links, op8_page_text, op9_byte_bpe, op10_language, op11_phrase_index, op12_lexical_search, op13_conversation_repair,
        pipeline,
    )
    return {f.__name__: f for f in own}


def llm_oracles() -> dict[str, str]:
    return {
        "op4_warc_archive": WARC_SQL,
        "op7_embedding_links": EMBEDDING_SQL,
        "op11_phrase_index": oracles.PHRASE_SQL,
        "op12_lexical_search": oracles.SEARCH_SQL,
        "op13_conversation_repair": oracles.REPAIR_SQL,
    }


WARC_SQL = """
WITH base AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), largest AS (
  SELECT html, max(page_id) AS response FROM base WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT b.page_id, b.payload_bytes, b.payload_digest,
       CASE WHEN l.response <> b.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN l.response <> b.page_id THEN l.response END AS refers_to
FROM base b LEFT JOIN largest l ON b.payload_bytes >= 1000 AND l.html = b.html
"""

#: Brute force over all pairs of a label.
EMBEDDING_SQL = """
WITH RECURSIVE base AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), valid AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM base
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM valid
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id,
       coalesce(c, e.vec_id) = e.vec_id AS kept
FROM base e LEFT JOIN component ON component.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
"""
