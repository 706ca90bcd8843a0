"""A corpus in five stages: rules, line dedup, near-dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it returned; between stages a corpus is written as Parquet and read
again. All but the last return the columns of documents. Stages treat nulls,
empty and very long texts, repeated rows, empty tables and extra columns as
their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from changefold.llm import byte_bpe, line_templates, mixing, quality_rules, simhash
from changefold.llm.common import importable, sheltered
from changefold.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, labels)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in their first document. A document left without a
    word by that is a copy of others' lines and goes; n_chars follows the text."""
    inner, back = sheltered(docs, ("doc_id", "text", "n_chars"))
    out = line_templates.dedup_lines(inner, **line_templates.LETTER)
    blank = (F.col("__n_dropped") > 0) & (F.char_length(F.translate("text", " \t\n\x0b\f\r", "")) == 0)
    out = out.where(~F.coalesce(blank, F.lit(False)))
    if "n_chars" in docs.columns:
        shorter = F.when(F.col("__n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", shorter)
    return back(out)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of four-word
    shingles link at four or fewer differing bits."""
    importable(spark)
    return simhash.keep_one(docs, simhash.simhash_components(docs, shingle=4, max_bits=4))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; left-out documents go."""
    importable(spark)
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    importable(spark)
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.bpe_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: Learned rules, hashes and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
