"""The thirteen operator queries and the pipeline, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.collocations_sql import collocations_oracle
from ledgerlens.llm.common import table
from ledgerlens.llm.lm_score import lm_oracle
from ledgerlens.llm.mixing_sql import mixing_oracle
from ledgerlens.llm.search_sql import search_oracle
from ledgerlens.llm.secrets_sql import secrets_oracle

QUERIES = {}
ORACLES = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


@register("op7_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@register("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.simhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), shingle=3, radius=2)


@register("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerlens.llm.bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, with_ids=False)


@register("op1_mix_sources", mixing_oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@register("op2_quality_crf")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@register("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.fingerprint import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


@register("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@register("op5_secret_scan", secrets_oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@register("op8_pii_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.pii import replace_entities

    return replace_entities(table(spark, sf_dir, "documents"), key="corpus-release-1")


@register("op9_lm_scores", lm_oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


@register("op13_collocations", collocations_oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, cover=50, top=2000)


@register("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


@register("op12_lexical_search", search_oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
