"""Registered queries of the training-data operators, with SQL checks where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import (
    bpe, collocations, exact_dedup, language, mixing, near_dedup, pu_quality, quality, resampling, secrets,
    toxicity, url_filters, warc,
)
from attestor.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, url AS uri, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p),
r AS (SELECT *, n >= 1000 AND page_id <> top AS revisit FROM g)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN top END AS refers_to, uri
FROM r
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = toxicity.remainder("doc_id", 5)
    model = toxicity.train_toxic(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score_texts(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select(
        "doc_id", (fold == 0).alias("held_out"), "score", "predicted", "n_offending", "worst_start", "worst_end", spans.alias("spans")
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(*url_filters.derived(table(spark, sf_dir, "pages")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, forest)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = toxicity.remainder("doc_id", 3)
    model = language.train_language(docs, fold != 1)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return language.identify(docs, model).select(
        "doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "n_spans", spans.alias("spans")
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = toxicity.remainder("doc_id", 5)
    model = pu_quality.train_pu(docs, table(spark, sf_dir, "labels"), fold != 0)
    return pu_quality.score_quality(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


# Parts of operators that SQL can state, where it cannot state the whole.


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that need no model."""
    return quality.base_columns(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 before rates and copies."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_toxicity": op2_toxicity,
        "op3_url_filters": op3_url_filters,
        "op4_secrets": op4_secrets,
        "op5_quality_rules": op5_quality_rules,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_mixing": op7_mixing,
        "op8_language": op8_language,
        "op9_bpe": op9_bpe,
        "op10_near_dedup": op10_near_dedup,
        "op11_collocations": op11_collocations,
        "op12_resampling": op12_resampling,
        "op13_pu_quality": op13_pu_quality,
        "quality_base": quality_base,
        "mixing_targets": mixing_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op3_url_filters": url_filters.FILTER_SQL,
        "op4_secrets": secrets.report_sql(),
        "op6_exact_dedup": OP6_SQL,
        "op10_near_dedup": near_dedup.NEAR_SQL,
        "op11_collocations": collocations.COLLOCATIONS_SQL,
        "op12_resampling": resampling.RESAMPLE_SQL,
        "quality_base": quality.BASE_SQL,
        "mixing_targets": mixing.TARGETS_SQL,
    }
