"""The masking function and the rule table function under SQL names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.functions.masking import mask_all_sql


def register_redact_pii(spark: SparkSession, name: str = "redact_pii") -> str:
    """``SELECT redact_pii(text)`` as a native SQL function."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(document STRING) RETURNS STRING"
        f" RETURN {mask_all_sql('document')}"
    )
    return name


def register_compliance_rules(
    spark: SparkSession, rules: DataFrame, name: str = "compliance_rules"
) -> str:
    """``LATERAL compliance_rules(doc_type)``: general rules, then those of the type."""
    view = f"{name}_catalogue"
    rules.createOrReplaceTempView(view)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(document_type STRING)
        RETURNS TABLE(lookup_no INT, category STRING, seq INT, rule_id STRING,
                      description STRING, severity STRING, regulation STRING)
        RETURN SELECT l.pos, r.category, r.seq, r.id, r.description, r.severity, r.regulation
        FROM posexplode(array('general', lower(document_type))) AS l(pos, wanted)
        JOIN {view} r ON r.category = l.wanted""")
    return name
