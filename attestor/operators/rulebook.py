"""Rule lookups: which rules apply, how many, and single rules by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.session import small_side
from attestor.sources.catalogue import RULE_FIELDS


def _lookups(docs: DataFrame) -> DataFrame:
    """Each document asks for the general rules, then for those of its type."""
    wanted = F.array(F.lit("general"), F.lower("doc_type"))
    return docs.select("*", F.posexplode(wanted).alias("lookup_no", "wanted"))


def applicable_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """General and then specific rules per document; type ``general`` gets them twice."""
    renamed = rules.withColumnRenamed("id", "rule_id")
    return (
        _lookups(docs)
        .join(small_side(renamed), F.col("wanted") == F.col("category"))
        .drop("wanted")
    )


def rule_counts(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents and applicable rules per document type (zero where nothing applies)."""
    types = docs.groupBy("doc_type").agg(F.count("*").alias("documents"))
    per_category = rules.groupBy("category").agg(F.count("*").alias("n"))
    return (
        _lookups(types)
        .join(small_side(per_category), F.col("wanted") == F.col("category"), "left")
        .groupBy("doc_type")
        .agg(F.max("documents").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("rule_count"))
    )


def rules_response(docs: DataFrame, rules: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per document type: rule ids in order, their number, version and jurisdiction."""
    about = metadata.first()
    types = docs.groupBy("doc_type").agg(F.count("*").alias("documents"))
    listed = F.array_sort(F.collect_list(F.struct("lookup_no", "seq", "rule_id")))
    return (
        applicable_rules(types, rules)
        .groupBy("doc_type", "documents")
        .agg(F.transform(listed, lambda r: r["rule_id"]).alias("rule_ids"))
        .withColumns({
            "rule_count": F.size("rule_ids"),
            "version": F.lit(about["version"]),
            "jurisdiction": F.lit(about["jurisdiction"]),
        })
    )


def rules_json(rules: DataFrame, doc_types: DataFrame) -> DataFrame:
    """The applicable rules of each document type as one JSON array text."""
    rule = F.struct("lookup_no", "seq", F.struct(F.col("rule_id").alias("id"), *RULE_FIELDS[1:]).alias("rule"))
    ordered = F.array_sort(F.collect_list(rule))
    return (
        applicable_rules(doc_types.select("doc_type").distinct(), rules)
        .groupBy("doc_type")
        .agg(F.to_json(F.transform(ordered, lambda r: r["rule"])).alias("rules_text"))
    )


def supported_types(rules: DataFrame) -> DataFrame:
    """Categories in catalogue order with the number of categories; includes ``general``."""
    types = rules.groupBy("category").agg(
        F.min("category_no").alias("category_no"), F.count("*").alias("rule_count")
    )
    return types.withColumn("type_count", F.lit(types.count())).orderBy("category_no")


def rules_summary(rules: DataFrame) -> DataFrame:
    """Readable summary: per category a block of a header with the count and one line per rule."""
    line = F.concat(F.lit(V.RULE_MARK), F.col("id"), F.lit("] "), F.col("description"))
    blocks = rules.groupBy("category_no", "category").agg(
        F.count("*").alias("rule_count"),
        F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("listed"),
    )
    header = F.concat(
        F.lit(V.CATEGORY_MARK), F.upper("category"), F.lit(": "),
        F.col("rule_count").cast("string"), F.lit(" rule(s)"),
    )
    return blocks.select(
        "category_no",
        "category",
        "rule_count",
        F.concat_ws("\n", header, F.transform("listed", lambda r: r["line"])).alias("block"),
    )


def first_by_id(rules: DataFrame) -> DataFrame:
    """One row per rule id, the first in catalogue order."""
    fields = F.struct("category_no", "seq", "category", "id", "description", "severity", "regulation")
    return (
        rules.groupBy(F.col("id").alias("rule_id"))
        .agg(F.min(fields).alias("rule"))
        .select("rule_id", "rule.category", "rule.description", "rule.severity", "rule.regulation")
    )


def rule_by_id(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids with their rule, or found = false and an error text."""
    found = small_side(first_by_id(rules).withColumn("found", F.lit(True)))
    return ids.join(found, "rule_id", "left").withColumns({
        "found": F.coalesce("found", F.lit(False)),
        "error": F.when(F.col("found").isNull(), F.lit(V.NO_RULE)),
    })
