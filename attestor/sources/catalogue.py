"""Rule catalogue: load from JSON, metadata, export."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.rule_catalogue import CATALOGUE, PREDICATES

RULE = (
    "struct<id:string,description:string,severity:string,regulation:string,"
    "must:string,must_not:string,min_count:int>"
)
RULE_FIELDS = ("id", "description", "severity", "regulation")


def _entries(spark: SparkSession, path: str | None) -> DataFrame:
    """One row per top-level key of the catalogue, in file order, its value still JSON text."""
    if path is None:
        text = spark.range(1).select(F.lit(json.dumps(CATALOGUE)).alias("value"))
    else:
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            text = spark.range(0).select(F.lit("{}").alias("value"))
    entries = F.from_json("value", "map<string,string>")
    return text.select(F.posexplode(entries).alias("category_no", "category", "body"))


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Flat rules in catalogue order: category_no, category, seq, id, description, …

    A rule may state its predicate: ``must`` and ``must_not`` (patterns) and ``min_count``.

    Without a path the built-in catalogue; a missing file is an empty catalogue. Keys that
    start with ``_`` and values that are not lists are skipped.
    """
    return (
        _entries(spark, path)
        .where(~F.col("category").startswith("_") & F.col("body").startswith("["))
        .select(
            "category_no", "category",
            F.posexplode(F.from_json("body", f"array<{RULE}>")).alias("seq", "rule"),
        )
        .select("category_no", "category", "seq", "rule.*")
    )


def rules_metadata(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row: catalogue version and jurisdiction, with defaults where they are absent."""
    found = _entries(spark, path).where(F.col("category") == "_metadata").select(
        F.get_json_object("body", "$.version").alias("version"),
        F.get_json_object("body", "$.jurisdiction").alias("jurisdiction"),
    )
    return found.agg(
        F.coalesce(F.first("version"), F.lit(V.DEFAULT_VERSION)).alias("version"),
        F.coalesce(F.first("jurisdiction"), F.lit(V.DEFAULT_JURISDICTION)).alias("jurisdiction"),
    )


def with_predicates(rules: DataFrame) -> DataFrame:
    """Complete must, must_not and min_count: a rule's own ones, else the built-in ones of its id.

    A rule with neither has null patterns and is never evaluated.
    """
    table = F.create_map(*[
        x
        for rule_id, (must, must_not, n) in PREDICATES.items()
        for x in (
            F.lit(rule_id),
            F.struct(
                F.lit(must).cast("string").alias("must"),
                F.lit(must_not).cast("string").alias("must_not"),
                F.lit(n).alias("min_count"),
            ),
        )
    ])
    found = F.try_element_at(table, F.col("id"))
    own = F.col("must").isNotNull() | F.col("must_not").isNotNull()
    return rules.withColumns({
        "must": F.when(own, F.col("must")).otherwise(found["must"]),
        "must_not": F.when(own, F.col("must_not")).otherwise(found["must_not"]),
        "min_count": F.coalesce(F.when(own, F.col("min_count")).otherwise(found["min_count"]), F.lit(1)),
    })


def builtin_rows() -> list[Row]:
    """The built-in rules with their predicates as literals for planning, in order."""
    categories = [c for c in CATALOGUE if not c.startswith("_")]
    return [
        Row(category=c, **rule, must=must, must_not=must_not, min_count=n)
        for c in categories
        for rule in CATALOGUE[c]
        for must, must_not, n in [PREDICATES.get(rule["id"], (None, None, 1))]
    ]


def rules_document(rules: DataFrame) -> DataFrame:
    """The whole catalogue as one row of JSON text, categories and rules in order."""
    stated = [c for c in ("must", "must_not", "min_count") if c in rules.columns]
    rule = F.struct("seq", F.struct(*RULE_FIELDS, *stated).alias("rule"))
    per_category = rules.groupBy("category_no", "category").agg(
        F.array_sort(F.collect_list(rule)).alias("listed")
    )
    entry = F.struct(
        "category_no", "category", F.transform("listed", lambda r: r["rule"]).alias("rules")
    )
    ordered = F.array_sort(F.collect_list(entry))
    document = F.map_from_entries(
        F.transform(ordered, lambda e: F.struct(e["category"], e["rules"]))
    )
    return per_category.agg(F.to_json(document).alias("value"))


def export_rules(rules: DataFrame, path: str) -> None:
    """Write the catalogue as one JSON document (the catalogue is configuration, a few KB)."""
    rules_document(rules).coalesce(1).write.mode("overwrite").text(path)
