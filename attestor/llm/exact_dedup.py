"""Exact duplicates: local, salted and global merging, each comparing full contents.

1. Every task first merges equal texts of its own rows, then salted groups (digest, salt,
   full text) are merged; the salt comes from the row's key, so a text that a third of all rows
   share is merged in many tasks and reaches the next step as one row per salt.
2. The salt winners meet by digest and are merged globally, again by digest and full text.
3. Rows look their group up by digest. Digests with several texts (a collision) are looked up
   by digest and full text instead; that step is only planned if such a digest exists.

Null counts as the empty text. Among equal texts the largest key stays; null keys lose against
any other, and stay only if no copy has a key. Rows that repeat the winning key are all marked
``kept``; ``drop_exact_copies`` returns exactly one row a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import Workspace, whole_text

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def winners(docs: DataFrame, key: str, text: str, salts: int, digest: Callable[[Column], Column], space: Workspace) -> DataFrame:
    """One staged row per distinct text: digest, keep_id, group_size, variants of the digest.

    ``text`` is carried only for digests that several texts share.
    """
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    rows = rows.select("key", "text", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
    merged = (
        salted.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    merged = merged.withColumn("variants", F.expr("count(*) over (partition by digest)"))
    return space.put("winners", merged.withColumn("text", F.when(F.col("variants") > 1, F.col("text"))))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row: key, keep_id, group_size, kept, text_sha256."""
    space = Workspace(docs.sparkSession, "exact")
    found = winners(docs, key, text, salts, digest, space)
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    rows = rows.select("key", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"), "text")
    shared = found.where("group_size > 1 and variants = 1").select("digest", "keep_id", "group_size")
    clashing = found.where("variants > 1")
    looked_up = rows.drop("text").join(shared, "digest", "left")
    if not clashing.isEmpty():
        bad = clashing.select("digest").distinct()
        looked_up = rows.drop("text").join(bad, "digest", "left_anti").join(shared, "digest", "left")
        exact = rows.join(bad, "digest", "left_semi").join(clashing.select("digest", "text", "keep_id", "group_size"), ["digest", "text"])
        looked_up = looked_up.unionByName(exact.select(looked_up.columns))
    keep = F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id"))
    return looked_up.select(
        F.col("key").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("key").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with all their columns: exactly one row per distinct text."""
    space = Workspace(docs.sparkSession, "exact")
    found = winners(docs, key, text, salts, digest, space)
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body")
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("full"), body)
    rows = rows.withColumn("digest", digest(F.col("full")))
    stay = found.select("digest", F.col("keep_id").alias("key_"), F.col("text").alias("text_"))
    same = (rows["digest"] == stay["digest"]) & rows["key"].eqNullSafe(stay["key_"])
    met = rows.join(stay, same & F.coalesce(stay["text_"] == rows["full"], F.lit(True))).select(rows["digest"], "key", "text_", "body")
    one = met.groupBy("digest", "key", "text_").agg(F.first("body").alias("body"))
    return one.select("body.*")
