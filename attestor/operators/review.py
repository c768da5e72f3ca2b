"""Human review: routing, single-use approvals and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions.text import iso_timestamp, missing
from attestor.session import shuffle_tasks_for, staged


def needs_review(severity: Column | str = "severity", auto_approve: Column | bool = False) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    severe = F.coalesce(severity, F.lit("LOW")).isin(*V.REVIEW_SEVERITIES)
    approved = F.lit(auto_approve) if isinstance(auto_approve, bool) else auto_approve
    return severe & ~approved


def route_reviews(results: DataFrame, auto_approve: Column | bool = False) -> tuple[DataFrame, DataFrame]:
    """(pending, auto): severe results wait for a reviewer, the others go to the ledger."""
    held = needs_review("severity", auto_approve)
    return results.where(held), results.where(~held)


def review_notice(pending: DataFrame) -> DataFrame:
    """The answer given for a held document: count, message and the first violations."""
    count = F.size("violations")
    message = F.concat(
        F.lit(V.NOTICE_MARK), count.cast("string"),
        F.lit(V.NOTICE_PARTS[0]),
        F.col("session_id"), F.lit(V.NOTICE_PARTS[1]),
    )
    return pending.select(
        "doc_id",
        "session_id",
        F.lit(V.AWAITING_REVIEW).alias("status"),
        "severity",
        count.alias("violation_count"),
        message.alias("message"),
        F.slice("violations", 1, V.PREVIEW_VIOLATIONS).alias("preview_violations"),
    )


def first_review(reviews: DataFrame) -> DataFrame:
    """The first review of each session by time, then number.

    A minimum over structs combines on the map side, so a session with very many reviews
    never gathers in one task as it would in a window.
    """
    rest = [c for c in reviews.columns if c not in ("session_id", "review_ts", "review_no")]
    row = F.struct("review_ts", "review_no", *rest)
    return reviews.groupBy("session_id").agg(F.min(row).alias("r")).select("session_id", "r.*")


def repeated_reviews(pending: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of a known session after its first one; each is told the session is gone.

    The first reviews are staged: joined directly, they would pin the reviews to the
    partitioning of their aggregation, and a session with a third of all reviews would be
    one task. Read from a table, the join can be broadcast or its hot partitions split.
    """
    known = first_review(reviews).join(pending.select("session_id"), "session_id", "left_semi")
    first = staged(known.select("session_id", F.col("review_no").alias("first_no")), "first")
    return (
        reviews.join(first, "session_id")
        .where(F.col("review_no") != F.col("first_no"))
        .drop("first_no")
        .withColumn("error", F.lit(V.NO_SESSION))
    )


def unknown_sessions(pending: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of sessions that are not pending."""
    return reviews.join(pending.select("session_id"), "session_id", "left_anti").withColumn(
        "error", F.lit(V.NO_SESSION)
    )


def remaining_pending(pending: DataFrame, reviews: DataFrame) -> DataFrame:
    """Still waiting. Any review takes its session, also one with a bad override."""
    return pending.join(reviews.select("session_id").distinct(), "session_id", "left_anti")


def with_reviews(results: DataFrame, first: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Results joined with the reviews that take them, in so many tasks.

    Results carry whole reports, so a task's sort is to be bounded by rows, whatever the number of
    shuffle partitions and however well reports compress. Both sides are dealt out: of two numbers of
    partitions the planner would take that of an aggregated side.
    """
    return results.repartition(tasks, *keys).join(first.repartition(tasks, *keys), keys)


def apply_reviews(pending: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pending results with the review that takes them. Both are counted first: give stored tables."""
    tasks = max(shuffle_tasks_for(pending), shuffle_tasks_for(reviews))
    return with_reviews(pending, first_review(reviews), ["session_id"], tasks)


def validate_override(df: DataFrame) -> DataFrame:
    """Add override (upper case, null if none) and override_error; empty text is no override."""
    override = F.when(~missing("override_status"), F.upper("override_status"))
    bad = ~F.col("override").isin(V.COMPLIANT, V.NON_COMPLIANT)
    return df.withColumn("override", override).withColumn(
        "override_error", F.when(bad, F.lit(V.BAD_OVERRIDE))
    )


def apply_override(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved, refused) from pending results joined with their reviews.

    Approved rows carry the final status and severity, ``human_review`` (null without
    override and notes) and the report with its own status left as it was in that case.
    """
    checked = validate_override(reviewed)
    refused = checked.where(F.col("override_error").isNotNull())
    accepted = checked.where(F.col("override_error").isNull()).drop("override_error")

    override, notes = F.col("override"), F.col("reviewer_notes")
    overridden, noted = override.isNotNull(), ~missing("reviewer_notes")
    meta = F.struct(
        overridden.alias("status_overridden"),
        F.when(overridden, F.col("status")).alias("original_status"),
        override.alias("new_status"),
        F.when(noted, notes).otherwise(F.lit(V.DEFAULT_OVERRIDE_NOTE)).alias("reviewer_notes"),
        iso_timestamp("review_ts").alias("timestamp"),
    )
    final_status = F.coalesce(override, F.col("status"))
    final_severity = F.when(override == V.COMPLIANT, F.lit("LOW")).otherwise(
        F.coalesce("severity", F.lit("HIGH"))
    )
    changed = F.col("human_review").isNotNull()
    approved = accepted.withColumns({
        "human_review": F.when(overridden | noted, meta),
        "final_status": final_status,
        "final_severity": final_severity,
        "overridden": F.col("override_status").isNotNull(),
    }).withColumns({
        "report_status": F.when(changed, F.col("final_status")).otherwise(F.col("status")),
        "report_severity": F.when(changed, F.col("final_severity")).otherwise(F.col("severity")),
    })
    return approved.drop("override"), refused.drop("override")


def approved_results(approved: DataFrame) -> DataFrame:
    """Approved rows in the form of results: final values outside, report values inside."""
    report = F.col("full_report")
    for field, value in (
        ("status", F.col("report_status")),
        ("severity", F.col("report_severity")),
        ("human_review", F.col("human_review")),
    ):
        report = report.withField(field, value)
    return approved.withColumns({
        "full_report": report,
        "status": F.col("final_status"),
        "severity": F.col("final_severity"),
        "timestamp": F.col("review_ts"),
    })
