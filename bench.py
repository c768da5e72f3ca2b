"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from attestor.plans import queries as registry
from attestor.session import build_session, drop_scratch

HEADLINE = (
    "full_audit", "mask_all", "mask_reports", "redaction_profile", "gate_reasons",
    "assembled_conversations", "triaged_documents", "rule_evaluations", "audit_verdicts",
    "rule_counts", "latest_agent_output", "merged_verdicts", "repeated_reviews",
    "applied_overrides", "ledger_ids", "stored_ledger", "compliance_trend", "latest_logs",
    "report_texts", "streamed_audit", "streamed_approvals",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "attestor-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus))),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="attestor-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.full_audit(spark, sf_dir).limit(1).collect()  # start-up is not measured
    queries = registry.registered()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        drop_scratch(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    line = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }
    if "full_audit" in seconds:
        line["documents_audited_per_minute"] = int(60 * orders / seconds["full_audit"])
    print(json.dumps(line))


if __name__ == "__main__":
    main()
