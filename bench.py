"""Headline queries, timed to a full noop write; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1) and BENCH_QUERIES
(comma-separated names) choose what is run.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from razao import catalog
from razao.session import build_session

HEADLINE = (
    "account_balances", "consolidate", "balance_proof", "daily_movement", "category_summary",
    "daily_balances", "project", "cash_flow_report", "monthly_evolution", "closing_snapshot",
    "invoice_balances", "normalize_text", "match_statement", "greedy_order", "top_rule",
    "plan_auto_apply", "ingest_ofx", "ingest_csv", "ingest_invoices", "match_receivables",
    "settle_invoices", "portfolio_status", "dq_unique", "json_diff",
)


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", cpus)
    queries = catalog.queries()
    timed(queries["scope_filter"], spark, sf_dir)  # starts the engine
    seconds = {}
    for name in names:
        times = [timed(queries[name], spark, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(times), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
