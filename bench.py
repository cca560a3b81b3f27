"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from orderglass.session import get_session
from orderglass.workload import registry

HEADLINE = (
    "enriched_orders", "monthly_summary", "category_summary", "customer_summary", "top_products", "store_summary",
    "raw_quality", "post_quality", "reconciliation", "report_status", "duplicate_rows", "repeated_order_ids",
    "anomalies", "cash_flow", "expense_breakdown", "finance_kpis", "join_safety_lineitem_orders",
    "join_safety_composite", "safe_join_chain", "join_step_diagnostics", "column_profile", "table_roles",
    "relationship_candidates", "mapping_evidence", "unified_orders", "conversion_diagnostics", "preflight_counts",
    "headline_facts", "dashboard_kpis", "text_damage_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
