"""Summarize the physical plan of every batch catalog query.

Usage: python tools/plan_report.py [sf_dir]  -> markdown table on stdout.
Counts shuffle exchanges, partial aggregates, windows, joins, Python
evaluation and pushed scan filters in each query's executed plan (final AQE
plan after one run).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changefold.plans.catalog import BATCH_QUERIES  # noqa: E402
from changefold.session import build_session  # noqa: E402


def summarize(plan: str) -> dict:
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "partial_aggs": len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan))
        + len(re.findall(r"SortAggregate\(key=\[[^\]]*\], functions=\[partial_", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "joins": len(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", plan)),
        "python": len(re.findall(r"(ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan)),
        "take_ordered": "TakeOrderedAndProject" in plan,
        "pushed": "; ".join(p.replace("\n", "\\n") for p in pushed if p) or "-",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(master="local[8]", shuffle_partitions=16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    print("| query | exchanges | broadcasts | partial aggs | windows | joins | python | top-k | scan filters pushed |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, q in BATCH_QUERIES.items():
        df = q(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(
            f"| `{name}` | {s['exchanges']} | {s['broadcasts']} | {s['partial_aggs']} | {s['windows']} | "
            f"{s['joins']} | {s['python']} | {'yes' if s['take_ordered'] else '-'} | {s['pushed']} |"
        )
    spark.stop()


if __name__ == "__main__":
    main()
