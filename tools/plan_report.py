"""Print a markdown table of each query's final (post-AQE) physical plan.

    python tools/plan_report.py [--sf DIR] > PLANS.md

Each query runs once (noop sink) so AQE has made its runtime choices; the
table counts plan nodes of the final plan only.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = [("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning"),
         ("1-part", r"Exchange SinglePartition"),
         ("BHJ", r"BroadcastHashJoin"), ("SMJ", r"SortMergeJoin"),
         ("BNLJ", r"BroadcastNestedLoopJoin"), ("window", r"\bWindow \["),
         ("generate", r"\bGenerate "), ("subquery", r"Subquery subquery"),
         ("events scans", r"FileScan parquet .*events\.parquet"),
         ("RDD scans", r"Scan ExistingRDD")]


def final_plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    # AdaptiveSparkPlan prints the final plan first, then the initial plan.
    return text.split("+- == Initial Plan ==")[0]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--skip", default="rf_grid_cv,rf_fit_predict,rf_separable,predict_target")
    args = ap.parse_args()
    from cellpulse.session import build_session
    from cellpulse.plans.queries import REGISTRY
    spark = build_session("local[8]", "cellpulse-plans", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    skip = set(args.skip.split(","))
    print(f"# Final physical plans ({os.path.basename(args.sf)}, local[8], AQE on)\n")
    print("Counts of plan nodes in each query's final plan after execution. "
          "Generated by `tools/plan_report.py`.\n")
    print("| key | " + " | ".join(n for n, _ in NODES) + " |")
    print("| --- |" + " --- |" * len(NODES))
    for key, q in REGISTRY.items():
        if key in skip:
            continue
        df = q(spark, args.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = final_plan(df)
        counts = [len(re.findall(p, plan)) for _, p in NODES]
        print(f"| {key} | " + " | ".join(str(c) for c in counts) + " |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
