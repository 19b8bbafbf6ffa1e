"""Write PLANS.md: for each headline query, the physical plan's
exchanges, joins, aggregates, windows and every parquet scan's pushed
filters and read schema.  Usage: python tools/plan_report.py [sf_dir]"""
from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from bench import HEADLINE  # noqa: E402
from contingo.plans import all_queries  # noqa: E402
from contingo.session import local_session  # noqa: E402

OPS = ["Exchange", "BroadcastExchange", "ReusedExchange", "BroadcastHashJoin", "SortMergeJoin",
       "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "ObjectHashAggregate",
       "SortAggregate", "Window", "Generate", "BatchEvalPython", "ArrowEvalPython"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    qs = all_queries()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plan_report.py` on `{sf_dir}` (local session, AQE on). Counts are operator "
           "occurrences in the physical plan Spark starts from (`Exchange` = shuffle; AQE may still turn a "
           "sort-merge join into a broadcast from measured sizes); scans list what reaches the parquet "
           "reader: the pruned read schema and the pushed filters.", ""]
    for name in [n for n in HEADLINE if n in qs]:
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = Counter()
        for op in OPS:
            counts[op] = len(re.findall(rf"(?<![A-Za-z]){op}\b", plan))
        out.append(f"## {name}")
        out.append("")
        out.append(", ".join(f"{k}: {v}" for k, v in counts.items() if v) or "(no operators counted)")
        out.append("")
        seen = set()
        for m in re.finditer(r"FileScan parquet \[([^\]]*)\][^\n]*?PushedFilters: \[([^\]]*)\][^\n]*?ReadSchema: "
                             r"struct<([^>]*)>", plan):
            key = (m.group(3), m.group(2))
            if key in seen:
                continue
            seen.add(key)
            out.append(f"* scan `{m.group(3)}` pushed `[{m.group(2)}]`")
        out.append("")
    open("PLANS.md", "w").write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
