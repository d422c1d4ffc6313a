"""List queries whose physical plan pairs rows without an equality, or sorts everything in one task."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sitelake.plans import load_all  # noqa: E402
from sitelake.session import local_session  # noqa: E402

SUSPECT = ("BroadcastNestedLoopJoin", "CartesianProduct", "Exchange SinglePartition")


def main(names: list[str]) -> None:
    spark = local_session()
    for name, q in load_all().items():
        if names and name not in names:
            continue
        plan = q.build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        found = {s: plan.count(s) for s in SUSPECT if s in plan}
        if found:
            print(name, found, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
