"""Write COVERAGE.md: inventory id to queries, from the registry."""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from sitelake.plans import load_all  # noqa: E402


def main() -> None:
    by_id = defaultdict(list)
    for name, q in load_all().items():
        for item in q.inventory:
            by_id[item].append(f"`{name}`" + ("" if q.sql else " (rows)"))

    def order(item: str):
        return re.sub(r"\d", "", item), int(re.sub(r"\D", "", item))

    lines = ["# Coverage", "", "Inventory id to registered queries. `(rows)` marks queries without a SQL check; tests cover those.", "", "| id | queries |", "| --- | --- |"]
    lines += [f"| {item} | {', '.join(by_id[item])} |" for item in sorted(by_id, key=order)]
    (ROOT / "COVERAGE.md").write_text("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
