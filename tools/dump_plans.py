"""Write PLANS.md: formatted physical plans of headline queries (stored sf0.1 tables).

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from innkeep.registry import registry  # noqa: E402
from innkeep.session import build_session  # noqa: E402
from innkeep.sources.bindings import load_tables  # noqa: E402
from innkeep.sources.store import load_stored, store_tables  # noqa: E402

HEADLINE = ["k1_active_per_chain", "q3_available", "status_as_of", "conflict_flags",
            "conflict_rules", "archive_backfill", "occupied_days", "spend_above_average"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(shuffle_partitions=16)
    T = load_tables(spark, sf_dir)
    T = load_stored(spark, store_tables(spark, T), T["_raw"])
    out = ["# Physical plans of headline queries",
           "",
           f"Generated by `tools/dump_plans.py` on stored tables from `{sf_dir}` "
           "(local[*], 16 shuffle partitions, AQE on; plans before AQE re-planning).",
           ""]
    for name in HEADLINE:
        df = registry()[name][0](T)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        plan = re.sub(r"file:\S*/stored/[0-9a-f]+/", "<stored>/", buf.getvalue())
        out += [f"## {name}", "", "```", plan.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
