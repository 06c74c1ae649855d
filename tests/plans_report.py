"""Write PLANS.md: the physical plan tree of the headline queries at a scale factor.

    python tests/plans_report.py /root/testdata/sf0.1 > PLANS.md
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["apply_updates", "apply_updates_lineitem", "row_outcomes_lineitem", "missing_keys",
            "duplicate_pairs", "duplicate_key_rows", "gate_report", "history_view", "audit_scan"]


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0].strip()      # the operator tree, not the per-node details


def main(sf_dir: str) -> None:
    from keyedit.operators import apply as ap
    from keyedit.plans import fixtures as fx
    from keyedit.plans.catalog import QUERIES, _prepared
    from keyedit.session import get_session
    import __spark_entry__  # noqa: F401

    spark = get_session(master="local[8]", shuffle_partitions=16)
    print(f"# Physical plans ({os.path.basename(sf_dir)}, local[8], AQE on)\n")
    print("Generated by `tests/plans_report.py`. The trees are the plans before AQE's")
    print("runtime changes; `BroadcastHashJoin` sides were chosen by the measured bound.\n")
    for name in HEADLINE:
        print(f"## {name}\n\n```\n{tree(QUERIES[name](spark, sf_dir))}\n```\n")
    target, co = _prepared(spark, sf_dir, fx.csl, fx.LINEITEM_SPEC)
    # at scale Spark's own size estimate would not broadcast either side; show that plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("keyedit.skew.hotRows", "7")       # l_orderkey has up to 7 rows: every key is "hot"
    spark.conf.set("keyedit.skew.rowsPerBucket", "8")
    salted = ap.apply_updates(target, co, "l_orderkey", fx.LINEITEM_SPEC.update_columns, changes_fit=False)
    print("## apply_updates_lineitem, change set above the broadcast bound, hot keys salted\n")
    print(f"```\n{tree(salted)}\n```\n")
    spark.conf.set("keyedit.skew.hotRows", "100000000")
    plain = ap.apply_updates(target, co, "l_orderkey", fx.LINEITEM_SPEC.update_columns, changes_fit=False)
    print("## apply_updates_lineitem, change set above the broadcast bound, no hot key\n")
    print(f"```\n{tree(plain)}\n```\n")
    from keyedit.operators.staging import KEY_CAST
    from keyedit.session import checkpoint_by_key
    cp = checkpoint_by_key(co, KEY_CAST)
    reused = ap.apply_updates(target, cp, "l_orderkey", fx.LINEITEM_SPEC.update_columns, check_unique=False,
                              changes_fit=False)
    print("## run_update above the broadcast bound: changes partitioned by key and checkpointed once\n")
    print("Only the target is shuffled; the checkpointed change set keeps its hash partitioning.\n")
    print(f"```\n{tree(reused)}\n```")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
