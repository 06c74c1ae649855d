"""Scaling check: apply a change set to lineitem replicated xN, with and without a hot key.

    python tests/scale_check.py /root/testdata/sf0.1 10 /tmp/run-XXXX

Writes the replicated tables under the given scratch folder and prints one
JSON line with seconds per plan: ``auto`` (the library measures the change
set and broadcasts it only under the bound), ``shuffle`` (no broadcast), and
the salted plan when one key holds a third of the target rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from keyedit.operators import apply as ap  # noqa: E402
from keyedit.operators.staging import bind_changeset, coerce_changes, stage_as_text  # noqa: E402
from keyedit.plans import fixtures as fx  # noqa: E402
from keyedit.session import get_session  # noqa: E402

OFFSET = 100_000_000


def main(sf_dir: str, factor: int, scratch: str) -> None:
    spark = get_session(app="keyedit-scale", master="local[8]", shuffle_partitions=64,
                        extra={"spark.driver.memory": "16g"})
    rep = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("__r")
    li = fx.table(spark, sf_dir, "lineitem")
    big = li.select(rep, *li.columns).withColumn("l_orderkey", F.col("l_orderkey") + F.col("__r").cast("long") * OFFSET).drop("__r")
    tpath = f"{scratch}/lineitem_x{factor}"
    if not os.path.exists(tpath):
        big.write.parquet(tpath)
    # one key holds a third of the rows
    hpath = f"{scratch}/lineitem_x{factor}_hot"
    if not os.path.exists(hpath):
        spark.read.parquet(tpath).withColumn(
            "l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, F.lit(0)).otherwise(F.col("l_orderkey"))
        ).write.parquet(hpath)

    cs = fx.csl(spark, sf_dir)
    cs = cs.select(rep, *cs.columns).withColumn(
        "key_value", (F.col("key_value").cast("long") + F.col("__r").cast("long") * OFFSET).cast("string")).drop("__r")
    spec = fx.LINEITEM_SPEC
    out = {"factor": factor}
    for label, path, fit in (("auto", tpath, None), ("shuffle", tpath, False), ("hot_key_salted", hpath, False)):
        target = spark.read.parquet(path)
        bound = bind_changeset(cs, spec.update_columns)
        co = coerce_changes(stage_as_text(bound, spec.update_columns), target.schema, spec.key_column,
                            spec.update_columns, spec.not_null)
        if label == "hot_key_salted":
            spark.conf.set("keyedit.skew.hotRows", str(max(target.count() // 100, 1000)))
        t0 = time.perf_counter()
        ap.apply_updates(target, co, spec.key_column, spec.update_columns, changes_fit=fit) \
            .write.format("noop").mode("overwrite").save()
        out[label] = round(time.perf_counter() - t0, 2)
        out[f"{label}_rows"] = target.count()
    spark.conf.unset("keyedit.skew.hotRows")
    print(json.dumps(out))


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]), sys.argv[3])
