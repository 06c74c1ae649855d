"""Per-query totals from a Spark event log written by ``bench.py``.

    BENCH_EVENT_LOG=$(mktemp -d /tmp/run-XXXXXX) python bench.py
    python tests/eventlog_summary.py <that folder>

Prints, per query (job description ``bench:<name>``): jobs, stages, input
rows read, shuffle bytes written, and the summed stage time.
"""

from __future__ import annotations

import glob
import json
import sys
from collections import defaultdict


def _lines(folder: str):
    """Event lines of every log under ``folder`` (plain or zstd, rolled folders included)."""
    import io
    for path in sorted(glob.glob(f"{folder}/**/*", recursive=True)):
        name = path.rsplit("/", 1)[-1]
        if not (name.startswith("events_") or name.startswith("local-") or name.startswith("app-")):
            continue
        if path.endswith(".zstd"):
            import zstandard
            with open(path, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(path, encoding="utf-8") as f:
                yield from f


def summarize(folder: str) -> dict:
    stage_query, totals = {}, defaultdict(lambda: defaultdict(float))
    for line in _lines(folder):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            desc = (ev.get("Properties") or {}).get("spark.job.description", "")
            if desc.startswith("bench:"):
                q = desc[len("bench:"):]
                totals[q]["jobs"] += 1
                for sid in ev.get("Stage IDs", []):
                    stage_query[sid] = q
        elif kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            q = stage_query.get(info["Stage ID"])
            if q is None or "Completion Time" not in info or "Submission Time" not in info:
                continue
            t = totals[q]
            t["stages"] += 1
            t["stage_sec"] += (info["Completion Time"] - info["Submission Time"]) / 1000.0
            for acc in info.get("Accumulables", []):
                name, value = acc.get("Name"), acc.get("Value")
                if name == "internal.metrics.shuffle.write.bytesWritten":
                    t["shuffle_write_bytes"] += float(value)
                elif name == "internal.metrics.input.recordsRead":
                    t["input_rows"] += float(value)
    return {q: {k: round(v, 3) for k, v in t.items()} for q, t in totals.items()}


if __name__ == "__main__":
    out = summarize(sys.argv[1])
    print(f"{'query':26s} {'jobs':>4s} {'stages':>6s} {'input rows':>11s} {'shuffle MB':>10s} {'stage s':>8s}")
    for q, t in out.items():
        print(f"{q:26s} {int(t.get('jobs', 0)):4d} {int(t.get('stages', 0)):6d} {int(t.get('input_rows', 0)):11d} "
              f"{t.get('shuffle_write_bytes', 0) / 1e6:10.2f} {t.get('stage_sec', 0):8.2f}")
