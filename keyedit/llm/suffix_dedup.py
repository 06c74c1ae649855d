"""Operator 6, suffix-array removal of repeated byte strings.

Every ``LENGTH``-byte string (a *window*) that also starts earlier is removed where
it occurs again. Windows that are equal choose the same *anchor*: the leftmost
least of their ``K``-byte hashes. Consecutive windows with one anchor form a *run*;
equal windows stand in runs with equal anchor bytes, so runs are dealt out by them.

1. Runs of each document are found in one pass. Runs whose whole bytes stood
   earlier are settled by comparing hashes, within a batch before any shuffle, then
   among all; runs whose anchor is met in no other run need no work.
2. What is left (edges of copies, near copies) is cut out of the texts and goes
   through a logarithmic family of suffix arrays: each new batch of windows is
   sorted, merge-scanned against the existing levels for matches of the whole
   length, and levels of equal size class merge. Batches come in document order, so
   a match in a level lies earlier. Levels of a finished anchor are dropped; an
   anchor with very many runs is dealt out by window instead.
3. Covered bytes are joined to the texts and cut out.

Texts travel compressed. Documents are ordered by doc_id; where ids repeat or are
NULL, rows get numbers by (doc_id, hash of the text) first, NULL ids coming first.

Defined cases: NULL and empty texts have no bytes and lose none; texts shorter than
``LENGTH`` lose none; of repeated rows the first stays; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import slices, stored, table, text_bytes, texts

LENGTH = 100
K = 16
PIECE = 1 << 23            # longest stretch of one text looked at at once
JOINED = 1 << 20           # short texts looked at together
HOT_RUNS = 20_000          # anchors with more open runs are dealt out by window
BATCH_WINDOWS = 100_000    # windows of a new suffix array

_POS_BITS = 24
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the K bytes at each position (K = 16: two words)."""
    n = len(raw) - 7
    words = np.lib.stride_tricks.as_strided(raw, (n, 8), (1, 1)).copy().view(np.uint64).reshape(-1)
    x = words[:-8] * _A
    x ^= x >> np.uint64(29)
    x += words[8:] * _B
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x


def find_runs(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows within the texts that ``bounds`` cut out of ``data``.

    Returns the text, the first window's start in ``data``, the number of windows
    and the hash of the anchor of each run.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty
    raw = np.frombuffer(data, np.uint8)
    h = _gram_hashes(raw)
    key = ((h >> np.uint64(_POS_BITS)) << np.uint64(_POS_BITS)) | np.arange(len(h), dtype=np.uint64)
    width, span = LENGTH - K + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
    owner = (key & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)      # of the window at each position
    text = np.searchsorted(bounds[1:], np.arange(len(owner)), "right")
    valid = np.arange(len(owner)) + LENGTH <= bounds[text + 1]
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(owner)))
    keep = valid[start]
    start, count = start[keep], count[keep]
    return text[start], start, count, h[owner[start]].view(np.int64)


def _merged(doc, s0, nw):
    """Adjacent runs of a document (rows in order) as one."""
    if not len(doc):
        return doc, s0, nw
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s0[1:] != s0[:-1] + nw[:-1])
    at = np.flatnonzero(new)
    return doc[at], s0[at], np.add.reduceat(nw, at)


_RUNS = "h long, sh long, doc long, s0 long, nw long"
_RUN_NAMES = ["h", "sh", "doc", "s0", "nw"]


def _batch(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols],
                                      names=_RUN_NAMES)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of all documents; rows without ``sh`` are settled (their windows stand earlier)."""
    def look(docs: list[int], offsets: list[int], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = b"".join(parts)
        bounds = np.cumsum([0, *map(len, parts)])
        text, start, nw, h = find_runs(data, bounds)
        if not len(text):
            return
        sh = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in
                       zip(start.tolist(), (start + nw + LENGTH - 1).tolist())], np.uint64).view(np.int64)
        doc, s0 = np.array(docs)[text], start - bounds[text] + np.array(offsets)[text]
        both = np.stack([h, sh], axis=1).view("V16").reshape(-1)
        _, first = np.unique(both, return_index=True)
        is_first = np.zeros(len(doc), bool)
        is_first[first] = True
        f = is_first
        yield _batch(h[f], sh[f], doc[f], s0[f], nw[f])
        d, s, n = _merged(doc[~f], s0[~f], nw[~f])
        if len(d):
            yield _batch((d * 1_000_003 + s) & 0x7FFFFFFF, pa.nulls(len(d), pa.int64()), d, s, n)

    for batch in slices(batches, 4096):
        rows = sorted(zip(batch.column("doc").to_pylist(), text_bytes(batch.column("text"))), key=lambda r: r[0])
        docs, offsets, parts, size = [], [], [], 0
        for doc, text in rows:
            for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
                piece = text[at:at + PIECE + LENGTH - 1]
                if parts and size + len(piece) > JOINED:
                    yield from look(docs, offsets, parts)
                    docs, offsets, parts, size = [], [], [], 0
                docs.append(doc)
                offsets.append(at)
                parts.append(piece)
                size += len(piece)
        if parts:
            yield from look(docs, offsets, parts)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, sh, doc, s0): later equal runs are settled, runs that share their anchor stay open."""
    held = None                 # the open anchor's only run so far, not yet passed on
    last = None                 # (h, sh) of the last run
    for batch in batches:
        cols = [batch.column(c) for c in _RUN_NAMES]
        settled = cols[1].is_null().to_numpy(zero_copy_only=False)
        if settled.any():
            yield batch.filter(pa.array(settled))
        keep = pa.array(~settled)
        h, sh, doc, s0, nw = (c.filter(keep).to_numpy() for c in cols)
        if not len(h):
            continue
        rep = np.ones(len(h), bool)
        rep[1:] = (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])
        rep[0] = last != (h[0], sh[0])
        if not rep.all():
            yield _batch(h[~rep], pa.nulls(int((~rep).sum()), pa.int64()), doc[~rep], s0[~rep], nw[~rep])
        # a run goes on if the anchor has another one, before or after it
        h0 = last[0] if last else None
        last = (h[-1], sh[-1])
        r = [x[rep] for x in (h, sh, doc, s0, nw)]
        if not len(r[0]):
            continue
        open_before = np.zeros(len(r[0]), bool)
        open_before[1:] = r[0][1:] == r[0][:-1]
        open_before[0] = h0 is not None and r[0][0] == h0
        if held is not None:
            if open_before[0]:
                yield _batch(*[[x] for x in held])
            held = None
        again = open_before.copy()
        again[:-1] |= open_before[1:]
        if not again[-1]:
            held = [x[-1] for x in r]
        if again.any():
            yield _batch(*[x[again] for x in r])


class Family:
    """Sorted arrays of distinct windows, at most one for each power of two."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def seen(self, new: np.ndarray) -> np.ndarray:
        """Which of the sorted windows stand in a level: one merge scan for each."""
        found = np.zeros(len(new), bool)
        for level in self.levels:
            at = np.searchsorted(level, new)
            found |= level[np.minimum(at, len(level) - 1)] == new
        return found

    def add(self, new: np.ndarray) -> None:
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]).bit_length() <= len(self.levels[-1]).bit_length():
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(np.sort(np.concatenate([a, b])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs with their bytes, sorted by (h, doc, s0): repeated windows as runs."""
    family, anchor = Family(), None

    def scan(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal family, anchor
        if rows[0][0] != anchor:
            family = Family()
        anchor = rows[-1][0]
        nw = np.array([r[3] for r in rows])
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        first = np.cumsum([0, *(len(r[4]) for r in rows)])[:-1]
        row = np.repeat(np.arange(len(rows)), nw)
        place = np.arange(len(row)) - np.repeat(np.cumsum(nw) - nw, nw)
        at = first[row] + place
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(f"S{LENGTH}")
        windows = windows.reshape(-1)
        order = np.argsort(windows, kind="stable")          # equal windows stay in document order
        ranked = windows[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        distinct = ranked[fresh]
        old = family.seen(distinct)
        repeated = np.zeros(len(row), bool)
        repeated[order] = ~fresh | old[np.cumsum(fresh) - 1]
        # only the last anchor can go on in the next batch
        ours = np.array([r[0] == anchor for r in rows])[row[order[fresh]]] & ~old
        if rows[0][0] != anchor:
            family = Family()
        family.add(distinct[ours])
        k = np.flatnonzero(repeated)
        doc = np.array([r[1] for r in rows])[row[k]]
        s0 = np.array([r[2] for r in rows])[row[k]] + place[k]
        d, s, n = _merged(doc, s0, np.ones(len(k), np.int64))
        return _batch(np.zeros(len(d), np.int64), pa.nulls(len(d), pa.int64()), d, s, n)

    rows, windows = [], 0
    for batch in slices(batches, 4096):
        for r in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "s0", "nw", "bytes"))):
            if windows + r[3] > BATCH_WINDOWS and rows:
                yield scan(rows)
                rows, windows = [], 0
            rows.append(r)
            windows += r[3]
    if rows:
        yield scan(rows)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        packed = pa.array([z.compress(t) for t in text_bytes(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), packed],
                                         names=["doc", "doc_id", "z"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the open runs; runs of very frequent anchors window by window."""
    z = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        out: list[tuple] = []
        for doc, packed, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "z", "runs"))):
            text = z.decompress(packed)
            for r in runs:
                s0, nw = r["s0"], r["nw"]
                if r["hot"]:
                    out += [(xxhash.xxh3_64_intdigest(w := text[p:p + LENGTH]) - (1 << 63), doc, p, 1, w)
                            for p in range(s0, s0 + nw)]
                else:
                    out.append((r["h"], doc, s0, nw, text[s0:s0 + nw + LENGTH - 1]))
        if out:
            h, d, s, n, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64()),
                                              pa.array(n, pa.int64()), pa.array(b, pa.binary())],
                                             names=["h", "doc", "s0", "nw", "bytes"])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            size, removed, spans, last = [], [], [], []
            for packed, runs in zip(batch.column("z").to_pylist(), batch.column("runs").to_pylist()):
                text = z.decompress(packed)
                stretches: list[list[int]] = []
                for a, b in sorted((r["s0"], r["s0"] + r["nw"] + LENGTH - 1) for r in runs or ()):
                    if stretches and a <= stretches[-1][1]:
                        stretches[-1][1] = max(b, stretches[-1][1])
                    else:
                        stretches.append([a, b])
                edges = [0, *itertools.chain(*stretches), len(text)]
                kept = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
                left = b"".join(kept)
                size.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(len(stretches))
                last.append(left if with_text else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(last, pa.binary() if with_text else pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if with_text else "kept_sha256"])
    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), itertools.count()
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * n, pa.int64()), pa.array([next(count) for _ in range(n)], pa.int64())],
            names=["doc_id", "text", "part", "at"])


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``doc``: a number that is unique and follows the order of documents."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn("doc", F.col("doc_id"))
    rows = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    rows = stored(rows.sortWithinPartitions("doc_id", "tie").drop("tie").mapInArrow(
        _number, "doc_id long, text string, part long, at long"), "numbered")
    parts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    begin = dict(zip((p for p, _ in parts), itertools.accumulate((n for _, n in parts), initial=0)))
    table_of = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv]) if begin else F.lit(None)
    return rows.select("doc_id", "text", (table_of[F.col("part")] + F.col("at")).alias("doc"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc, s0, nw: windows of each document (doc, text) that stand earlier, as runs."""
    found = docs.select("doc", "text").mapInArrow(_find, _RUNS)
    judged = stored(found.repartition("h").sortWithinPartitions("h", "sh", "doc", "s0").mapInArrow(_settle, _RUNS), "runs")
    open_runs = judged.where("sh is not null").select("h", "doc", "s0", "nw")
    hot = open_runs.groupBy("h").count().where(F.col("count") > HOT_RUNS).select("h", F.lit(True).alias("hot"))
    by_doc = (open_runs.join(hot, "h", "left").groupBy("doc")
              .agg(F.collect_list(F.struct("h", "s0", "nw", "hot")).alias("runs")))
    cut = (by_doc.join(docs.select("doc", "doc_id", "text").mapInArrow(_pack, "doc long, doc_id long, z binary"), "doc")
           .select("doc", "z", "runs").mapInArrow(_cut_out, "h long, doc long, s0 long, nw long, bytes binary"))
    matched = cut.repartition("h").sortWithinPartitions("h", "doc", "s0").mapInArrow(_scan, _RUNS)
    return judged.where("sh is null").select("doc", "s0", "nw").union(matched.select("doc", "s0", "nw"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (or their digest)."""
    docs = _ordered(texts(docs, id_col, text_col))
    runs = repeated_runs(docs).groupBy("doc").agg(F.collect_list(F.struct("s0", "nw")).alias("runs"))
    packed = docs.select("doc", "doc_id", "text").mapInArrow(_pack, "doc long, doc_id long, z binary")
    full = packed.join(runs, "doc", "left")
    kind = "kept binary" if with_text else "kept_sha256 string"
    return full.select("doc_id", "z", "runs").mapInArrow(
        _remove(with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
