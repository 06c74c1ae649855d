"""Operator 4, benchmark decontamination with a distributed positional index.

The index is a table of *segments*: each holds documents whole (bounded by words and
by bytes), the list of their terms, and for each term the ascending places of all its
occurrences. Test phrases are answered segment by segment: the list of a phrase's
rarest term, shifted by the term's offset, is intersected with the next rarest
list, and so on; what is left are the exact matches. Proximity search starts from
the same list and asks for all terms within a width.

The phrases go to the tasks in blocks of a bounded size, one pass over the index
for each block, so neither side has to fit a task. A document lies in one segment.

Defined cases: NULL and empty texts have no words and no hits; items without words
are never found; items that repeat (same id) count once; equal item texts under
different ids all count; a NULL item_id counts as the text "null". Rows that
repeat are answered one by one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import LARGE_ROWS, slices, stored, table, text_bytes, texts

WINDOW = 10
SEGMENT_WORDS = 500_000
SEGMENT_BYTES = 8 << 20    # of its texts, DOC_BYTES more for each: words may be long, texts empty
DOC_BYTES = 64
BLOCK_BYTES = 16 << 20     # of test phrases sent to the tasks at once

#: Upper case to lower case; every ASCII character but digits and letters to a space.
_FOLD = bytes(ord(" ") if i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F
              else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Segment:
    """Positional postings of some documents, their words counted through."""

    def __init__(self, terms: list[bytes], starts: np.ndarray, postings: np.ndarray, doc_ends: np.ndarray):
        self.place = {t: i for i, t in enumerate(terms)}
        self.starts, self.postings, self.doc_ends = starts, postings, doc_ends

    def list_of(self, i: int) -> np.ndarray:
        return self.postings[self.starts[i]:self.starts[i + 1]]

    def whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """Starts whose span ends in the document that it begins in."""
        return at[at + length <= self.doc_ends[np.searchsorted(self.doc_ends, at, "right")]] if len(at) else at

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """Places at which the words stand one after another."""
        found = [self.place.get(w) for w in words]
        if not found or None in found:
            return self.postings[:0]
        order = sorted(range(len(words)), key=lambda k: self.starts[found[k] + 1] - self.starts[found[k]])
        at = self.list_of(found[order[0]]) - order[0]
        for k in order[1:]:
            other = self.list_of(found[k])
            x = np.searchsorted(other, at + k)
            at = at[other[np.minimum(x, len(other) - 1)] == at + k]
            if not len(at):
                return at
        return self.whole(at[at >= 0], len(words))

    def near(self, words: list[bytes], width: int) -> np.ndarray:
        """First places of spans of ``width`` words in one document that hold all of the words."""
        found = {self.place.get(w) for w in words}
        if not found or None in found:
            return self.postings[:0]
        lists = sorted((self.list_of(i) for i in found), key=len)
        out = []
        for p in lists[0].tolist():
            d = np.searchsorted(self.doc_ends, p, "right")
            low = max(p - width + 1, int(self.doc_ends[d - 1]) if d else 0)
            high = min(p + width, int(self.doc_ends[d]))
            close = [x[np.searchsorted(x, low):np.searchsorted(x, high)] for x in lists]
            for a in np.unique(np.concatenate(close)).tolist():
                if a <= p < a + width and all(len(x) and (k := np.searchsorted(x, a)) < len(x) and x[k] < a + width for x in close):
                    out.append(a)
                    break
        return np.unique(np.array(out, self.postings.dtype))


_INDEX = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.binary()),
                    ("terms", pa.list_(pa.binary())), ("starts", pa.binary()), ("postings", pa.binary())])
_INDEX_DDL = "segment string, doc_ids array<long>, doc_ends binary, terms array<binary>, starts binary, postings binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    docs, ends, ids, terms, size, held = [], [], [], _Terms(), 0, 0

    def flush():
        all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(np.bincount(all_ids, minlength=len(terms)))]).astype("<i4")
        return pa.RecordBatch.from_pylist([{
            "segment": f"{part}-{made}", "doc_ids": docs, "doc_ends": np.array(ends, "<i4").tobytes(),
            "terms": list(terms), "starts": starts.tobytes(),
            "postings": np.argsort(all_ids, kind="stable").astype("<i4").tobytes()}], schema=_INDEX)

    for batch in slices(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
            w = words_of(text)
            if docs and (size + len(w) > SEGMENT_WORDS or held + len(text) + DOC_BYTES > SEGMENT_BYTES):
                yield flush()
                made += 1
                docs, ends, ids, terms, size, held = [], [], [], _Terms(), 0, 0
            size += len(w)
            held += len(text) + DOC_BYTES
            docs.append(doc)
            ends.append(size)
            if w:
                ids.append(np.fromiter(map(terms.__getitem__, w), np.int32, len(w)))
    if docs:
        yield flush()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of ``docs``."""
    return stored(texts(docs, id_col, text_col).mapInArrow(_build, _INDEX_DDL), "index", LARGE_ROWS)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        items, phrases = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text"))):
            w = words_of(text)
            for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
                items.append(item)
                phrases.append(b" ".join(w[k:k + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(phrases, pa.binary())],
                                         names=["item_id", "phrase"])


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, phrase: the distinct windows of every item."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"),
                        F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_windows, "item_id string, phrase binary").distinct()


_DIGESTS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_HITS = "segment string, at int, doc_id long, n_words long, spans array<int>, items array<string>"


def _search(phrases: list[tuple[bytes, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            ends = np.frombuffer(r["doc_ends"], "<i4")
            seg = Segment(r["terms"], np.frombuffer(r["starts"], "<i4"), np.frombuffer(r["postings"], "<i4"), ends)
            edge = np.zeros(int(ends[-1]) + 1, np.int32)
            found: list[set[str]] = [set() for _ in ends]
            for phrase, items in phrases:       # split anew each time: kept as words, they take some times the memory
                words = phrase.split()
                at = seg.phrase(words)
                if len(at):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + len(words), -1)
                    for d in np.unique(np.searchsorted(ends, at, "right")).tolist():
                        found[d].update(items)
            hit = np.flatnonzero(np.diff((np.cumsum(edge[:-1]) > 0).astype(np.int8), prepend=0, append=0))
            spans: list[list[int]] = [[] for _ in ends]
            for a, b in hit.reshape(-1, 2).tolist():    # a run of hit words may go over the end of a document
                d = int(np.searchsorted(ends, a, "right"))
                while a < b:
                    begin, end = int(ends[d - 1]) if d else 0, min(b, int(ends[d]))
                    if a < end:
                        spans[d] += [a - begin, end - begin]
                    a, d = max(a, end), d + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["segment"]] * len(ends)), pa.array(range(len(ends)), pa.int32()),
                 pa.array(r["doc_ids"], pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()),
                 pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                names=["segment", "at", "doc_id", "n_words", "spans", "items"])
    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        n_hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            reach = total = 0
            for a, b in sorted(zip(spans[::2], spans[1::2])):
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            items = sorted(set(items))
            n_hit.append(total)
            n_items.append(len(items))
            digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
             pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _phrase_blocks(phrases: DataFrame) -> list[list[tuple[bytes, list[str]]]]:
    """``windows`` rows dealt into blocks by a hash, as many as their measured size asks for."""
    phrases = stored(phrases.groupBy("phrase").agg(F.collect_set("item_id").alias("items")), "phrases")
    size = phrases.agg(F.sum(F.length("phrase") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 8))).first()[0]
    blocks = -(-(size or 0) // BLOCK_BYTES) or 1
    return [[(bytes(r["phrase"]), r["items"]) for r in
             phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()] for k in range(blocks)]


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Exact matches of ``windows`` rows in every document of the index: spans of hit words, items."""
    return _block_hits(index, _phrase_blocks(phrases))


def _block_hits(index: DataFrame, blocks: list[list[tuple[bytes, list[str]]]]) -> DataFrame:
    """Each block of phrases is one pass over the index."""
    parts = [index.mapInArrow(_search(block), _HITS) for block in blocks]
    if len(parts) == 1:
        return parts[0]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    return hits.groupBy("segment", "at").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def near_hits(index: DataFrame, queries: list[str], width: int) -> DataFrame:
    """doc_id, query, position: spans of ``width`` words that hold all words of a query (a bounded list)."""
    wanted = [(q, words_of(q.encode())) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            ends = np.frombuffer(r["doc_ends"], "<i4")
            seg = Segment(r["terms"], np.frombuffer(r["starts"], "<i4"), np.frombuffer(r["postings"], "<i4"), ends)
            rows = []
            for q, words in wanted:
                for a in seg.near(words, width).tolist():
                    d = int(np.searchsorted(ends, a, "right"))
                    rows.append((r["doc_ids"][d], q, a - (int(ends[d - 1]) if d else 0)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                                              pa.array(cols[2], pa.int64())], names=["doc_id", "query", "position"])
    return index.mapInArrow(run, "doc_id long, query string, position long")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    index, blocks = build_index(docs), _phrase_blocks(windows(items))
    if len(blocks) == 1:        # one after the other in one worker: two steps in a row would hold a second worker for each task
        search = _search(blocks[0])
        return index.mapInArrow(lambda batches: _finish(search(batches)), _DIGESTS)
    return _block_hits(index, blocks).select("doc_id", "n_words", "spans", "items").mapInArrow(_finish, _DIGESTS)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP4_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, {_SPLIT} as ws from documents),
i as (select coalesce(cast(item_id as varchar), 'null') as item_id, {_SPLIT} as ws from benchmark),
iw as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[k:k + 9], ' ') as p
       from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as k from i where len(ws) > 0)),
sizes as (select distinct n from iw),
dw as (select rid, k, n, array_to_string(ws[k:k + n - 1], ' ') as p
       from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d cross join sizes where len(ws) >= n)),
m as (select rid, k, n, item_id from dw join iw using (n, p)),
hit as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(k, k + n)) as w from m) group by rid),
it as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s
       from (select distinct rid, item_id from m) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join it using (rid)
"""
