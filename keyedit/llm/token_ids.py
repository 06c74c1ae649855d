"""Operator 7, token ids in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id, encoded with the
tokenizers library, and written as Parquet files of *segments*: whole documents
in order, at most ``SEGMENT_IDS`` ids (or one longer document). A segment's ids
are cut into blocks of ``BLOCK_IDS``. A block stores its minimum, a width that
holds ``FIT`` of its values, the packed low bits of all values minus the minimum,
and an exception list (place, whole value) for the values that do not fit; the
segment's index holds the byte at which each block starts. Reading back decodes
blocks, and the place of a document among all ids follows from the totals of the
parts before it (one row for each part).

Texts are cut at single spaces before the library sees them: its byte-level
splitting rule never joins characters across a space that stands between two
visible characters, and every such piece's first id starts with the space. Up to
``MOST_STOPS`` stops after a piece's last letter or digit are a token of that rule by
themselves, so a piece is looked up as a word and its stops. New words are encoded by
the library in one call; results are remembered up to a fixed number of entries (for
speed only). Texts with other white space next to a
space, or with unusual characters there, go to the library whole, as do texts that hold the
literal of an added token (the library makes it that token's id).

Defined cases: a NULL or empty text has the end id alone. Rows with the same
doc_id are all written, ordered by a hash of their text; NULL doc_ids come
first. Other columns are ignored. An empty table gives empty files.
"""

from __future__ import annotations

import itertools
import os
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyedit.llm.common import Memory, Split, gathered, kept, slices, slices_of_size, table, texts
from keyedit.session import scratch_path

MODEL = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1024
SEGMENT_IDS = 1 << 18
FIT = 0.9                  # share of a block's values that its width holds
CACHE_PIECES = 600_000     # and as many again that were in use before
SLICE = 8 << 20            # bytes of texts whose distinct pieces are looked up at once
MOST_STOPS = 4

#: Characters that no reading of the term takes for white space; a piece that starts and ends with them is safe.
_SAFE = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)])) - {"\xad"}
#: Neither letters, digits nor white space; an apostrophe may open a token with the letters after it.
_STOPS = string.punctuation.replace("'", "")
#: Letters and digits in every version of Unicode since 5.0.
_WORD_END = "[0-9A-Za-zÀ-ÖØ-öø-ɏ]$"


# ---------------------------------------------------------------- encoding

def apart(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each piece as a word that ends in a letter or digit and the stops after it, or as it is and no stops."""
    words = pc.ascii_rtrim(pieces, characters=_STOPS)
    n = pc.subtract(pc.binary_length(pieces), pc.binary_length(words))
    n = pc.if_else(pc.and_(pc.less_equal(n, MOST_STOPS), pc.match_substring_regex(words, _WORD_END)), n, 0)
    stops = pa.scalar("")
    for k in range(1, MOST_STOPS + 1):
        stops = pc.if_else(pc.equal(n, k), pc.utf8_slice_codeunits(pieces, -k), stops)
    return pc.if_else(pc.greater(n, 0), words, pieces), stops


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        #: added tokens are found before the text is split, wherever they stand
        self.literals = [a.content for a in t.get_added_tokens_decoder().values()]
        names = t.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)    # ids that start with a space
        for name, i in names.items():
            self.opens[i] = name.startswith("Ġ")
        self.known = Memory(CACHE_PIECES)
        self.firsts = Memory(CACHE_PIECES // 20)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Ids of ' ' + piece; b"" marks pieces that can't be taken by themselves."""
        known = self.known.new
        safe = [p for p in pieces if p and p[0] in _SAFE and p[-1] in _SAFE]
        if len(safe) < len(pieces):
            known.update(dict.fromkeys(set(pieces).difference(safe), b""))
        parts = [safe[at:at + 2000] for at in range(0, len(safe), 2000)]
        coded = self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)
        for part, x in zip(parts, coded):
            ids = np.asarray(x.ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):    # white space inside a piece opens an id of its own
                for p in part:
                    known[p] = self.whole(" " + p)
                continue
            raw, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), len(ids) * 4]
            for p, a, b in zip(part, (starts * 4).tolist(), ends, strict=True):
                known[p] = raw[a:b]

    def first(self, piece: str, more: bool) -> bytes | None:
        """Ids of a text's first piece, which no space precedes."""
        if more and not (piece and piece[0] in _SAFE and piece[-1] in _SAFE):
            return None
        got = self.firsts.find([piece])[0]
        if got is None:
            got = self.firsts.new[piece] = self.whole(piece)
        return got

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        column = pc.fill_null(column, "")
        odd = np.zeros(len(column), bool)
        for x in self.literals:
            odd |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        cut = Split(column)
        words, stops = (x.dictionary_encode() for x in apart(cut.distinct))
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = self.known.find(names)
        new = [p for p, x in zip(names, values) if x is None]
        if new:
            self.learn(new)
            values = [self.known.new[p] if x is None else x for p, x in zip(names, values)]
        coded = pc.binary_join_element_wise(
            pa.array([x or None for x in values], pa.large_binary()).take(words.indices),
            pa.array([self.first(x, False) for x in stops.dictionary.to_pylist()], pa.large_binary()).take(stops.indices),
            pa.scalar(b"", pa.large_binary()))
        rest = cut.join(coded, b"", skip_first=True)
        out, ends, at = [], cut.offsets.to_pylist(), cut.indices.to_numpy()
        for k, (ids, a, b) in enumerate(zip(rest, ends, ends[1:])):
            head = self.first(cut.distinct[at[a]].as_py(), b > a + 1) if ids is not None and b > a and not odd[k] else None
            out.append(head + ids if head is not None else self.whole(column[k].as_py()))
        return out


def encoder(path: str) -> Encoder:
    return kept("token ids", path, Encoder)


# ---------------------------------------------------------------- blocks

_HEAD = np.dtype([("min", "<u4"), ("n", "<u2"), ("exceptions", "<u2"), ("width", "u1"), ("pad", "u1")])


def _eight(w: int) -> Iterator[tuple[int, np.uint64, range]]:
    """Eight values of ``w`` bits take ``w`` bytes: for each, its first bit within a byte and its bytes."""
    for k in range(8):
        yield k, np.uint64(k * w % 8), range(k * w // 8, (k * w + w - 1) // 8 + 1)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of the ids one after another, and the byte at which each starts."""
    n = len(ids)
    m = -(-n // BLOCK_IDS)
    if not m:
        return b"", np.zeros(0, "<u4")
    v = np.resize(ids.astype("<u4"), m * BLOCK_IDS)
    v[n:] = ids[-1]
    v = v.reshape(m, BLOCK_IDS)
    low = v.min(axis=1)
    v = v - low[:, None]
    fit = np.partition(v, int(FIT * BLOCK_IDS), axis=1)[:, int(FIT * BLOCK_IDS)]
    width = np.ceil(np.log2(fit.astype(np.float64) + 1)).astype(int)
    count = np.full(m, BLOCK_IDS)
    count[-1] = n - (m - 1) * BLOCK_IDS
    packed: list[bytes] = [b""] * m
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            eights = (v[at].astype("<u8") & np.uint64((1 << w) - 1)).reshape(len(at), -1, 8)
            rows = np.zeros((len(at), BLOCK_IDS // 8, w), "u1")
            for k, shift, places in _eight(w):
                x = eights[:, :, k] << shift
                for byte, j in enumerate(places):
                    rows[:, :, j] |= (x >> np.uint64(8 * byte)).astype("u1")
            for k, row in zip(at, rows):
                packed[k] = row.tobytes()
    over_row, over_at = np.nonzero(v >> np.minimum(width, 31).astype("<u4")[:, None])
    cuts = np.searchsorted(over_row, np.arange(m + 1))
    heads = np.zeros(m, _HEAD)
    heads["min"], heads["n"], heads["width"] = low, count, width
    heads["exceptions"] = np.diff(cuts)
    out, starts, size = [], np.zeros(m, "<u4"), 0
    for k in range(m):
        e = slice(cuts[k], cuts[k + 1])
        block = b"".join((heads[k].tobytes(), packed[k], over_at[e].astype("<u2").tobytes(),
                          v[k, over_at[e]].tobytes()))
        out.append(block)
        starts[k] = size
        size += len(block)
    return b"".join(out), starts


def unpack_blocks(payload: bytes, starts: np.ndarray) -> np.ndarray:
    m = len(starts)
    if not m:
        return np.zeros(0, "<u4")
    raw = np.frombuffer(payload, "u1")
    heads = np.frombuffer(b"".join(payload[s:s + _HEAD.itemsize] for s in starts.tolist()), _HEAD)
    v = np.zeros((m, BLOCK_IDS), "<u4")
    body = starts.astype(np.int64) + _HEAD.itemsize
    for w in np.unique(heads["width"]):
        w = int(w)
        at = np.flatnonzero(heads["width"] == w)
        if w:
            size = w * BLOCK_IDS // 8
            rows = np.stack([raw[s:s + size] for s in body[at].tolist()]).reshape(len(at), -1, w)
            eights = np.zeros((len(at), BLOCK_IDS // 8, 8), "<u8")
            for k, shift, places in _eight(w):
                for byte, j in enumerate(places):
                    eights[:, :, k] |= rows[:, :, j].astype("<u8") << np.uint64(8 * byte)
                eights[:, :, k] >>= shift
            v[at] = (eights & np.uint64((1 << w) - 1)).reshape(len(at), BLOCK_IDS)
    for k in np.flatnonzero(heads["exceptions"]):
        e, at = int(heads["exceptions"][k]), int(body[k]) + int(heads["width"][k]) * BLOCK_IDS // 8
        v[k, np.frombuffer(payload, "<u2", e, at)] = np.frombuffer(payload, "<u4", e, at + 2 * e)
    v += heads["min"][:, None]
    return v.reshape(-1)[:(m - 1) * BLOCK_IDS + int(heads["n"][-1])]


# ---------------------------------------------------------------- files

SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                      ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                      ("block_starts", pa.binary()), ("payload", pa.binary())])
_DDL = ("part int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, "
        "block_starts binary, payload binary")


def _segments(path: str, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        segment = itertools.count()
        first, docs, ids, size = 0, [], [], 0

        def flush():
            nonlocal first, docs, ids, size
            payload, starts = pack_blocks(np.frombuffer(b"".join(ids), "<u4"))
            row = {"part": part, "segment": next(segment), "first": first, "n_ids": size, "doc_ids": docs,
                   "lengths": [len(x) // 4 for x in ids], "block_starts": starts.tobytes(), "payload": payload}
            first, docs, ids, size = first + size, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=SEGMENTS)

        for batch in slices_of_size(gathered(batches, size=SLICE), size=2 * SLICE, keeps=True):
            for doc, x in zip(batch.column("doc_id").to_pylist(),
                              enc.encode(batch.column("text"))):
                x += end
                if size and size + len(x) // 4 > SEGMENT_IDS:
                    yield flush()
                docs.append(doc)
                ids.append(x)
                size += len(x) // 4
        if docs:
            yield flush()
    return run


def write_token_ids(docs: DataFrame, path: str, model: str | None = None, end_id: int = END_ID,
                    id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and write the segments of ``docs`` in ascending order of their ids."""
    rows = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    rows.mapInArrow(_segments(model or public_tokenizers.path(MODEL), end_id), _DDL).write.parquet(path)


def _part_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each part. One row for each part comes to the driver, none for documents."""
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    return dict(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0)))


def _documents(starts: dict[int, int], ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            all_ids = unpack_blocks(r["payload"], np.frombuffer(r["block_starts"], "<u4"))
            ends = np.cumsum(r["lengths"])
            begins = ends - r["lengths"]
            cut = [all_ids[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
            last = (pa.array([x.astype(np.int64) for x in cut], pa.list_(pa.int64())) if ids
                    else pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["first"] + starts[r["part"]], pa.int64()),
                 pa.array(r["lengths"], pa.int64()), last],
                names=["doc_id", "start", "n_tokens", "ids" if ids else "ids_crc32"])
    return run


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every written document."""
    s = spark.read.schema(_DDL).parquet(path)
    return s.mapInArrow(_documents(_part_starts(s), True), "doc_id long, start long, n_tokens long, ids array<long>")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    s = spark.read.schema(_DDL).parquet(path)
    return s.mapInArrow(_documents(_part_starts(s), False),
                        "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"token-ids-{uuid.uuid4().hex}")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return read_token_digests(spark, path)
