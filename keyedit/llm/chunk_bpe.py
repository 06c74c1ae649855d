"""Operator 12, byte-level BPE by reuse of content-defined chunks.

Each text is cut where a rolling hash of its last ``WINDOW`` bytes has its top bits
zero, so equal passages are cut alike in whatever documents they stand. A distinct
chunk is encoded once by itself: the chunks that most documents share are found by a
count over the whole table, encoded in a job of their own and sent to every task (a
list of at most ``SHARED_CHUNKS`` chunks and ``SHARED_BYTES`` bytes); others are
remembered within a task, in two generations of ``TASK_CHUNKS``.

A chunk's ids are right inside it, not at its ends: the splitting rule of the
tokenizer and the merges may reach over the cut. Each join is repaired: the bytes
around it are encoded again, from a word of the left chunk to a word of the right one,
and the window is widened until its first and last word have exactly the ids that they
have in the chunks. Only then do the chunks' own ids go on. A chunk in which no such
word is found becomes part of the window whole.

Chunks are encoded by tiktoken with the ranks of the tokenizers file (that ids follow
the merges is checked when it is loaded), as it is several times faster. Characters that two versions of
Unicode could read differently, and long runs without a space, go to the tokenizers
library itself, as do texts that hold the literal of an added token, which are never cut.

Defined cases: a NULL or empty text has no ids and decodes to "". Repeated rows and
ids, and NULL ids, give a row each. Other columns are ignored; an empty table gives an
empty result. A text without spaces is one window.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyedit.llm.common import Memory, kept, slices_of_size, table, text_bytes, texts

MODEL = "byte_bpe_50k.json"
WINDOW = 8                  # bytes under the rolling hash
CUT_BITS = 11               # a cut for about every 2 ** CUT_BITS bytes
LEAST, MOST = 512, 16384    # bytes of a chunk; only a text's last one may be smaller
LONG_RUN = 512              # bytes without a space, from which the tokenizers library is asked
TASK_CHUNKS = 6_000
SHARED_CHUNKS, SHARED_BYTES = 12_000, 16 << 20

#: Letters, digits, signs and white space that every version of Unicode since 5.0 reads alike.
_ODD = re.compile("[^\x00-\x84\x86-ɏ]")
_LONG = re.compile(f"[^ ]{{{LONG_RUN}}}")
#: A space after a visible ASCII character: a new word starts there, whatever follows or goes before.
_WORD = re.compile(rb"(?<=[\x21-\x7e]) ")


def _mixed(n: int) -> np.ndarray:
    """``n`` well-spread 32-bit numbers (the finaliser of splitmix64)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


_OF_BYTE = _mixed(256)


def cut_places(data: bytes) -> np.ndarray:
    """Places (ascending) before which the rolling hash allows a cut, never inside a character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= WINDOW:
        return np.zeros(0, np.int64)
    h, w = _OF_BYTE[b], 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    at = np.flatnonzero(h[WINDOW - 1:-1] >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    return at[b[at] & 0xC0 != 0x80]


def chunks_of(data: bytes) -> list[bytes]:
    """The text's chunks in order."""
    if len(data) <= LEAST:
        return [data] if data else []
    out, start = [], 0
    for at in [*cut_places(data).tolist(), len(data)]:
        while at - start > MOST:
            end = start + MOST
            while data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(data[start:end])
            start = end
        if at - start >= LEAST or at == len(data):
            if at > start:
                out.append(data[start:at])
            start = at
    return out


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
        self.library = lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.literals = [a.encode() for a in added]
        vocab = spec["model"]["vocab"]
        byte_of = _byte_of_symbol()
        raw = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        size = max([*raw, *added.values()]) + 1
        tokens = {**raw, **{i: text.encode() for text, i in added.items()}}
        self.bytes_of = Strings([tokens.get(i, b"") for i in range(size)])
        self.lengths = self.bytes_of.lengths
        #: Decimals and a comma, filled up with zero bytes.
        self.decimal = np.array([b"%d," % i for i in range(size)])
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        ranks = {b: i for i, b in raw.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)) or len(raw) != 256 + len(merges):
            raise ValueError("ids don't follow the merges: they can't serve as ranks")
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                      mergeable_ranks=ranks)
        self.known = Memory(TASK_CHUNKS)
        self.shared: dict[bytes, np.ndarray] = {}

    def ids(self, data: bytes) -> np.ndarray:
        """Ids of bytes taken by themselves."""
        text = data.decode()
        if not text.isascii() and _ODD.search(text) or len(data) >= LONG_RUN and _LONG.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind)

    def of_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each chunk by itself; a chunk not met before is encoded."""
        found = self.known.find(chunks)
        for k, x in enumerate(found):
            if x is None:
                c = chunks[k]
                if (x := self.shared.get(c)) is None and (x := self.known.new.get(c)) is None:
                    x = self.known.new[c] = self.ids(c)
                found[k] = x
        return found

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a whole text."""
        if any(x in data for x in self.literals):
            return np.array(self.library.encode(data.decode(), add_special_tokens=False).ids, self.kind)
        chunks = chunks_of(data)
        if len(chunks) < 2:
            return self.of_chunks(chunks)[0] if chunks else np.zeros(0, self.kind)
        own = self.of_chunks(chunks)
        out = Joined(self, chunks[0], own[0])
        for chunk, ids in zip(chunks[1:], own[1:]):
            out.append(chunk, ids)
        return out.finish()

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of.joined(ids).decode(errors="replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids' decimals joined by commas."""
        padded = self.decimal[ids].view(np.uint8)
        return padded[padded != 0][:-1].tobytes()

    def digest(self, data: bytes) -> tuple[int, str, str]:
        """How many ids, and SHA-256 of their decimals and of the text decoded from them."""
        ids = self.encode(data)
        return (len(ids), hashlib.sha256(self.decimals(ids)).hexdigest(),
                hashlib.sha256(self.decode(ids).encode()).hexdigest())

    def forget(self) -> None:
        self.known, self.shared = Memory(TASK_CHUNKS), {}


class Strings:
    """Byte strings by id, to be put one after another without a loop over the ids."""

    def __init__(self, values: list[bytes]):
        self.lengths = np.array([len(x) for x in values], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - ends + n, n)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


class Joined:
    """Ids of a text whose chunks are appended one after another.

    ``done`` are settled ids. ``data`` are the bytes after them, from the start of a word,
    and ``ids`` their ids as the last chunk has them. Where ``ids`` is None the bytes in
    ``waiting`` have to be encoded anew instead.
    """

    def __init__(self, encoder: ChunkEncoder, data: bytes, ids: np.ndarray):
        self.encoder, self.done, self.data, self.ids = encoder, [], data, ids
        self.waiting: list[bytes] = []

    def _first(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids cover exactly ``size`` bytes."""
        ends = np.cumsum(self.encoder.lengths[ids[:size]])      # no id is shorter than a byte
        k = int(ends.searchsorted(size)) + 1 if size else 0
        if size and ends[k - 1] != size:
            raise ValueError("an id reaches over the start of a word")
        return k

    def _before(self, at: int) -> int:
        """How many of ``ids`` cover the first ``at`` bytes of ``data``, counted from the end."""
        return len(self.ids) - self._first(self.ids[::-1], len(self.data) - at)

    def append(self, chunk: bytes, own: np.ndarray) -> None:
        words = (m.start() for m in _WORD.finditer(chunk))
        right = list(itertools.islice(words, 2))
        if self.ids is None:
            before, left = b"".join(self.waiting) if len(right) > 1 else b"", [0]
        else:
            before, left = self.data, _last_words(self.data, 2)
        while len(right) > 1:
            window = self.encoder.ids(before[left[0]:] + chunk[:right[-1]])
            head = self.ids[self._before(left[0]):self._before(left[1])] if len(left) > 1 else window[:0]
            a, b = self._first(own, right[-2]), self._first(own, right[-1])
            n = len(window) - (b - a)
            if n >= len(head) and np.array_equal(window[:len(head)], head) and np.array_equal(window[n:], own[a:b]):
                if self.ids is not None:
                    self.done.append(self.ids[:self._before(left[0])])
                self.done.append(window[:n])
                self.data, self.ids, self.waiting = chunk[right[-2]:], own[a:], []
                return
            if len(left) > 1:
                left = _last_words(before, 2 * len(left))
            more = list(itertools.islice(words, len(right)))
            right = right + more if more else []
        # no word to agree on: what is not settled waits for the next chunk
        if self.ids is not None:
            self.done.append(self.ids[:self._before(left[0])])
            self.waiting, self.ids = [self.data[left[0]:]], None
        self.waiting.append(chunk)

    def finish(self) -> np.ndarray:
        return np.concatenate([*self.done, self.encoder.ids(b"".join(self.waiting)) if self.ids is None else self.ids])


def _last_words(data: bytes, n: int) -> list[int]:
    """The last ``n`` places at which a word starts, ascending; the start of the data where there are fewer."""
    out: list[int] = []
    end = len(data)
    while len(out) < n:
        end = data.rfind(b" ", 1, end)
        if end < 1:
            return sorted({0, *out})
        if 0x21 <= data[end - 1] <= 0x7E:
            out.append(end)
    return out[::-1]


def _byte_of_symbol() -> dict[str, int]:
    """Bytes by the visible characters that stand for them in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def encoder(path: str) -> ChunkEncoder:
    return kept("chunks", path, ChunkEncoder)


# ---------------------------------------------------------------- over a table

def _key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices_of_size(batches, size=4 << 20):
        n, found_in = Counter(), {}
        for t, at in zip(text_bytes(batch.column("text")), batch.column("at").to_pylist()):
            chunks = chunks_of(t)
            n.update(chunks)
            found_in.update(dict.fromkeys(chunks, at))
        yield pa.RecordBatch.from_arrays(
            [pa.array([_key(c) for c in n], pa.binary()), pa.array(list(n.values()), pa.int64()),
             pa.array([len(c) for c in n], pa.int64()), pa.array([found_in[c] for c in n], pa.int64())],
            names=["key", "n", "size", "at"])


def _pick(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(keys.value)
        for batch in slices_of_size(batches, size=4 << 20):
            out = []
            for c in {c for t in text_bytes(batch.column("text")) for c in chunks_of(t)}:
                if (k := _key(c)) in left:
                    left.remove(k)
                    out.append((k, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)],
                                             names=["key", "chunk"])
    return run


def _encode_shared(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), pa.array([e.ids(c).tobytes() for c in batch.column("chunk").to_pylist()],
                                                 pa.binary())], names=["chunk", "ids"])
    return run


def shared_chunks(docs: DataFrame, path: str) -> list[tuple[bytes, bytes]]:
    """The chunks that save most when they are encoded once for all tasks, with their ids.

    What is counted is a digest for each distinct chunk of a slice. What comes back is bounded
    by ``SHARED_CHUNKS`` and ``SHARED_BYTES``.
    """
    spark = docs.sparkSession
    docs = docs.select("text", F.xxhash64("text").alias("at"))
    counts = docs.mapInArrow(_count, "key binary, n long, size long, at long").groupBy("key").agg(
        F.sum("n").alias("n"), F.max("size").alias("size"), F.min("at").alias("at"))
    saved = (F.col("n") - 1) * F.col("size")
    top = counts.where("n > 1").orderBy(saved.desc(), "key").limit(SHARED_CHUNKS).collect()
    room = itertools.accumulate(r["size"] for r in top)
    top = [r for r, used in zip(top, room) if used <= SHARED_BYTES]
    if not top:
        return []
    # one text that holds each chunk, by the hash of the text
    places = F.broadcast(spark.createDataFrame([(x,) for x in sorted({r["at"] for r in top})], "at long"))
    holders = docs.join(places, "at", "left_semi").groupBy("at").agg(F.first("text").alias("text"))
    chunks = holders.mapInArrow(_pick(spark.sparkContext.broadcast([bytes(r["key"]) for r in top])),
                                "key binary, chunk binary")
    coded = chunks.dropDuplicates(["key"]).select("chunk").mapInArrow(_encode_shared(path), "chunk binary, ids binary")
    return [(bytes(r["chunk"]), bytes(r["ids"])) for r in coded.collect()]


def _encode(path: str, shared, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        e.shared = {c: np.frombuffer(x, e.kind) for c, x in shared.value}
        for batch in slices_of_size(batches, size=4 << 20, keeps=True):
            data = text_bytes(batch.column("text"))
            if ids:
                found = [e.encode(t) for t in data]
                out = [pa.array([len(x) for x in found], pa.int64()),
                       pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())),
                       pa.array([e.decode(x) for x in found], pa.string())]
            else:
                out = [pa.array(x, t) for x, t in zip(zip(*map(e.digest, data)), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out],
                                             names=["doc_id", "n_tokens", *(("ids", "decoded") if ids else
                                                                            ("ids_sha256", "decoded_sha256"))])
        e.forget()          # the worker may go on to tasks of other stages
    return run


def _encoded(docs: DataFrame, model: str | None, ids: bool, columns: str, id_col: str, text_col: str) -> DataFrame:
    path, docs = model or public_tokenizers.path(MODEL), texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path))
    return docs.mapInArrow(_encode(path, shared, ids), "doc_id long, n_tokens long, " + columns)


def encode_chunked(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every document."""
    return _encoded(docs, model, True, "ids array<int>, decoded string", id_col, text_col)


def chunked_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """As ``encode_chunked``, with SHA-256 digests in place of ids and text."""
    return _encoded(docs, model, False, "ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_digests(table(spark, sf_dir, "documents"))
