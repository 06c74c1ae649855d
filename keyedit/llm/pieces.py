"""Operator 8, SentencePiece encoding and decoding of merge-type vocabularies.

A text is cut before every run of word marks; no piece of the vocabulary spans
such a cut (checked when the model is loaded), so the chunks can be encoded
one by one. A chunk's adjacent symbol pairs wait in an agenda ordered by score,
then by place; the best pair is merged until none is left. The agenda of a chunk of
few symbols is a list in the order of places, that of a longer one a heap. Symbols outside the
vocabulary become byte pieces. Within each Arrow batch the chunks seen for the
first time are also encoded by the sentencepiece library; any difference stops
the job. Chunk results are remembered by a worker until it goes on to another operator,
up to a fixed number of entries (for speed only: results don't depend on it).

Defined cases: a NULL or empty text has no ids and decodes to "". Repeated
rows are encoded one by one; other columns are ignored; an empty table gives an
empty result. Very long chunks (no space) take O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from keyedit.llm.common import Memory, Split, kept, slices_of_size, table, texts

MARK = "▁"
MODEL = "piece_bpe_32k.model"
CACHE_CHUNKS = 120_000     # remembered chunks of a worker, and as many again that were in use before
FEW = 24                   # symbols of a chunk up to which its agenda is a list: searching it costs less than a heap

_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


class MergeVocabulary:
    """The pieces of a merge-type model and the agenda that applies them."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        id_of = {p: i for i, p in enumerate(self.pieces)
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.unknown = sp.unk_id()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in id_of):
            raise ValueError("a piece holds a word mark after another character: texts can't be cut at spaces")
        pairs = {(id_of[p[:k]], id_of[p[k:]]): (-sp.get_score(i), i)
                 for p, i in id_of.items() for k in range(1, len(p)) if p[:k] in id_of and p[k:] in id_of}
        order = {x: k for k, x in enumerate(sorted({x for x, _ in pairs.values()}))}
        #: The place of a pair that makes no piece in the order of scores: after all others.
        self.never = len(order)
        #: A character outside the vocabulary. The same for all: none is ever merged.
        self.outside = size
        #: By left id: right id -> the merged piece's place in the order of scores.
        self.places: list[dict[int, int]] = [{}] * (size + 1)
        #: Merged id by place; None where pieces share a score, these are found by their pair.
        self.merged: list[int | None] = [None] * len(order)
        self.tied: dict[tuple[int, int], int] = {}
        sharing = Counter(x for x, _ in set(pairs.values()))
        for (left, right), (x, i) in pairs.items():
            if not self.places[left]:
                self.places[left] = {}
            self.places[left][right] = order[x]
            if sharing[x] > 1:
                self.tied[left, right] = i
            else:
                self.merged[order[x]] = i
        self.chars = {p: i for p, i in id_of.items() if len(p) == 1}
        self.decimal = [b"%d" % i for i in range(size)]
        #: What a chunk (without its first mark) is encoded to: decimals joined by commas.
        self.known = Memory(CACHE_CHUNKS)
        self.odd: dict[str, str] = {}       # chunks that do not decode to themselves

    def forget(self) -> None:
        self.known, self.odd = Memory(CACHE_CHUNKS), {}

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk, its marks included."""
        outside, chars = self.outside, self.chars
        sym = [chars.get(c, outside) for c in chunk]
        sym = self._merge_few(sym) if len(sym) <= FEW else self._merge_many(sym)
        if outside not in sym:
            return sym
        ids: list[int] = []
        at = 0
        for x in sym:
            if x != outside:
                ids.append(x)
                at += len(self.pieces[x])
            else:
                ids += [self.byte_id[b] for b in chunk[at].encode()] if self.byte_id else [self.unknown]
                at += 1
        return ids

    def _merge_few(self, sym: list[int]) -> list[int]:
        """The agenda as a list: the place in the order of scores of each symbol and the next one."""
        places, merged, never = self.places, self.merged, self.never
        agenda = [places[x].get(y, never) for x, y in zip(sym, sym[1:])]
        while agenda and (best := min(agenda)) < never:
            i = agenda.index(best)
            if (new := merged[best]) is None:
                new = self.tied[sym[i], sym[i + 1]]
            sym[i] = new
            del sym[i + 1], agenda[i]
            if i:
                agenda[i - 1] = places[sym[i - 1]].get(new, never)
            if i < len(agenda):
                agenda[i] = places[new].get(sym[i + 1], never)
        return sym

    def _merge_many(self, sym: list) -> list[int]:
        """The agenda as a heap."""
        places, never, n, push, pop = self.places, self.never, len(sym), heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(place, i, x, y) for i, (x, y) in enumerate(zip(sym, sym[1:]))
                  if (place := places[x].get(y, never)) < never]
        heapq.heapify(agenda)
        while agenda:
            best, i, left, right = pop(agenda)
            j = after[i]
            if j >= n or sym[i] != left or sym[j] != right:
                continue                    # one of the two has been merged meanwhile
            if (new := self.merged[best]) is None:
                new = self.tied[left, right]
            sym[i], sym[j] = new, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (place := places[new].get(sym[k], never)) < never:
                    push(agenda, (place, i, new, sym[k]))
            if (h := before[i]) >= 0 and (place := places[sym[h]].get(new, never)) < never:
                push(agenda, (place, h, sym[h], new))
        return [x for x in sym if x is not None]

    def text_of(self, ids: list[int]) -> str:
        """Decode without removing the leading mark's space."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks (without their first mark) and hold them against the library."""
        new, pieces, decimal = list(chunks), self.pieces, self.decimal
        # the library puts the first mark before a text itself; the empty chunk is a lone mark
        checked = self.library.encode([c.replace(MARK, " ") for c in new], num_threads=1)
        for c, theirs in zip(new, checked, strict=True):
            ids = self.merge(MARK + c)
            if ids != theirs and c:
                raise ValueError(f"agenda and library differ on {c!r}: {ids} and {theirs}")
            self.known.new[c] = b",".join([decimal[i] for i in ids])
            if "".join([pieces[i] for i in ids]) != MARK + c:
                if (back := self.text_of(ids)) != " " + c.replace(MARK, " "):
                    self.odd[c] = back

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, each without its first mark."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]

    def encode(self, column: pa.Array) -> tuple[list[bytes], list[str]]:
        """Ids (decimals joined by commas) and decoded text of each text."""
        texts = pc.fill_null(column, "").to_pylist()
        # texts with runs of spaces or marks of their own are cut by the chunk rule, the others at their spaces
        plain = [t != "" and t[0] != " " and "  " not in t and MARK not in t for t in texts]
        cut = Split(pa.array([t if p else None for t, p in zip(texts, plain)], pa.string()))
        rows = {k: self.chunks(t) for k, (t, p) in enumerate(zip(texts, plain)) if not p}
        if len(self.odd) > CACHE_CHUNKS:
            self.forget()
        values = self.known.find(cut.pieces)
        new = {c for c, x in zip(cut.pieces, values) if x is None}
        if rows:
            others = list(set().union(*rows.values()))
            self.known.limit += len(self.known.new)         # the pieces just found stay
            new.update(c for c, x in zip(others, self.known.find(others)) if x is None)
            self.known.limit = CACHE_CHUNKS
        if new:
            self.learn(new)
            values = [self.known.new[c] if x is None else x for c, x in zip(cut.pieces, values)]
        known = self.known.new
        csv = cut.join(values, b",")
        if self.odd and not self.odd.keys().isdisjoint(cut.pieces):
            for k, t in enumerate(texts):
                if plain[k] and not self.odd.keys().isdisjoint(cs := t.split(" ")):
                    rows[k] = cs
        for k, cs in rows.items():
            csv[k] = b",".join([known[c] for c in cs])
            texts[k] = "".join([self.odd.get(c, " " + c.replace(MARK, " ")) for c in cs])[1:]
        return csv, texts


def vocabulary(path: str) -> MergeVocabulary:
    return kept("pieces", path, MergeVocabulary)


def _encode(path: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices_of_size(batches, size=4 << 20, keeps=True):
            csv, back = v.encode(batch.column("text"))
            out = [batch.column("doc_id"), pa.array([c.count(b",") + 1 if c else 0 for c in csv], pa.int64())]
            if ids:
                out += [pa.array([[int(x) for x in c.split(b",")] if c else [] for c in csv], pa.list_(pa.int32())),
                        pa.array(back, pa.string())]
            else:
                out += [pa.array([hashlib.sha256(c).hexdigest() for c in csv]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids" if ids else "ids_sha256",
                                                         "decoded" if ids else "decoded_sha256"])
    return run


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every document."""
    return texts(docs, id_col, text_col).mapInArrow(
        _encode(model or public_tokenizers.path(MODEL), True),
        "doc_id long, n_tokens long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """As ``encode_pieces``, with SHA-256 digests in place of ids and text."""
    return texts(docs, id_col, text_col).mapInArrow(
        _encode(model or public_tokenizers.path(MODEL), False),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))
