"""Operator 11, stretches of words that repeat with a period.

A run is a longest stretch of words that are equal ``q`` places apart, ``q`` being its
smallest period, with at least ``exponent`` periods and ``least`` words. On the diagonal
of lag ``q`` a run is a stretch of at least ``max(least, exponent * q) - q`` matches.
Lags are taken in scales ``q .. 2q - 1``; for each, the k-grams of the least such overlap
are indexed by exact names (pairs of names of the power-of-two grams that cover them;
grams found once in their document are left out and with them all longer ones).
As such a k-gram is at least a period long, its next occurrence in a run is one period on:
only neighbouring occurrences are paired, never all pairs. A pair whose lag is in the
scale is a seed. It is extended both ways along its diagonal unless a table with the
furthest place covered on each lag has it already.

Documents are independent; the texts of an Arrow slice are worked on together and
no seed leaves its document.

Defined cases: a NULL or blank text has no words and no runs. Rows are judged one by one,
so repeated rows and ids give a row each. Other columns are ignored; an empty table
gives an empty result. A very long text takes memory in proportion to its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyedit.llm.common import slices_of_size, table, text_bytes, texts

EXPONENT, LEAST = 4, 6
Run = tuple[int, int, int]      # start, length, period


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of the rows; -1 for rows found once."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key * (int(c.max(initial=0)) + 1) + c
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count > 1
    return np.where(again, np.cumsum(again) - 1, -1)[name]


class Grams:
    """Exact names of the grams of 1, 2, 4, ... words that occur again in their document."""

    def __init__(self, words: np.ndarray, document: np.ndarray):
        self.levels = [_names(document, words)]

    def level(self, m: int) -> np.ndarray:
        """Names of the 2 ** m words from each place on; -1: found once, or not that many words."""
        while len(self.levels) <= m:
            below, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(self._paired(below, half))
            if len(self.levels) > 3:
                self.levels[-4] = None      # no gram is covered by shorter ones
        return self.levels[m]

    @staticmethod
    def _paired(below: np.ndarray, shift: int) -> np.ndarray:
        out = np.full(len(below), -1, np.int64)
        at = np.flatnonzero((below[:-shift] >= 0) & (below[shift:] >= 0)) if shift < len(below) else np.zeros(0, int)
        if len(at):
            out[at] = _names(below[at], below[at + shift])
        return out

    def of(self, k: int) -> np.ndarray:
        """Names of the k-grams. Names are a document's own, so no gram reaches over its end."""
        m = k.bit_length() - 1
        names = self.level(m)
        return names if k == 1 << m else self._paired(names, k - (1 << m))


def least_overlap(low: int, high: int, exponent: int, least: int) -> int:
    """The fewest matches that a run of a period in ``low..high`` has on its diagonal."""
    turn = least // exponent
    periods = [q for q in (low, high, turn, turn + 1) if low <= q <= high]
    return min(max(least, exponent * q) - q for q in periods)


def _seeds(grams: Grams, longest: int, exponent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags of neighbouring occurrences, scale by scale."""
    low = 1
    while max(least, exponent * low) <= longest:
        high = 2 * low - 1
        names = grams.of(least_overlap(low, high, exponent, least))
        at = np.flatnonzero(names >= 0)
        if not len(at) and exponent * low >= least:
            return              # from here on overlaps grow, and no longer gram occurs again either
        at = at[np.argsort(names[at], kind="stable")]
        lag = np.diff(at)
        seed = np.flatnonzero((names[at[1:]] == names[at[:-1]]) & (lag >= low) & (lag <= high))
        yield at[seed], lag[seed]
        low *= 2


def _same(words: np.ndarray, a: int, b: int, n: int, step: int) -> int:
    """How many words in a row are equal from ``a`` and ``b`` on (``step`` 1) or before them (-1), ``n`` at most."""
    done, size = 0, 16
    while done < n:
        m = min(size, n - done)
        if step > 0:
            differs = words[a + done:a + done + m] != words[b + done:b + done + m]
        else:
            differs = (words[a - done - m:a - done] != words[b - done - m:b - done])[::-1]
        if differs.any():
            return done + int(differs.argmax())
        done, size = done + m, size * 4
    return done


def _smaller_period(words: np.ndarray, start: int, end: int, q: int) -> bool:
    """Does the stretch of period ``q`` also have a proper divisor of it as a period?

    With two periods or more in the stretch, any smaller period implies one that divides ``q``.
    """
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(words[start:end - d], words[start + d:end]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def find_runs(words: np.ndarray, lengths: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[list[Run]]:
    """The runs of each document, by start and period. ``words`` are ids of all documents' words in order."""
    if exponent < 3:
        raise ValueError("runs are found from three periods on")
    ends = np.cumsum(lengths)
    out: list[list[Run]] = [[] for _ in lengths]
    if not len(words):
        return out
    document = np.repeat(np.arange(len(lengths)), lengths)
    for at, lag in _seeds(Grams(words, document), int(lengths.max()), exponent, least):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # seeds side by side on a lag belong to one stretch: the first of them is enough
        first = np.r_[True, (np.diff(at) != 1) | (np.diff(lag) != 0)] if len(at) else np.zeros(0, bool)
        covered: dict[int, int] = {}
        for i, q in zip(at[first].tolist(), lag[first].tolist()):
            if i < covered.get(q, 0):
                continue
            d = int(document[i])
            begin, end = int(ends[d] - lengths[d]), int(ends[d])
            start = i - _same(words, i, i + q, i - begin, -1)
            stop = i + _same(words, i, i + q, end - i - q, 1)
            covered[q] = stop
            n = stop + q - start
            if n >= max(least, exponent * q) and not _smaller_period(words, start, stop + q, q):
                out[d].append((start - begin, n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when of each run only the first period is kept."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length for its period; ties go to the smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


# ---------------------------------------------------------------- over a table

Place = Callable[[int | None, list[bytes]], list[bytes]]


def _documents(batch: pa.RecordBatch, change: Place | None):
    """Words of each text and the runs in them."""
    words = [t.split() for t in text_bytes(batch.column("text"))]     # bytes split at 20 and 09 to 0D alone
    if change:
        words = [change(d, w) for d, w in zip(batch.column("doc_id").to_pylist(), words)]
    flat = pa.array([w for ws in words for w in ws], pa.binary())
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return zip(words, find_runs(ids, np.array([len(w) for w in words], np.int64)))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed (the text with one period of each run)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_size(batches, size=2 << 20):
            n, runs, kept = [], [], []
            for words, found in _documents(batch, None):
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                stay = collapsed(len(words), found).tolist()
                kept.append(b" ".join([w for w, s in zip(words, stay) if s]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])
    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


_DIGESTS = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                      ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def run_digests(docs: DataFrame, change: Place | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """As ``periodic_runs``: the number of runs, the strongest one and digests. ``change`` may alter a text's words first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_size(batches, size=2 << 20):
            rows = []
            for words, found in _documents(batch, change):
                best = strongest(found)
                if found:
                    stay = collapsed(len(words), found).tolist()
                    words = [w for w, s in zip(words, stay) if s]
                rows.append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                             hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in found)).hexdigest(),
                             hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = zip(*rows) if rows else [[]] * len(_DIGESTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, _DIGESTS))],
                names=["doc_id", *_DIGESTS.names])
    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
             "runs_sha256 string, collapsed_sha256 string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query has them: of every tenth document (by crc32 of its id) the end repeats itself.

    A NULL id has no crc32; its text stays as it is.
    """
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(b"%d" % doc_id)) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), planted)
