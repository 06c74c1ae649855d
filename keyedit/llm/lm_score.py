"""Operator 2, language-model scores.

A log-bilinear model over all words: the vectors of the last ``ORDER`` words'
entries, each scaled for its place, add up to a predicted vector; an entry's
score is its inner product with that vector plus a bias. Every word that makes up
more than one in ``OWN`` training tokens has an entry of its own (there are fewer
than ``OWN``); each other word, seen or not, belongs to one of ``BINS`` entries by
its crc32, as a context and as a word to be predicted. A bin's probability is
divided among its words, and one not seen, by add-half counts of the whole training
corpus, so the probabilities of all words add up to one.

The model is trained in numpy by noise-contrastive estimation over all training
tokens: every partition trains its copy, and the copies are averaged by their token
counts, round by round. An entry's score is a sum over the context's words, so the
normalising sums of all contexts are products of matrices with a row for each entry.

Counts cover the whole training corpus. Words that make up more than one in
``HEAD`` tokens (at most ``HEAD`` words) are sent to the tasks; the others are
joined by word, so the count table may have any size.

Defined cases: a NULL or empty text has one token, the end. A NULL doc_id is a
training row. With no training rows all counts are 0, the base score is
log10(0.5 / 0.5) = 0 for each token, and the model holds its entries for equally
likely. Repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import crc_bucket, slices, stored, table, text_bytes, texts

END = b""                  # no word is empty
OWN = 4_000                # a word that is more than one in so many tokens has its own entry
BINS = 1_024               # entries of all other words
DIMENSION = 16
ORDER = 2                  # context words
NOISE = 64                 # noise words, shared by a batch
BATCH = 4096
ROUNDS = 1                 # passes over the training tokens
RATE = 0.05
FIRST_SQUARE = 1e-7        # below the gradients of entries that are met rarely
HEAD = 500_000
SEED = 11

END_ID = 0


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()),
                                          pa.array(list(total.values()), pa.int64())], names=["token", "c"])
        total.clear()
        return out

    for batch in slices(batches):
        for t in text_bytes(batch.column("text")):
            total.update(tokens(t))
        if len(total) > 200_000:
            yield flush()
    if total:
        yield flush()


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over all rows of ``docs`` (doc_id, text)."""
    return docs.mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class LogBilinear:
    """Parameters as one flat vector, so that copies can be averaged."""

    def __init__(self, unigram: np.ndarray):
        rng = np.random.default_rng(SEED)
        v = len(unigram)
        self.unigram = unigram / unigram.sum()
        self.context = rng.normal(0, 0.1, (v, DIMENSION)).astype(np.float32)
        self.place = np.ones((ORDER, DIMENSION), np.float32)
        self.target = rng.normal(0, 0.1, (v, DIMENSION)).astype(np.float32)
        self.bias = np.log(self.unigram).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.place, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at:at + p.size].reshape(p.shape)
            at += p.size

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """Vectors of contexts, shape (n, ORDER)."""
        return sum(self.context[contexts[:, k]] * self.place[k] for k in range(ORDER))

    def log_sums(self) -> np.ndarray:
        """Log normalising sum of every context, shape (V,) * ORDER."""
        v = len(self.bias)
        factors, top = [], 0.0
        for k in range(ORDER):
            x = (self.context * self.place[k]).astype(np.float64) @ self.target.T.astype(np.float64)
            x += self.bias if k == 0 else 0
            high = x.max(axis=1)
            factors.append(np.exp(x - high[:, None]))
            top = np.add.outer(top, high)
        left = factors[0]
        for f in factors[1:-1]:
            left = (left[:, None, :] * f).reshape(-1, v)
        sums = left @ factors[-1].T if ORDER > 1 else left.sum(axis=1)
        return (np.log(sums).reshape((v,) * ORDER) + top).astype(np.float32)


def contexts_of(ids: np.ndarray) -> np.ndarray:
    """The last ORDER ids before each id; ends stand before the text."""
    padded = np.concatenate([np.full(ORDER, END_ID), ids])
    return np.stack([padded[ORDER - 1 - k:len(padded) - 1 - k] for k in range(ORDER)], axis=1)


def _add_rows(shape, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    index = index.astype(np.min_scalar_type(shape[0]))      # short keys are sorted by radix
    order = np.argsort(index, kind="stable")
    ranked = index[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out[ranked[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive steps with per-parameter step sizes."""

    def __init__(self, model: LogBilinear, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.squares = [np.full(p.shape, FIRST_SQUARE, np.float32) for p in model.parts()]
        self.cumulative = np.cumsum(model.unigram)
        self.log_noise = np.log(NOISE * model.unigram).astype(np.float32)

    def step(self, ids: np.ndarray, contexts: np.ndarray) -> None:
        m, n = self.model, len(ids)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(m.bias) - 1)
        q = m.predicted(contexts)
        true, false = m.target[ids], m.target[noise]
        s = (q * true).sum(axis=1) + m.bias[ids] - self.log_noise[ids]
        g_true = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - 1
        s = q @ false.T + (m.bias[noise] - self.log_noise[noise])
        g_false = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        d_q = g_true[:, None] * true + g_false @ false
        d_target = _add_rows(m.target.shape, ids, g_true[:, None] * q)
        np.add.at(d_target, noise, g_false.T @ q)
        d_bias = np.bincount(ids, g_true, len(m.bias)) + np.bincount(noise, g_false.sum(axis=0), len(m.bias))
        d_context, d_place = np.zeros_like(m.context), np.zeros_like(m.place)
        for k in range(ORDER):
            d_context += _add_rows(m.context.shape, contexts[:, k], d_q * m.place[k])
            d_place[k] = (d_q * m.context[contexts[:, k]]).sum(axis=0)
        for p, g, sq in zip(m.parts(), (d_context, d_place, d_target, d_bias), self.squares):
            g = (g / n).astype(np.float32)
            sq += g * g
            p -= RATE * g / np.sqrt(sq)


class Entries(dict):
    """The entry of each word: its own, or its bin."""

    def __init__(self, own: list[bytes]):
        super().__init__({END: END_ID} | {w: k + 1 for k, w in enumerate(own)})
        self.first_bin, self.bins = len(self), BINS

    def __missing__(self, word: bytes) -> int:
        return self.first_bin + zlib.crc32(word) % self.bins

    def __reduce__(self):
        return _entries, (dict(self), self.first_bin, self.bins)


def _entries(items: dict[bytes, int], first_bin: int, bins: int) -> Entries:
    out = Entries([])
    out.update(items)
    out.first_bin, out.bins = first_bin, bins
    return out


def _train(model: LogBilinear, entries: Entries, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        trainer = Trainer(model, SEED + 1000 * round_ + part)
        seen, ids, before, held = 0, [], [], 0
        for batch in slices(batches):
            for t in text_bytes(batch.column("text")):
                w = tokens(t)
                x = np.fromiter(map(entries.__getitem__, w), np.int64, len(w))
                ids.append(x)
                before.append(contexts_of(x))
                held += len(x)
            if held >= BATCH:
                x, c = np.concatenate(ids), np.concatenate(before)
                full = held // BATCH * BATCH
                for at in range(0, full, BATCH):
                    trainer.step(x[at:at + BATCH], c[at:at + BATCH])
                seen, held, ids, before = seen + full, held - full, [x[full:]], [c[full:]]
        if held:
            trainer.step(np.concatenate(ids), np.concatenate(before))
            seen += held
        if seen:
            flat = model.flat() * seen
            blocks = np.array_split(flat, 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()),
                 pa.array(blocks, pa.list_(pa.float64()))], names=["block", "n", "sums"])
    return run


class _Known(dict):
    """A dictionary with one value for all that is missing."""

    def __init__(self, items, missing: int):
        super().__init__(items)
        self.missing = missing

    def __missing__(self, _):
        return self.missing


def _average(t: pa.Table) -> pa.Table:
    n, sums = 0, 0.0
    for batch in t.to_batches():        # a row of some KB for each partition
        for k, x in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist()):
            n, sums = n + k, sums + np.asarray(x)
    return pa.table({"block": t.column("block")[:1], "sums": pa.array([sums / n], pa.list_(pa.float64()))})


class Scorer:
    """What scoring needs in the tasks: model, normalising sums, counts of the head."""

    def __init__(self, model: LogBilinear, entries: Entries, shared: np.ndarray, head: list[tuple[bytes, int]]):
        self.model, self.sums, self.entries = model, model.log_sums(), entries
        self.shared = np.log10(shared)      # what a bin's words divide its probability by; own entries have 1
        self.words = [w for w, _ in head]
        self.ids = np.array([entries[w] for w in self.words] + [END_ID], np.int64)
        self.logs = np.array([np.log10(c + 0.5) for _, c in head] + [0.0])      # the last stands for words to be joined

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, m = TaskContext.get().partitionId(), 0, self.model
        place = _Known(zip(self.words, range(len(self.words))), len(self.words))
        for batch in slices(batches):
            rows = []
            for t in text_bytes(batch.column("text")):
                w = tokens(t)
                k = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
                ids, logs = self.ids[k], self.logs[k]
                other = [(i, w[i]) for i in np.flatnonzero(k == len(self.words)).tolist()]
                for i, x in other:
                    ids[i] = self.entries[x]
                c = contexts_of(ids)
                score = ((m.predicted(c) * m.target[ids]).sum(axis=1) + m.bias[ids]
                         - self.sums[tuple(c[:, j] for j in range(ORDER))]).astype(np.float64)
                rare = Counter([x for _, x in other])
                share = logs[ids >= self.entries.first_bin].sum() - self.shared[ids].sum()
                rows.append((len(w), len(w) - len(other), float(logs.sum()), float(score.sum() / np.log(10) + share),
                             list(rare.keys()), list(rare.values())))
            n = batch.num_rows
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + n) + (part << 33), pa.int64()), batch.column("doc_id"),
                 *(pa.array(x, kind) for x, kind in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(),
                                                               pa.list_(pa.binary()), pa.list_(pa.int64()))))],
                names=["row", "doc_id", "n_tokens", "n_head", "logs", "model", "rare", "rare_n"])
            at += n


_SCORED = ("row long, doc_id long, n_tokens long, n_head long, logs double, model double, "
           "rare array<binary>, rare_n array<long>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 5) == 1, F.lit(False))


def fit(training: DataFrame, counts: DataFrame) -> tuple[LogBilinear, Entries, np.ndarray, dict[bytes, int]]:
    """The model, the entries of its words, what each entry's words share, and the counts of the words with their own."""
    total = counts.agg(F.sum("c")).first()[0] or 0
    # fewer than OWN rows, however many words the table has
    own = {bytes(r["token"]): r["c"] for r in
           counts.where((F.col("c") * OWN > total) & (F.col("token") != F.lit(END))).orderBy(F.desc("c"), "token").collect()}
    end = counts.where(F.col("token") == F.lit(END)).first()
    entries = Entries(list(own))
    known = own | ({END: end["c"]} if end else {})
    # every word's count is in its bin's mass; those with an entry of their own are taken out again
    mass = np.full(BINS, 0.5)
    for r in counts.groupBy(F.pmod(F.crc32("token"), F.lit(BINS)).alias("bin")).agg(
            F.sum(F.col("c") + 0.5).alias("mass")).collect():
        mass[r["bin"]] += r["mass"]
    for w, c in known.items():
        mass[zlib.crc32(w) % BINS] -= c + 0.5
    unigram = np.array([(end["c"] if end else 0) + 0.5, *(c + 0.5 for c in own.values()), *mass])
    shared = np.concatenate([np.ones(len(own) + 1), mass])
    model = LogBilinear(unigram)
    for k in range(ROUNDS if total else 0):
        blocks = (training.mapInArrow(_train(model, entries, k), "block int, n long, sums array<double>")
                  .groupBy("block").applyInArrow(_average, "block int, sums array<double>").collect())
        model.load(np.concatenate([r["sums"] for r in sorted(blocks, key=lambda r: r["block"])]))
    return model, entries, shared, known


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out; score all."""
    docs = texts(docs, id_col, text_col)
    training = docs.where(~held_out(F.col("doc_id")))
    counts = stored(count_tokens(training), "token-counts")
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] or 0, size["v"]
    model, entries, shared, known = fit(training, counts)
    head = known | {bytes(r["token"]): r["c"] for r in counts.where(F.col("c") * HEAD > n).collect()}
    spark = docs.sparkSession
    scorer = spark.sparkContext.broadcast(Scorer(model, entries, shared, list(head.items())))
    scored = stored(docs.mapInArrow(lambda b: scorer.value.run(b), _SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select(
        "row", F.col("x.rare").alias("token"), F.col("x.rare_n").alias("k"))
    rare = rare.join(counts.where(F.col("c") * HEAD <= n), "token", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    full = scored.drop("rare", "rare_n").join(rare, "row", "left").fillna(0, ["rare_logs", "rare_known"])
    base = float(np.log10(n + 0.5 * (v + 1)))
    return full.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.col("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.col("rare_logs")).alias("score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
