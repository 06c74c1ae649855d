"""Operator 3, language identification by cross-parsing.

A bounded labelled sample of each language is turned into a suffix automaton. A
text is parsed against each automaton into longest matches; the language that
needs the fewest phrases, normalised by sample and text length, wins. Parsing
takes the whole text, in blocks of ``BLOCK`` characters that start a new phrase, so
that many blocks step through the automata together.

Characters: lower-cased letters; every run of others is one space. The ``LETTERS`` most
frequent letters of the samples have a class each. Others are spelt by four symbols (five
beyond 10,000 letters), each from classes of its own, so that no two letters are one. A letter
that no sample holds is a phrase by itself.

A sample is made of pieces of ``PIECE`` characters, distinct by content: of each language those with the
smallest hashes, up to its share. Texts of any length give pieces, so no labelled language is lost.

Defined cases: a NULL text or one without a letter is ``und`` with score 0, and so
is everything when there is no labelled text. Ties go to the language that sorts
first. Repeated rows are judged one by one; lang and other columns of the judged
rows play no part. Languages are taken as few: all samples together hold
``SAMPLE_CHARS`` characters, or a piece for each language where that is more, whatever the
size of the table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyedit.llm.common import crc_bucket, on_workers, slices, table, texts

SAMPLE_CHARS = 128_000     # of labelled text, shared evenly by the languages
BLOCK = 512
SPACE, PAD = 0, 1          # classes before those of letters
LETTERS, SHARED = 120, 40  # most frequent letters with a class each; classes of the symbols that spell the others
PIECE = 400                # characters of the pieces that a sample is made of


def normal_text(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """All substrings of a sequence of classes."""

    def __init__(self, classes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in classes:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class CrossParser:
    """Step table of all languages: entry = 4 * (row of the next state) + phrases that end."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seen = Counter("".join(samples.values()).replace(" ", ""))
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        own, rest = letters[:LETTERS], letters[LETTERS:]
        self.width = width = len(own) + (SHARED if rest else 0) + 3    # and space, padding, unknown letter
        self.classes = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                self.classes[i] = width - 1
        for k, c in enumerate(own):
            self.classes[ord(c)] = k + 2
        digits = 4 if len(rest) <= 10_000 else 5
        base = SHARED // digits
        #: symbols of the letters without a class: row 0 is no letter
        self.spelt = np.zeros((len(rest) + 1, digits), np.int32)
        self.rare = np.zeros(0x110000, np.int32)
        for k, c in enumerate(rest):
            self.rare[ord(c)] = k + 1
            self.spelt[k + 1] = [len(own) + 2 + d * base + k // base ** d % base for d in range(digits)]
            self.classes[ord(c)] = self.spelt[k + 1, 0]
        tables, self.roots, self.bits, states = [], [], [], 0
        for name in self.languages:
            s = samples[name]
            auto = SuffixAutomaton(self.symbols(s).tolist())
            root = states * width
            start = np.full(width, root * 4 + 2, np.int64)      # unknown: the phrase ends, and so does the letter's own
            for c, to in auto.next[0].items():
                start[c] = (states + to) * width * 4 + 1        # the phrase ends; the next one starts with this class
            t = np.tile(start, (len(auto.next), 1))
            t[0] = root * 4 + 1
            for i, row in enumerate(auto.next):
                for c, to in row.items():
                    t[i, c] = (states + to) * width * 4
            t[:, PAD] = (states + np.arange(len(t))) * width * 4
            tables.append(t.reshape(-1))
            self.roots.append(root)
            self.bits.append(math.log2(len(s) + 1))
            states += len(auto.next)
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """Classes of a lower-cased text: of each run of others only the first stays, rare letters are spelt."""
        at = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        c = self.classes[at]
        keep = c != SPACE
        keep[1:] |= keep[:-1]
        if not (c != SPACE).any():
            return c[:0]
        c, rare = c[keep], self.rare[at[keep]]
        if not rare.any():
            return c
        digits = self.spelt.shape[1]
        size = np.where(rare > 0, digits, 1)
        out = np.repeat(c, size)
        first = (np.cumsum(size) - size)[rare > 0]
        for d in range(1, digits):
            out[first + d] = self.spelt[rare[rare > 0], d]
        return out

    def parse(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language, and letters and spaces parsed, of each text."""
        cut, sizes = [], []
        for t in rows:
            c = self.symbols(t.lower())
            sizes.append(len(c))
            cut.append(np.concatenate([c, np.full(-len(c) % BLOCK, PAD, np.int32)]))
        sizes = np.array(sizes)
        blocks = -(-sizes // BLOCK)
        phrases = np.zeros((len(self.languages), len(rows)), np.int64)
        total = int(blocks.sum())
        if total and len(self.languages):
            steps = np.ascontiguousarray(np.concatenate(cut).reshape(total, BLOCK).T)
            state = np.repeat(np.array(self.roots, np.int32)[:, None], total, axis=1)
            count = np.zeros(state.shape, np.int32)
            for c in steps:
                v = self.table.take(state + c)
                count += v & 3
                state = v >> 2
            count += state != np.array(self.roots)[:, None]
            owner = np.repeat(np.arange(len(rows)), blocks)
            for k in range(len(self.languages)):
                phrases[k] = np.bincount(owner, count[k], len(rows))
        return phrases, sizes

    def predict(self, rows: list[str]) -> tuple[list[str], list[float]]:
        phrases, sizes = self.parse(rows)
        if not self.languages:
            return ["und"] * len(rows), [0.0] * len(rows)
        cost = phrases * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = cost.argmin(axis=0)
        ranked = np.sort(cost, axis=0)
        second = ranked[1] if len(cost) > 1 else ranked[0] * 2
        score = second / np.maximum(ranked[0] + second, 1e-12)
        return ([self.languages[b] if n else "und" for b, n in zip(best, sizes)],
                [float(s) if n else 0.0 for s, n in zip(score, sizes)])


def sample_languages(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A sample of each language's text (text, lang), chosen by a hash of its pieces."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not totals:
        return {}
    share = max(chars // len(totals), PIECE)
    wanted = 2 * -(-share // PIECE)         # letters alone are fewer than characters
    cut = F.expr(f"explode(transform(sequence(0, (length(text) - 1) div {PIECE}), i -> substring(text, i * {PIECE} + 1, {PIECE})))")
    pieces = rows.select("lang", cut.alias("piece")).where(F.col("piece").rlike(r"\p{L}"))
    pieces = pieces.withColumn("h", F.pmod(F.xxhash64("lang", "piece"), F.lit(1 << 40)))
    picked: dict[str, list[str]] = {}
    missing, many = dict(totals), 16
    while missing:
        # about ``many`` times the pieces wanted by hash, then of these the first; all, where that gives none
        shares = spark_map({name: min(1.0, many * wanted * PIECE / n) for name, n in missing.items()})
        few = pieces.where(F.col("h") < shares[F.col("lang")] * float(1 << 40)).groupBy("lang", "h").agg(F.first("piece").alias("piece"))
        order = Window.partitionBy("lang").orderBy("h")
        for r in few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= wanted).orderBy("lang", "h").collect():
            picked.setdefault(r["lang"], []).append(r["piece"])
        done = many * wanted * PIECE >= max(missing.values())
        missing = {} if done else {k: n for k, n in missing.items() if k not in picked}
        many *= 64
    out = {name: " ".join(map(normal_text, found))[:share] for name, found in picked.items()}
    return {name: text for name, text in out.items() if text.strip()}


def spark_map(values: dict[str, float]) -> Column:
    """A map literal, whatever the number of keys."""
    return F.map_from_arrays(F.lit(list(values)), F.lit(list(values.values())))


def predict_languages(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    spark = docs.sparkSession
    on_workers(spark)
    parser = spark.sparkContext.broadcast(CrossParser(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser.value
        for batch in slices(batches, 1024):
            lang, score = p.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 3) == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = sample_languages(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict_languages(docs, samples).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
