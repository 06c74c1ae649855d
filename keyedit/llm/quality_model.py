"""Operator 10, quality classifier.

Statistics of the whole text are standardised and mapped through random
Fourier features, whose inner products approximate a Gaussian kernel. Each
partition sums its part of the normal equations; the small sums give ridge
weights, and an isotonic fit over fixed score bins turns raw scores into
probabilities. Only statistics of the text enter a score.

Defined cases: a NULL or empty text has all statistics 0 and is scored like any
other. Labels other than 0 and 1 and NULL labels teach nothing; a document with
several label rows counts once for each. With no labelled rows at all every
score is 0.5. Repeated rows are scored one by one; other columns are ignored.
What reaches the driver has a fixed size: means and deviations of the
statistics, ``FEATURES + 1`` rows of the normal equations, ``BINS`` bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import crc_bucket, on_workers, slices, stored, table, text_bytes, texts

FEATURES = 128         # random Fourier features
WIDTH = 4.0            # kernel width in standard deviations, over all statistics
RIDGE = 1e-3           # ridge penalty per training row
BINS = 2000            # of raw scores, for the isotonic fit
SEED = 7
THRESHOLD = 0.3

STATS = ("log_words", "log_lines", "word_length", "words_in_line", "symbols", "bars", "bangs", "upper", "digits",
         "high_bytes", "stops", "commas", "distinct_words", "repeated_pairs", "repeated_lines", "ends_in_stop",
         "marked_words", "longest_line")

_SYMBOLS, _BARS = b"#*$%&<>@^~\\{}[]_=+", b"|"
_UPPER, _DIGIT, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r"
_HIGH = bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of ``STATS``."""
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    count = lambda chars: size - len(text.translate(None, chars))
    solid = size - count(_SPACE)
    pairs = list(zip(words, words[1:]))
    return [math.log1p(n), math.log1p(len(lines)), min(solid / n, 40.0), min(n / len(lines), 400.0) / 100,
            count(_SYMBOLS) / solid, count(_BARS) / n, text.count(b"!") / n, count(_UPPER) / solid,
            count(_DIGIT) / solid, count(_HIGH) / solid, text.count(b".") / n, text.count(b",") / n,
            len(set(words)) / n, 1 - len(set(pairs)) / max(1, len(pairs)), 1 - len(set(lines)) / len(lines),
            sum(x.rstrip(_SPACE).endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines),
            sum(x[-1:] in b"#*$%&|!" for x in words) / n, min(max(map(len, lines)) / size, 1.0)]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        x = np.array([statistics(t) for t in text_bytes(batch.column("text"))], float).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in x.T)],
                                         names=["doc_id", *STATS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(docs, id_col, text_col).mapInArrow(
        _statistics, "doc_id long, " + ", ".join(f"{c} double" for c in STATS))


class QualityModel:
    """Standardisation, random features, ridge weights and isotonic steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(STATS), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS]).reshape(-1, len(STATS))


def _normal(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            f, y = model.features(_matrix(batch)), batch.column("quality").to_numpy().astype(float)
            total += f.T @ np.hstack([f, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1), pa.int32()),
                                          pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])
    return run


def _add(t: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(x) for x in t.column("sums").to_pylist()], axis=0)
    return pa.table({"row": t.column("row")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})


def _binned(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("quality")],
                                             names=["bin", "quality"])
    return run


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising means of ``y`` over ``x`` with weights ``n``."""
    blocks: list[list[float]] = []         # sum of y, weight, sum of weighted x
    for xi, yi, ni in zip(x, y, n):
        blocks.append([yi * ni, ni, xi * ni])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from ``labels`` (doc_id, quality) over ``document_statistics`` rows."""
    y = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = stored(stats.join(y, "doc_id"), "quality-train")
    m = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in STATS),
                 *(F.stddev_pop(c).alias(f"s_{c}") for c in STATS)).first()
    if not m["n"]:
        return QualityModel(np.zeros(len(STATS)), np.ones(len(STATS)))
    model = QualityModel(np.array([m[f"m_{c}"] for c in STATS]),
                         np.array([m[f"s_{c}"] if m[f"s_{c}"] > 1e-9 else 1.0 for c in STATS]))
    sums = (rows.mapInArrow(_normal(model), "row int, sums array<double>")
            .groupBy("row").applyInArrow(_add, "row int, sums array<double>").collect())
    a = np.array([r["sums"] for r in sorted(sums, key=lambda r: r["row"])])
    model.weights = np.linalg.solve(a[:, :-1] + RIDGE * m["n"] * np.diag([1.0] * FEATURES + [0.0])
                                    + 1e-9 * np.eye(FEATURES + 1), a[:, -1])
    bins = (rows.mapInArrow(_binned(model), "bin int, quality int").groupBy("bin")
            .agg(F.avg("quality").alias("y"), F.count("*").alias("n")).orderBy("bin").collect())
    model.steps = isotonic(np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in bins]),
                           np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float))
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, predicted for each row of statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(model.score(_matrix(batch)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()),
                                              pa.array(s >= THRESHOLD).cast(pa.int32())],
                                             names=["doc_id", "score", "predicted"])
    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, judged in place: no join, no shuffle."""
    on_workers(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x = np.array([statistics(t) for t in text_bytes(batch.column(place))], float).reshape(-1, len(STATS))
            yield batch.filter(pa.array(np.clip(model.score(x), 0, 1) >= THRESHOLD))
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 5) == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, score every row of ``docs``."""
    stats = stored(document_statistics(docs), "quality-stats")
    model = fit_quality(stats, labels.where(~held_out(F.col("doc_id"))))
    return score_quality(stats, model)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
