"""Operator 5, secret scans with a random forest that removes false positives.

Candidates are values of any length and characters that follow a credential's name,
bearer tokens, passwords in URLs, JSON web tokens, PEM blocks of private keys, keys
with an issuer's prefix, and long runs of key characters that hold a digit, or very
long ones of mixed case. Each is described by its length, character classes and transitions,
the share of it that frequent words of the corpus cover, the path (source) of its
document and its neighbouring words. A random forest learned from labelled
findings decides which are secrets. Training uses a bounded sample of labelled
findings (``SAMPLE``, chosen by a hash); scanning covers every text whole.

``shape_label`` labels findings of well-known shapes: 1 for those of credentials, 0 for
digit ids and dates, UUIDs, paths, hashes named as such and placeholders. Others have
no label: the forest doesn't learn from them but judges them. Callers with reviewed
findings pass their own.

Defined cases: NULL and empty texts have no findings and stay as they are. A NULL
path counts as empty. With fewer than ``LEAST`` labelled findings of a kind the labels by
shape decide instead of a forest. A model learned from a table without a single finding
takes every finding of another table for a secret. Repeated rows are scanned one by one. Other columns pass ``redact``
untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import on_workers, slices, stored, table, texts
from keyedit.llm.lm_score import count_tokens

SAMPLE = 20_000            # labelled findings that a forest learns from
DICTIONARY = 20_000        # most frequent words of 4 letters and more
RARE = 500_000             # a word of the dictionary is more than one in so many tokens
TREES, DEPTH, LEAF = 25, 8, 3
LEAST = 10                 # labelled findings of each kind that a forest needs
THRESHOLD = 0.5
SEED = 5
MASK = "[SECRET]"

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
#: Names to which credentials are assigned.
NAMES = ("token", "password", "passwd", "pwd", "secret", "apikey", "api_key", "api-key", "access_key", "private_key",
         "auth", "credential")
#: Prefixes of keys that services issue.
_PREFIXED = (r"A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_\-]{20,}"
             r"|xox[abeoprs]-[0-9A-Za-z\-]+|xapp-[0-9A-Za-z\-]+|[sr]k_(?:live|test)_[0-9A-Za-z]+|whsec_[0-9A-Za-z]+"
             r"|AIza[0-9A-Za-z_\-]{35}|ya29\.[0-9A-Za-z_\-]+|sk-[0-9A-Za-z_\-]{20,}|SG\.[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+"
             r"|npm_[0-9A-Za-z]{36}|pypi-[0-9A-Za-z_\-]{16,}|hf_[0-9A-Za-z]{30,}|dop_v1_[0-9a-f]{64}|hvs\.[0-9A-Za-z_\-]{20,}")
PREFIXES = re.compile(f"(?:{_PREFIXED})$")
_JWT = r"eyJ[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]*"
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_SET = r"(?::=|=>|={1,3}|::?)"
_NAME = r"(?:(?:" + "|".join(NAMES) + r")s?|\bAuthorization)[\"'`]?\s*"
_SCHEMES = r"(?:Bearer|Basic|Token)\s+"
_ASSIGNED = re.compile(rf"(?i){_NAME}{_SET}\s*[\"'`]?(?:{_SCHEMES})?[\"'`]?$")
_BEARER = re.compile(r"(?i)\bBearer\s+$")
_USERINFO = re.compile(r"://[^\s/:@\"']*:$")
#: Literals of which a text must hold one (in lower case), and what is then searched for: the group is the finding.
_MARKED = tuple((heads, re.compile(x)) for heads, x in (
    (("-----begin ",), rf"({_PEM}(?:(?!-----)[\s\S])*-----END [A-Z ]*PRIVATE KEY-----)"),
    (("eyj",), rf"(?<![0-9A-Za-z_\-])({_JWT})"),
    (("://",), r"://[^\s/:@\"']*:([^\s/\"'<>]+)(?=@)"),
    (("akia", "asia", "gh", "glpat-", "xox", "xapp-", "k_live_", "k_test_", "whsec_", "aiza", "ya29.", "sk-", "sg.", "npm_", "pypi-",
      "hf_", "dop_v1_", "hvs."), rf"(?<![0-9A-Za-z_\-])({_PREFIXED})"),
    (("bearer",), r"(?i)\bBearer\s+([0-9A-Za-z._~+/\-]{8,}=*)")))
_SETS = re.compile(_SET)
_NAME_ENDS = re.compile(rf"(?i){_NAME}$")
_VALUE = re.compile(rf"(?i)(?:\s*(?=[\"'`])|[ \t]*)(?:{_SCHEMES})?(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|[\"'`]?(?:{_SCHEMES})?([^\s\"'`,;&<>]+))")
#: What stands after a credential's name without being one.
_PLACEHOLDER = re.compile(r"(?i)true|false|null|none|nil|undefined|yes|no|required|optional|string|str|\*+|x+|\.+|\[SECRET\]|"
                          r"[$%]?\{+.*\}+|\$\w+")
_CALL = re.compile(r"\$?\(.*|[A-Za-z_][\w.]*[(\[].*|os\.environ.*|process\.env.*")   # where no quote stands
_DIGITS = re.compile(r"\d+(?:[\-/_+]\d+)*(?:T\d+(?:[+\-]\d+)?)?")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_FOLDER = re.compile(r"[A-Z][a-z_\-]+|[a-z_\-]+|[a-z_\-]*+\d{1,8}[a-z_\-]*+")
_FILE = re.compile(r"[A-Za-z]?[a-z_\-]*+(?:\d{1,8}[a-z_\-]*+)?")
_HASH = re.compile(r"(?i)[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128}|(?:sha\d+|md5)-[0-9a-z+/]+=*")
_HASHED = re.compile(r"(?i)(?:md5|sha-?\d+|checksum|commit|revision|digest|etag|index|tree|blob|parent)(?:sum)?[\"']?[\s:=@(]*[\"']?$")
_EXAMPLE = re.compile(r"(?i)test|example|sample|demo|doc")

FEATURES = ("length", "digits", "upper", "lower", "other", "switches", "distinct", "entropy", "hex", "transitions",
            "coverage", "longest_word", "named_before", "assigned", "quoted", "words_before", "digit_neighbours",
            "path_length", "path_depth", "path_example")


def candidates(text: str) -> list[tuple[int, str]]:
    """Place and text of each candidate, from left to right; none overlap."""
    spans = []
    for m in CANDIDATE.finditer(text):
        w = m[0]
        if any(c.isdigit() for c in w) or (len(w) >= 24 and not w.islower() and not w.isupper()):
            spans.append((m.start(), m.end()))
    lower = text.lower()
    for heads, marked in _MARKED:
        if any(h in lower for h in heads):
            spans += [m.span(1) for m in marked.finditer(text)]
    if any(n in lower for n in NAMES):
        end = 0         # what stands within a value is part of it
        for m in _SETS.finditer(text):
            if (m.start() >= end and _NAME_ENDS.search(text, max(0, m.start() - 40), m.start())
                    and (v := _VALUE.match(text, m.end()))):
                spans.append(v.span(v.lastindex))
                end = v.end()
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, text[a:b]) for a, b in out]


class Words:
    """Frequent words, and how their letters follow one another."""

    def __init__(self, words: list[str]):
        self.words = set(words)
        self.longest = max(map(len, words), default=0)
        seen = np.ones((37, 37))
        for w in words:
            k = [self._class(c) for c in w]
            for a, b in zip(k, k[1:]):
                seen[a, b] += 1
        self.log = np.log(seen / seen.sum(axis=1, keepdims=True))

    @staticmethod
    def _class(c: str) -> int:
        return ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 36

    def transitions(self, w: str) -> float:
        k = [self._class(c) for c in w.lower()]
        return float(self.log[k[:-1], k[1:]].mean()) if len(k) > 1 else 0.0

    def coverage(self, w: str) -> tuple[float, int]:
        """Share of the characters that words cover from left to right, and the longest of the words."""
        w, at, covered, best = w.lower(), 0, 0, 0
        while at < len(w):
            for n in range(min(self.longest, len(w) - at), 3, -1):
                if w[at:at + n] in self.words:
                    at, covered, best = at + n, covered + n, max(best, n)
                    break
            else:
                at += 1
        return covered / len(w), best


def describe(text: str, at: int, w: str, path: str, words: Words) -> list[float]:
    n = len(w)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in w]
    counts = [w.count(c) for c in set(w)]
    before = text[max(0, at - 60):at]
    after = text[at + n:at + n + 40]
    near = re.findall(r"\w+", before.lower())[-3:]
    covered, longest = words.coverage(w)
    return [n, kind.count("d") / n, kind.count("u") / n, kind.count("l") / n, kind.count("o") / n,
            sum(a != b for a, b in zip(kind, kind[1:])) / n, len(counts) / n,
            -sum(c / n * math.log2(c / n) for c in counts), float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", w))),
            words.transitions(w), covered, longest, float(any(x in NAMES for x in near)),
            float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before != ""),
            float(len(near)), sum(c.isdigit() for c in before[-20:] + after[:20]) / 40,
            len(path), path.count("/"), float(bool(_EXAMPLE.search(path)))]


def is_path(w: str) -> bool:
    """Folders between slashes and a last name, each judged by itself: in proportion to the length."""
    for slashes in range(3):
        if w[:slashes] == "/" * slashes:
            *folders, last = w[slashes:].split("/")
            if folders and _FILE.fullmatch(last) and all(map(_FOLDER.fullmatch, folders)):
                return True
    return False


def shape_label(text: str, at: int, w: str) -> int | None:
    """1 for shapes of credentials, 0 for known shapes of other things, else None."""
    before = text[max(0, at - 80):at]
    if PREFIXES.match(w) or re.match(_PEM, w) or re.fullmatch(_JWT, w):
        return 1
    named = _ASSIGNED.search(before) or _USERINFO.search(before) or _BEARER.search(before)
    if named:
        quoted = before[-1:] in ("\"", "'", "`")
        if _PLACEHOLDER.fullmatch(w) or not quoted and _CALL.fullmatch(w):
            return 0
        # a bare word of prose ("secret: the") tells nothing
        return 1 if quoted or not w.strip(".:!?)").isalpha() or _USERINFO.search(before) else None
    if _DIGITS.fullmatch(w) or _UUID.fullmatch(w) or is_path(w):
        return 0
    return 0 if _HASH.fullmatch(w) and _HASHED.search(before) else None


# ---------------------------------------------------------------- forest

def _grow(x: np.ndarray, y: np.ndarray, rng, depth: int, nodes: list) -> int:
    me = len(nodes)
    nodes.append([-1, 0.0, -1, -1, float(y.mean())])
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return me
    best = (1e-9, -1, 0.0)
    p = y.mean()
    whole = p * (1 - p)
    for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= LEAF) & (cut <= len(y) - LEAF)]
        if not len(cut):
            continue
        ones = np.cumsum(t)[cut - 1]
        left, right = ones / cut, (t.sum() - ones) / (len(y) - cut)
        gain = whole - (cut * left * (1 - left) + (len(y) - cut) * right * (1 - right)) / len(y)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2)
    if best[1] < 0:
        return me
    go = x[:, best[1]] <= best[2]
    nodes[me][:2] = best[1], best[2]
    nodes[me][2] = _grow(x[go], y[go], rng, depth - 1, nodes)
    nodes[me][3] = _grow(x[~go], y[~go], rng, depth - 1, nodes)
    return me


class Forest:
    """Trees over bootstrap samples, half of either kind; a random subset of the features at every split.

    ``by_shape`` is set where labels of a kind are too few: there are no trees then,
    and the shape of a finding decides.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, any_findings: bool = True):
        self.trees = []
        kinds = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
        self.by_shape = any_findings and min(map(len, kinds)) < LEAST
        if min(map(len, kinds)) >= LEAST:
            rng = np.random.default_rng(SEED)
            for _ in range(TREES):
                k = np.concatenate([rng.choice(of, (len(y) + 1) // 2) for of in kinds])
                nodes: list = []
                _grow(x[k], y[k], rng, DEPTH, nodes)
                self.trees.append(np.array(nodes))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.ones(len(x))
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                inner = t[at, 0] >= 0
                f = np.maximum(t[at, 0], 0).astype(int)
                go = np.where(x[np.arange(len(x)), f] <= t[at, 1], t[at, 2], t[at, 3]).astype(int)
                at = np.where(inner, go, at)
            total += t[at, 4]
        return total / len(self.trees)


# ---------------------------------------------------------------- Spark

def frequent_words(docs: DataFrame) -> Words:
    """The most frequent purely alphabetic words of the corpus, at most ``DICTIONARY``.

    Only words that make up more than one in ``RARE`` tokens are ranked: there are
    fewer than ``RARE`` of them, so what the tasks send has a bound of its own.
    """
    counts = stored(count_tokens(docs), "token-counts")
    total = counts.agg(F.sum("c")).first()[0] or 0
    words = counts.where(F.col("c") * RARE > total).select(F.decode("token", "UTF-8").alias("w"), "c")
    words = words.where(F.col("w").rlike(r"^\p{L}{4,20}$"))
    return Words([r["w"] for r in words.orderBy(F.desc("c"), "w").limit(DICTIONARY).collect()])


def _sources(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    on_workers(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"))


_FOUND = "doc_id long, start long, length long, label int, features array<double>"


def labelled_findings(docs: DataFrame, words: Words, labels: DataFrame | None = None) -> DataFrame:
    """Findings with features and label; ``labels`` (doc_id, start, label) replaces the labels by shape."""
    words_b = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path"))):
                for at, w in candidates(text or ""):
                    rows.append((doc, at, len(w), shape_label(text, at, w), describe(text, at, w, path or "", words_b.value)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())))],
                    names=["doc_id", "start", "length", "label", "features"])
    found = docs.mapInArrow(run, _FOUND)
    if labels is not None:
        mine = labels.select("doc_id", "start", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
        found = found.drop("label").join(mine, ["doc_id", "start"])
    return found


def train_forest(findings: DataFrame, any_findings: bool | None = None) -> Forest:
    """Learn from at most about ``SAMPLE`` labelled findings, evenly of both kinds, chosen by a hash.

    ``any_findings``: whether the table has findings at all, labelled or not; by default, whether these are some.
    """
    findings = stored(findings.select("label", "features", F.xxhash64("doc_id", "start", "features").alias("h")), "findings")
    sizes = {r["label"]: r["n"] for r in findings.groupBy("label").agg(F.count("*").alias("n")).collect()}
    any_findings = bool(sizes) if any_findings is None else any_findings
    sizes.pop(None, None)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, SAMPLE / 2 / n)).otherwise(share)
    rows = findings.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).orderBy("h").limit(2 * SAMPLE).collect()
    x = np.array([r["features"] for r in rows], float).reshape(-1, len(FEATURES))
    return Forest(x, np.array([r["label"] for r in rows], float), any_findings)


def learn_secrets(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                  path_col: str | None = "source") -> tuple[Words, Forest]:
    words = frequent_words(texts(docs, id_col, text_col))
    # findings that no given label is for are findings, too
    return words, train_forest(labelled_findings(_sources(docs, id_col, text_col, path_col), words, labels),
                               None if labels is None else True)


def _judge(text: str, path: str, words: Words, forest: Forest) -> list[tuple[int, str, float]]:
    found = candidates(text)
    if not found:
        return []
    if forest.by_shape:
        return [(at, w, float(shape_label(text, at, w) or 0)) for at, w in found]
    p = forest.probability(np.array([describe(text, at, w, path, words) for at, w in found], float))
    return [(at, w, float(q)) for (at, w), q in zip(found, p)]


def scan_secrets(docs: DataFrame, words: Words, forest: Forest, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str | None = "source") -> DataFrame:
    """doc_id, start, length, probability, is_secret of every finding (places in code points)."""
    model = docs.sparkSession.sparkContext.broadcast((words, forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(doc, at, len(w), p, p >= THRESHOLD)
                    for doc, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")))
                    for at, w, p in _judge(text or "", path or "", *model.value)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))],
                    names=["doc_id", "start", "length", "probability", "is_secret"])
    return _sources(docs, id_col, text_col, path_col).mapInArrow(
        run, "doc_id long, start long, length long, probability double, is_secret boolean")


def redact(docs: DataFrame, words: Words, forest: Forest, text_col: str = "text", path_col: str | None = "source",
           size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``MASK`` and the size in code points brought up to date."""
    on_workers(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((words, forest))
    place = docs.columns.index(text_col)
    path_at = docs.columns.index(path_col) if path_col else None
    size_at = docs.columns.index(size_col) if size_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = list(batch.columns)
            paths = cols[path_at].cast(pa.string()).to_pylist() if path_at is not None else [None] * batch.num_rows
            out, sizes = [], cols[size_at].to_pylist() if size_at is not None else []
            for k, (text, path) in enumerate(zip(cols[place].to_pylist(), paths)):
                for at, w, p in reversed(_judge(text or "", path or "", *model.value)):
                    if p >= THRESHOLD:
                        text = text[:at] + MASK + text[at + len(w):]
                        if size_at is not None:
                            sizes[k] = None if sizes[k] is None else sizes[k] + len(MASK) - len(w)
                out.append(text)
            cols[place] = pa.array(out, cols[place].type)
            if size_at is not None:
                cols[size_at] = pa.array(sizes, cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, *learn_secrets(docs))
