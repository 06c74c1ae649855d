"""Operator 13, phrases whose words keep company, by prefix-free parsing.

Lower-cased texts become streams of words, with one mark where a piece ends. The parse
cuts a stream where the ``OVERLAP`` tokens from a place on form a trigger (their hash has
its last bits zero), so equal passages are cut alike wherever they stand. A chunk ends
with the trigger that the next one begins with, hence every phrase of up to ``WORDS`` words
that starts before the closing trigger lies in its chunk whole. The *dictionary* holds each
distinct chunk of a language once, with the number of its occurrences in the parse.

Phrases are then counted inside the distinct chunks, weighted by that number. Phrases that
start in the closing overlap belong to the next chunk, so each is counted once. Words and
pairs come first. Longer phrases are only counted where all their pairs are frequent: the
frequent pairs are sent as a bitmap of hashes of fixed size, whose false hits cost time
only. A phrase is known by a 64-bit hash of its language and words until the frequent ones
are named; two texts under one hash stop the job.

Scores, the longer phrases that drop shorter ones, and the ranks are joins and aggregates
by phrase hash, combined before they are shuffled; nothing is grouped by language alone
but word totals and the first ``TOP`` rows.

Defined cases: a NULL or blank text has no words; a NULL language is ``und``. Repeated rows
count again. Other columns are ignored; an empty table gives an empty result. A text of any
length is parsed whole; without triggers a chunk ends after ``MOST`` tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyedit.llm.common import gathered, on_workers, slices, slices_of_size, stored, table, text_bytes

WORDS, LEAST, TOP, SHARE, SCALE = 4, 30, 2000, 80, 2_000_000
OVERLAP = WORDS - 1
TRIGGER_BITS = 5            # a trigger for about every 2 ** TRIGGER_BITS tokens
MOST = 512                  # tokens of a chunk without a trigger
SLICE = 4 << 20             # bytes of chunks whose phrases are summed before they are shuffled
BITMAP_BITS = 27            # a bitmap takes 16 MB at any size of the input
BUCKET = 1 << 15            # bits of one value of Spark's bitmap functions

END = b"\n"                 # the mark between pieces; no word holds it
_TO_STREAM = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 9)
_TOKENS = re.compile(rb"\n[\n ]*|[^\n ]+")

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _step(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word; spread so that the order and the number of words count."""
    h = (h ^ word) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


# ---------------------------------------------------------------- the parse

def parse(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text: tokens joined by one space, the closing overlap included."""
    streams = []
    for t in texts:
        s = [x if x[0] != 10 else END for x in _TOKENS.findall(t.translate(_TO_STREAM))]
        if s and s[0] == END:
            del s[0]
        if s and s[-1] == END:
            s.pop()
        streams.append(s)
    flat = [x for s in streams for x in s]
    if not flat:
        return [[] for _ in texts]
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    hashes = _word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    h = hashes
    for k in range(1, OVERLAP):
        h = _step(h[:-1], hashes[k:])
    trigger = np.flatnonzero(h >> np.uint64(64 - TRIGGER_BITS) == 0)
    out, at = [], 0
    closing = [END] * OVERLAP
    bounds = np.cumsum([0, *map(len, streams)])
    first, last = np.searchsorted(trigger, bounds[:-1]), np.searchsorted(trigger, bounds[1:])
    for s, begin, a, b in zip(streams, bounds.tolist(), first.tolist(), last.tolist()):
        padded, n, start, chunks = s + closing, len(s), 0, []
        for place in [*(trigger[a:b] - begin).tolist(), n]:
            if place > n - OVERLAP:
                place = n           # the trigger would reach over the end
            while place - start > MOST:
                chunks.append(b" ".join(padded[start:start + MOST + OVERLAP]))
                start += MOST
            if place > start:
                chunks.append(b" ".join(padded[start:place + OVERLAP]))
                start = place
        out.append(chunks)
    return out


_PARSE = "lang string, chunk binary, n long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices_of_size(batches, size=4 << 20):
        found: Counter = Counter()
        for lang, chunks in zip(batch.column("lang").to_pylist(), parse(text_bytes(batch.column("text")))):
            found.update([(lang, c) for c in chunks])
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary()),
             pa.array(list(found.values()), pa.int64())], names=["lang", "chunk", "n"])


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, chunk, n: each distinct chunk of a language and how often the parse has it."""
    on_workers(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_parse, _PARSE).groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- counting in the dictionary

class Slice:
    """Tokens of a slice of the dictionary, and the phrases that its chunks own."""

    def __init__(self, batch: pa.RecordBatch):
        lists = pc.split_pattern(batch.column("chunk"), b" ")
        coded = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        self.word = coded.dictionary
        words = self.word.to_pylist()
        self.token = coded.indices.to_numpy(zero_copy_only=False)
        self.hash = _word_hashes(words)[self.token]
        is_word = np.array([w != END for w in words], bool)[self.token]
        # a chunk's last tokens are the next one's
        owned = np.ones(len(self.token), bool)
        ends = np.cumsum(sizes)
        for k in range(1, OVERLAP + 1):
            owned[ends - k] = False
        self.n = np.repeat(batch.column("n").to_numpy(), sizes)
        langs = batch.column("lang").dictionary_encode()
        self.langs: list[str] = langs.dictionary.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), sizes)
        #: what the hashes of each token's language start from
        self.seed = _step(_word_hashes([x.encode() for x in self.langs]), np.full(len(self.langs), _M2))[self.lang]
        #: places of owned phrases of 1, 2, ... words, and the phrases' hashes
        self.at, self.phrase = [np.flatnonzero(owned & is_word)], []
        self.phrase.append(_step(self.seed[self.at[0]], self.hash[self.at[0]]))
        self.is_word = is_word

    def grow(self, keep: np.ndarray | None = None) -> None:
        """Phrases of one more word, of the present ones for which ``keep`` holds."""
        at, h, k = self.at[-1], self.phrase[-1], len(self.at)
        more = self.is_word[np.minimum(at + k, len(self.is_word) - 1)]
        if keep is not None:
            more &= keep
        self.at.append(at[more])
        self.phrase.append(_step(h[more], self.hash[at[more] + k]))


class Bitmap:
    """Which hashes may be among those sent: one bit for each value of their top bits."""

    def __init__(self, parts: list[tuple[int, bytes]]):
        self.bits = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
        for bucket, raw in parts:
            at = bucket * (BUCKET // 8)
            self.bits[at:at + len(raw)] = np.frombuffer(raw, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_parts(hashes: DataFrame) -> list[tuple[int, bytes]]:
    """The bitmap of a column ``h``, as the values of Spark's bitmap functions: 4,096 of 4 KB at most."""
    place = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    rows = hashes.select(F.shiftright(place, 15).alias("bucket"), F.pmod(place, F.lit(BUCKET)).alias("bit"))
    got = rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    return [(r["bucket"], bytes(r["bits"])) for r in got]


def _summed(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct hash, with the sum of ``n``."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, first) if len(h) else n
    return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(total, pa.int64())], names=["h", "f"])


def _count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices_of_size(gathered(batches, "chunk", SLICE), "chunk", 2 * SLICE):
        s = Slice(batch)
        s.grow()
        yield _summed(np.concatenate(s.phrase), np.concatenate([s.n[at] for at in s.at]))


def _pairs_held(s: Slice, frequent: Bitmap) -> np.ndarray:
    """For each token: does a word pair start here that may be frequent? In a chunk's overlap, too."""
    pair = _step(_step(s.seed[:-1], s.hash[:-1]), s.hash[1:])
    held = np.zeros(len(s.token), bool)
    held[:-1] = s.is_word[:-1] & s.is_word[1:] & frequent.holds(pair)
    return held


def _grow_frequent(s: Slice, frequent: Bitmap) -> None:
    held = _pairs_held(s, frequent)
    s.grow(held[s.at[0]])
    for k in range(1, WORDS - 1):
        s.grow(held[np.minimum(s.at[k] + k, len(held) - 1)])


def _count_long(pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Bitmap(pairs.value)
        for batch in slices_of_size(gathered(batches, "chunk", SLICE), "chunk", 2 * SLICE):
            s = Slice(batch)
            _grow_frequent(s, frequent)
            yield _summed(np.concatenate(s.phrase[2:]), np.concatenate([s.n[at] for at in s.at[2:]]))
    return run


_NAMES = "h long, lang string, phrase string"


def _name(pairs, wanted):
    """Text of each phrase that may be wanted, once for each slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, want = Bitmap(pairs.value), Bitmap(wanted.value)
        for batch in slices_of_size(gathered(batches, "chunk", SLICE), "chunk", 2 * SLICE):
            s = Slice(batch)
            _grow_frequent(s, frequent)
            for k in range(1, WORDS):
                h, first = np.unique(s.phrase[k], return_index=True)
                held = want.holds(h)
                at = s.at[k][first[held]]
                tokens = s.word.take(pa.array(s.token[at[:, None] + np.arange(k + 1)].reshape(-1)))
                places = pa.array(np.arange(len(at) + 1, dtype=np.int32) * (k + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[held].view(np.int64)), pa.array(s.langs, pa.string()).take(pa.array(s.lang[at])),
                     pc.binary_join(pa.ListArray.from_arrays(places, tokens), b" ").cast(pa.string())],
                    names=["h", "lang", "phrase"])
    return run


_PARTS = ("h long, f long, lang string, phrase string, parts array<struct<k:int,left:long,right:long>>, "
          "inner array<long>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each phrase the hashes of the two parts of every cut, and of the shorter phrases of two words or more in it."""
    for batch in slices(batches, 20_000):
        parts, inner = [], []
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            w = phrase.encode().split(b" ")
            of, n = _stretches(lang, w), len(w)
            parts.append([{"k": k, "left": of[0, k], "right": of[k, n]} for k in range(1, n)])
            inner.append([of[a, b] for a in range(n) for b in range(a + 2, n + 1) if b - a < n])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("h", "f", "lang", "phrase")),
             pa.array(parts, pa.list_(pa.struct([("k", pa.int32()), ("left", pa.int64()), ("right", pa.int64())]))),
             pa.array(inner, pa.list_(pa.int64()))], names=["h", "f", "lang", "phrase", "parts", "inner"])


def _stretches(lang: str, words: list[bytes]) -> dict[tuple[int, int], int]:
    """Hashes of all stretches of a phrase, as the tables have them."""
    h, out = _word_hashes(words), {}
    state = np.full(len(words), _step(_word_hashes([lang.encode()]), np.full(1, _M2))[0])
    for k in range(len(words)):
        state = _step(state[:len(words) - k], h[k:])
        out.update({(a, a + k + 1): x for a, x in enumerate(state.view(np.int64).tolist())})
    return out


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Within it a query's shuffle files go when the query has ended (what it wrote stays)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _owned_words(chunks: DataFrame) -> DataFrame:
    """Word occurrences of each language: the tokens of a chunk that are words and not in its overlap."""
    tokens = F.split(F.col("chunk").cast("string"), " ")
    owned = F.slice(tokens, 1, F.size(tokens) - OVERLAP)
    count = F.size(owned) - F.size(F.filter(owned, lambda x: x == END.decode()))
    return chunks.groupBy("lang").agg(F.sum(count * F.col("n")).alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases.

    ``least`` is the number of occurrences that makes a candidate; a candidate goes when a
    longer one that holds it has ``share`` per cent of its occurrences or more.
    """
    spark = docs.sparkSession
    counted = "h long, f long"

    def frequent(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    with _shuffles_dropped(spark):
        chunks = stored(dictionary(docs, text_col, lang_col), "phrase-dictionary")
        short = stored(frequent(chunks.mapInArrow(_count_short, counted)), "phrases-short")
        pairs = spark.sparkContext.broadcast(bitmap_parts(short))
        long = stored(frequent(chunks.mapInArrow(_count_long(pairs), counted)), "phrases-long")
        counts = short.unionByName(long)
        wanted = spark.sparkContext.broadcast(bitmap_parts(counts))
        names = chunks.mapInArrow(_name(pairs, wanted), _NAMES).distinct()
        found = stored(names.join(counts, "h").select("h", "f", "lang", "phrase").mapInArrow(_parts, _PARTS), "candidates")
        if not found.groupBy("h").count().where("count > 1").isEmpty():
            raise ValueError("two phrases share a hash")
    left = counts.select(F.col("h").alias("left"), F.col("f").alias("l"))
    right = counts.select(F.col("h").alias("right"), F.col("f").alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * a div (l + r)")
    cuts = (found.select("h", F.col("f").alias("a"), F.inline("parts")).join(left, "left").join(right, "right")
            .select("h", "l", "r", "k", score.alias("score")))
    lowest = cuts.groupBy("h").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = (found.select(F.explode("inner").alias("h"), "f").groupBy("h").agg(F.max("f").alias("longer")))
    kept = (found.join(longer, "h", "left").where(F.coalesce(F.col("longer") * 100 < F.col("f") * share, F.lit(True)))
            .join(lowest, "h").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(_owned_words(chunks)), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP13_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
phrases as (
  select lang, 1 as k, unnest(w) as p from worded
  union all
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as p
  from worded, (values (2), (3), (4)) as sizes(k) where len(w) >= k),
counts as materialized (select lang, k, p, count(*) as f from phrases group by all having count(*) >= {LEAST}),
totals as (select lang, sum(len(w)) as n from worded group by lang),
candidates as materialized (select *, string_split(p, ' ') as w from counts where k >= 2),
halves as materialized (
  select lang, p, k, f as a, c as cut, array_to_string(w[1:c], ' ') as first_words,
         array_to_string(w[c + 1:k], ' ') as last_words
  from candidates, (values (1), (2), (3)) as x(c) where c < k),
cuts as (
  select h.lang, h.p, h.a, h.cut, x.f as l, y.f as r,
         cast(({SCALE}::hugeint * h.a) // (x.f + y.f) as bigint) as score
  from halves h join counts x on x.lang = h.lang and x.p = h.first_words
  join counts y on y.lang = h.lang and y.p = h.last_words),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
inner_phrases as materialized (
  select lang, f, array_to_string(w[i:i + m - 1], ' ') as q
  from candidates, (values (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) as s(m, i) where m < k and i + m - 1 <= k),
inside as (select lang, q, max(f) as longer from inner_phrases group by all),
kept as (
  select w.* from lowest w left join inside i on i.lang = w.lang and i.q = w.p
  where i.longer is null or 100 * i.longer < {SHARE} * w.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from kept)
select r.lang, r.rank, r.p as phrase, r.a, r.l, r.r, cast(t.n as bigint) as n, r.score
from ranked r join totals t on t.lang = r.lang where r.rank <= {TOP}
"""
