"""Operator 9, n-gram Jaccard join (size-aware, heavy and light sets).

A document is its set of distinct word shingles; equal sets are one *node*. Two
nodes link when their Jaccard similarity reaches the threshold. Candidates:

* light sets (size up to a boundary): every subset of the size that two sets
  must share is a key; linked light sets share a key;
* heavy sets: inverted lists over the rarest shingles of each set. Of ``n``
  shingles, in one order for all sets, the first ``n - ceil(t*n) + 1`` suffice: two
  linked sets share one of them. The order puts the most frequent shingles last.
  Light sets near the boundary are in these lists too.

The boundary is the largest size whose subsets cost less than scanning its
lists, from the measured mean list length. A list is scanned in tasks: long lists
are cut into blocks, and each pair of blocks is a task's work, so no list has to
fit one task. A pair survives if sizes and a parity sketch allow the similarity
(the sketch's bits that differ are at most the differing shingles: no link is
lost). Of the survivors a task passes on a spanning forest, nearest pairs first;
the pairs are then checked on the whole sets. Where a checked pair fails, a second
scan passes on every surviving pair between the parts that it left apart, so the
components are those of all links, without writing all pairs of a large group.

Shingles are 64-bit hashes of the words; two different ones of a pair of documents
meet with a probability below 1e-11 for documents of 10,000 words.

Defined cases: NULL, empty and blank texts have an empty set, link with nothing and
are their own component; fewer words than a shingle make the whole sequence one
shingle; rows that repeat (also under one doc_id) are copies; a NULL doc_id never
names a component unless all its members are NULL; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import slices, stored, table, text_bytes, texts
from keyedit.llm.components import components, find

SHINGLE = 3                # words of a shingle in operator 9
THRESHOLD = 9, 10          # its similarity as a ratio: 10 * intersection >= 9 * union
HOT_SHARE = 200_000        # shingles put last: those with more than 1/HOT_SHARE of all list entries
MIN_HOT = 64               # and at least so many entries; there are at most HOT_SHARE of them
LIST_BLOCK = 2000          # longer lists are cut into blocks of about this length
SKETCH_BITS = 512          # of sets up to 2,048 shingles at operator 9's threshold; longer sets have more
BROADCAST_IDS = 500_000    # candidate documents looked up by broadcast (16 bytes each); beyond, by shuffle
LIGHT_LIMIT = 30           # sizes tried for the boundary

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
               0xA0761D6478BD642F], np.uint64)


class _WordHashes(dict):
    """Word to 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text: lower-case A-Z, words parted by white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    x = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        x = _mix(x + h[i:len(h) - k + 1 + i] * _K[i % len(_K)])
    return np.unique(x)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch_bits(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Unrelated sets differ in half of the bits: more than linked sets of ``n`` may differ in."""
    p, q = threshold
    bits = SKETCH_BITS
    while bits * 4 * (p + q) < 19 * (q - p) * n:
        bits *= 2
    return bits


def sketch(s: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> bytes:
    """Parity of the shingles in each of ``sketch_bits`` classes; folding halves gives the smaller sketches."""
    n = sketch_bits(len(s), threshold)
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sk: np.ndarray, words: int) -> np.ndarray:
    while len(sk) > words:
        sk = sk[:len(sk) // 2] ^ sk[len(sk) // 2:]
    return sk


def prefix_length(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    p, q = threshold
    return n - -(-p * n // q) + 1


def shared(n: int, m: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Shingles that linked sets of sizes n and m share at least."""
    p, q = threshold
    return -(-p * (n + m) // (p + q))


def subset_sizes(n: int, threshold: tuple[int, int] = THRESHOLD) -> list[int]:
    """Subset sizes with which a light set of ``n`` must be found by a different linked set."""
    p, q = threshold
    found = set()
    for m in range(-(-p * n // q), q * n // p + 1):
        c = shared(n, m, threshold)
        if c <= min(n, m) and not (n == m and c == n):
            found.add(c)
    return sorted(found)


def subsets_cost(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, threshold))


def boundary(mean_list: float, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Largest light size: subsets must cost no more than the lists that they replace."""
    p, q = threshold
    x = 0
    while x < LIGHT_LIMIT and subsets_cost(x + 1, threshold) <= prefix_length(x + 1, threshold) * max(1.0, mean_list):
        x += 1
    return max(x, -(-p // (q - p)) - 1)      # smaller sets link with nothing but copies


def subset_keys(s: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Keys of all subsets of the needed sizes (commutative sums of mixed shingles)."""
    v, out = _mix(s + np.uint64(1)), []
    for c in subset_sizes(len(s), threshold):
        drop = np.array(list(itertools.combinations(range(len(s)), len(s) - c)), np.int64).reshape(math.comb(len(s), c), len(s) - c)
        out.append(_mix(v.sum(dtype=np.uint64) - v[drop].sum(axis=1, dtype=np.uint64) + np.uint64(c) * _K[4]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def prefix(s: np.ndarray, hot: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """The first shingles in the common order: hot ones last, else by value."""
    p = prefix_length(len(s), threshold)
    if len(hot):
        last = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
        if last[:p].any():
            s = np.concatenate([s[~last], s[last]])
    return s[:p]


def _counts(size: int, threshold: tuple[int, int]):
    """Prefix shingles by value alone, counted batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            found = [s[:prefix_length(len(s), threshold)] for t in text_bytes(batch.column("text")) if len(s := shingles(t, size))]
            if found:
                x, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n, pa.int64())],
                                                 names=["tok", "n"])
        _HASHES.clear()
    return run


def _signatures(hot: np.ndarray, light: int, size: int, threshold: tuple[int, int]):
    p, q = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, nodes, sketches, entries = [], [], [], []
            for t in text_bytes(batch.column("text")):
                s = shingles(t, size)
                n = len(s)
                e = []
                if n and n <= light:
                    e.append(subset_keys(s, threshold))
                if q * n >= p * (light + 1):
                    e.append(prefix(s, hot, threshold))
                sizes.append(n)
                nodes.append(node_of(s) if n else None)
                sketches.append(sketch(s, threshold) if n else None)
                entries.append(np.unique(np.concatenate(e)).view(np.int64) if e else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(sketches, pa.binary()), pa.array(entries, pa.list_(pa.int64()))],
                names=["doc_id", "n", "node", "sketch", "entries"])
        _HASHES.clear()         # the worker may go on to another stage
    return run


def _pairs(g, side, n, node, sketches, part, threshold):
    """Positions of the surviving pairs of a chunk that holds whole lists (rows sorted by list)."""
    p, q = threshold
    left, right, dist = [], [], []
    own = [np.frombuffer(x, np.uint64) for x in sketches]
    size = np.array([len(x) for x in own])
    least = SKETCH_BITS // 64
    levels = {least: (np.arange(len(own)), np.stack([folded(x, least) for x in own]))}
    w = least * 2
    while (size >= w).any():            # finer sketches of the long sets
        rows = np.flatnonzero(size >= w)
        at = np.zeros(len(own), np.int64)
        at[rows] = np.arange(len(rows))
        levels[w] = at, np.stack([folded(own[k], w) for k in rows])
        w *= 2

    alive = np.arange(len(g) - 1)
    d = 1
    while len(alive):
        alive = alive[alive + d < len(g)]
        alive = alive[g[alive] == g[alive + d]]
        i, j = alive, alive + d
        ok = (q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j])) & (node[i] != node[j])
        ok &= (side[i] == 0) | (side[i] != side[j])
        if part is not None:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        x = np.zeros(len(i), np.int64)
        for words, (at, sk) in levels.items():
            finer = np.flatnonzero(np.minimum(size[i], size[j]) >= words)
            x[finer] = np.bitwise_count(sk[at[i[finer]]] ^ sk[at[j[finer]]]).sum(axis=1)
            ok = x * (p + q) <= (q - p) * (n[i] + n[j])
            i, j, x = i[ok], j[ok], x[ok]
        left.append(i)
        right.append(j)
        dist.append(x)
        d += 1
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (left, right, dist))


def _scan(forest: bool, threshold: tuple[int, int]):
    """Surviving pairs: a spanning forest of each chunk, or all of them."""
    def chunk(t: pa.Table):
        g, n, node = (t.column(c).to_numpy() for c in ("g", "n", "node"))
        side = t.column("side").to_numpy()
        part = None if forest else t.column("part").to_numpy()
        i, j, dist = _pairs(g, side, n, node, t.column("sketch").to_pylist(), part, threshold)
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        order = np.lexsort((b, a, dist))
        a, b = a[order], b[order]
        keep, parent, dropped, seen = [], {}, set(), set()
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            if forest:
                rx, ry = find(parent, x), find(parent, y)
                if rx != ry:
                    parent[rx] = ry
                    keep.append(k)
                else:
                    dropped.add(x)
            elif (x, y) not in seen:
                seen.add((x, y))
                keep.append(k)
        lossy = {find(parent, x) for x in dropped}
        a, b = a[keep], b[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.array([find(parent, x) in lossy for x in a.tolist()], pa.bool_())], names=["a", "b", "lossy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))        # the last list may go on in the next batch
            if cut:
                yield chunk(t.slice(0, cut))
                held, rows = t.slice(cut).combine_chunks().to_batches(), len(g) - cut
        if rows:
            yield chunk(pa.Table.from_batches(held))
    return run


def _sets(size: int):
    """Shingle sets of the wanted nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = [shingles(t, size) for t in text_bytes(batch.column("text"))]
            keep = [k for k, (x, want) in enumerate(zip(s, batch.column("want").to_pylist())) if len(x) and node_of(x) == want]
            yield pa.RecordBatch.from_arrays([batch.column("want").take(pa.array(keep, pa.int64())),
                                              pa.array([s[k].tobytes() for k in keep], pa.binary())],
                                             names=["node", "s"])
    return run


def _checked(threshold: tuple[int, int]):
    p, q = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            linked = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                o = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(q * o >= p * (len(x) + len(y) - o))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("lossy"),
                                              pa.array(linked, pa.bool_())], names=["a", "b", "lossy", "linked"])
    return run


def _verify(pairs: DataFrame, docs: DataFrame, sigs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs with ``linked``: the similarity of the whole sets."""
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("lossy").alias("lossy")), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(sigs.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("id"))
                    .select("id", F.col("node").alias("want")), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("id")))
    sets = stored(found.select("want", "text").mapInArrow(_sets(size), "node long, s binary").dropDuplicates(["node"]), "sets")
    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"))
    return stored(full.select("a", "b", "lossy", "sa", "sb").mapInArrow(
        _checked(threshold), "a long, b long, lossy boolean, linked boolean"), "checked")


def _lists(sigs: DataFrame) -> DataFrame:
    """Inverted lists with two nodes at least; long ones as pairs of blocks."""
    nodes = sigs.where("n > 0").dropDuplicates(["node"])
    entries = nodes.select("node", F.explode("entries").alias("tok"))
    counts = entries.groupBy("tok").agg(F.count("*").alias("cnt")).where("cnt > 1")
    full = (entries.join(counts, "tok")
            .join(nodes.select("node", "n", "sketch"), "node"))
    blocks = F.ceil(F.col("cnt") / LIST_BLOCK).cast("int")
    full = full.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.hash("node"), F.col("blocks")))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return full.select(
        F.xxhash64("tok", F.least("blk", "other"), F.greatest("blk", "other")).alias("g"),
        F.when(F.col("blk") == F.col("other"), 0).when(F.col("blk") < F.col("other"), 1).otherwise(2).alias("side"),
        "n", "node", "sketch")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets of ``shingle`` words, similarity from the ratio ``threshold`` (below 1) on."""
    docs = texts(docs, id_col, text_col)
    seen = Observation()
    counted = docs.mapInArrow(_counts(shingle, threshold), "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    rare = F.when(F.col("n") < MIN_HOT, F.col("n"))
    often = stored(counted.observe(seen, F.sum("n").alias("entries"), F.sum(rare).alias("few"),
                                   F.sum(rare * rare).alias("squares")).where(f"n >= {MIN_HOT}"), "often")
    total = seen.get
    hot = often.where(F.col("n") >= max(MIN_HOT, (total["entries"] or 0) // HOT_SHARE)).select("tok").collect()
    hot_tokens = np.sort(np.array([r["tok"] for r in hot], np.int64).view(np.uint64))
    light = boundary((total["squares"] or 0) / (total["few"] or 1), threshold)
    sigs = stored(docs.mapInArrow(_signatures(hot_tokens, light, shingle, threshold),
                                  "doc_id long, n long, node long, sketch binary, entries array<long>"), "sigs")
    lists = stored(_lists(sigs), "lists")

    def scan(rows: DataFrame, forest: bool) -> DataFrame:
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(
            _scan(forest, threshold), "a long, b long, lossy boolean")

    first = _verify(scan(lists, True), docs, sigs, shingle, threshold)
    links = first.where("linked").select("a", "b")
    torn = first.where("lossy and not linked")
    if torn.limit(1).count():
        around = components(first.select("a", "b"))
        open_roots = torn.join(around, torn["a"] == around["node"]).select("root").distinct()
        open_nodes = around.join(open_roots, "root").select("node")
        parts = components(links)
        parts = open_nodes.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part"))
        second = _verify(scan(lists.join(stored(parts, "parts"), "node"), False), docs, sigs, shingle, threshold)
        links = links.union(second.where("linked").select("a", "b"))
    comps = components(links)
    least = (sigs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
             .join(comps, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = least.join(named, "root").select("node", "component_id")
    return (sigs.select("doc_id", F.col("n").alias("n_shingles"), "node").join(by_node, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive
w as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+', ' ', 'g'), ' '), lambda x: x <> '') as ws
      from documents),
s as (select doc_id, case when len(ws) = 0 then []
        when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) end as sh
      from w),
e as (select doc_id, len(sh) as n, unnest(sh) as t from s),
m as (select t from e group by t having count(*) > 1),
f as (select doc_id, n, t from e join m using (t)),
p as (select a.doc_id as x, b.doc_id as y from f a join f b on a.t = b.t and a.doc_id < b.doc_id
        and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      group by a.doc_id, b.doc_id, a.n, b.n
      having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l as (select x, y from p union all select y, x from p),
r(doc_id, node) as (select doc_id, doc_id from s union select r.doc_id, l.y from r join l on l.x = r.node),
c as (select doc_id, min(node) as component_id from r group by doc_id)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, c.component_id from s join c using (doc_id)
"""
