import hashlib
import random
from collections import defaultdict

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from conftest import SF001
from llm.conftest import SCHEMA, got, prose, rows_of

from keyedit.llm import decontaminate as dc
from keyedit.llm import jaccard_join as jj
from keyedit.llm import suffix_dedup as sd
from keyedit.llm.common import table
from keyedit.llm.components import components
from keyedit.llm.quality_rules import OP1_SQL, quality_rules


def duck(sql, documents, benchmark=None):
    con = duckdb.connect()
    con.register("documents", documents)
    if benchmark is not None:
        con.register("benchmark", benchmark)
    return sorted((tuple(r) for r in con.execute(sql).fetchall()), key=str)


def pdf(df):
    return pd.DataFrame([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()],
                        columns=["doc_id", "text"]).astype({"doc_id": "Int64"})


# ---------------------------------------------------------------- 1

def test_quality_rules_edge_rows_equal_sql(edge):
    a = quality_rules(edge).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                   "base_failed", "kept", "n_lines_removed", "chars_removed")
    assert got(a) == duck(OP1_SQL, pdf(edge))


def test_quality_rules_lines(spark):
    good = "\n".join(prose(random.Random(k), 20) + "." for k in range(6))
    bad = "Home | News | Sport | Shop\nClick here\n"
    rows = quality_rules(spark.createDataFrame(rows_of([(1, good), (2, good + "\n" + bad), (3, bad * 20 + good)]), SCHEMA))
    r = {x["doc_id"]: x for x in rows.collect()}
    assert r[1]["kept"] and r[1]["n_lines_removed"] == 0
    assert r[2]["kept"] and r[2]["clean_text"] == good and r[2]["n_lines_removed"] == 2
    assert not r[3]["kept"]


def test_quality_rules_empty(nothing):
    assert quality_rules(nothing).count() == 0


# ---------------------------------------------------------------- 4

def test_decontaminate_edge_rows_equal_sql(spark, edge):
    long = [r["text"] for r in edge.where("doc_id = 5").collect()][0].split()
    items = [(1, " ".join(long[50:75])), (2, "one"), (3, None), (4, ""), (5, "TWO words!"), (6, " ".join(long[60:70])),
             (6, " ".join(long[60:70])), (None, "one"), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a = got(dc.decontaminate(edge, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    b = duck(dc.OP4_SQL, pdf(edge), pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert a == b
    assert any(r[2] for r in a)


def test_decontaminate_in_blocks(spark, edge, monkeypatch):
    long = [r["text"] for r in edge.where("doc_id = 5").collect()][0]
    bench = spark.createDataFrame([(1, long[:900]), (2, long[300:1500]), (3, "one")], "item_id long, text string")
    whole = got(dc.decontaminate(edge, bench))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 4000)
    assert got(dc.decontaminate(edge, bench)) == whole


def test_decontaminate_takes_one_worker_a_task(spark, edge):
    """Search and digests are one Python step: two in a row hold two workers for each task at once."""
    bench = spark.createDataFrame([(1, "one"), (2, "not there")], "item_id long, text string")
    plan = dc.decontaminate(edge, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def row_groups(index):
    """Rows and bytes of each row group of a stored table."""
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    return [(m.row_group(k).num_rows, m.row_group(k).total_byte_size) for m in groups for k in range(m.num_row_groups)]


def test_index_of_a_large_task_is_stored_in_small_row_groups(spark):
    """Writer and reader hold a row group: with the writer's defaults all segments of this task (F1: executor memory)."""
    number = "cast(pmod(xxhash64(x, id), 60000) as string)"
    docs = spark.range(0, 48, 1, 1).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 120000), x -> {number}), ' ') as text")
    index = dc.build_index(docs)
    groups = row_groups(index)
    assert sum(n for n, _ in groups) == index.count() == 12
    assert max(n for n, _ in groups) <= 6 and max(size for _, size in groups) < 24 << 20
    assert sorted(d for r in index.select("doc_ids").collect() for d in r["doc_ids"]) == list(range(48))


def test_segments_are_bounded_by_bytes(spark):
    """Few words may be many bytes, and empty texts have no words at all."""
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "concat('w', id, repeat('x', 1000000), ' same') as text")
    index = dc.build_index(docs)
    assert max(sum(map(len, r["terms"])) for r in index.select("terms").collect()) <= dc.SEGMENT_BYTES
    bench = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert got(dc.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit")) == sorted(((i, 2, 1) for i in range(40)), key=str)
    empty = dc.build_index(spark.range(0, 200_000, 1, 1).selectExpr("id as doc_id", "cast(null as string) as text"))
    assert sum(len(r["doc_ids"]) for r in empty.collect()) == 200_000
    assert max(len(r["doc_ids"]) for r in empty.collect()) <= dc.SEGMENT_BYTES // dc.DOC_BYTES


def test_decontaminate_empty(spark, nothing, edge):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(nothing, bench).count() == 0
    assert {r["n_hit"] for r in dc.decontaminate(edge, bench).collect()} == {0}


def test_proximity_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("a b c d e f g h i j k l m n o p".split()) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    index = dc.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    queries = ["a b c", "d d", "p o n m", "zz a"]
    found = {(r["doc_id"], r["query"]) for r in dc.near_hits(index, queries, 6).collect()}
    want = {(i, q) for i, t in docs for q in queries
            if any(set(q.split()) <= set(t.split()[k:k + 6]) for k in range(len(t.split())))}
    assert found == want


# ---------------------------------------------------------------- 6

def brute_repeats(pairs):
    seen, out = set(), []
    for i, t in pairs:
        t = (t or "").encode()
        m = bytearray(len(t))
        for p in range(len(t) - sd.LENGTH + 1):
            w = t[p:p + sd.LENGTH]
            if w in seen:
                m[p:p + sd.LENGTH] = b"\1" * sd.LENGTH
            seen.add(w)
        kept = bytes(c for c, x in zip(t, m) if not x)
        spans = sum(1 for q in range(len(t)) if m[q] and (q == 0 or not m[q - 1]))
        out.append((i, len(t), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows(n=120, seed=4):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 200)) for _ in range(20)]
    rows = []
    for i in range(n):
        t, k = rng.choice(base), rng.random()
        at = rng.randrange(len(t))
        rows.append((i, t if k < .3 else t[:at] + "XY" + t[at + rng.randrange(5):] if k < .6 else "Of " * rng.randrange(20, 300)
                     if k < .7 else "a" * rng.randrange(0, 500) if k < .75 else t[:200] + prose(rng, 90)))
    return rows


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_RUNS", hot)
    rows = repeat_rows() + [(1000, ""), (1001, None)]
    assert got(sd.remove_repeats(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5))) == brute_repeats(rows)


def test_repeats_of_edge_rows(edge):
    """Rows with one doc_id follow a hash of their text; NULL ids come first."""
    rows = [(r["doc_id"], r["text"]) for r in edge.selectExpr("doc_id", "text", "xxhash64(text) as t").orderBy("doc_id", "t").collect()]
    assert got(sd.remove_repeats(edge)) == brute_repeats(rows)


def test_repeats_on_tables(spark):
    docs = table(spark, SF001, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    assert got(sd.op6_suffix_dedup(spark, SF001)) == brute_repeats(rows)


def test_repeats_empty(nothing):
    assert sd.remove_repeats(nothing).count() == 0


def test_family_of_levels_finds_every_repeat():
    """Batches of one anchor: levels merge geometrically and forget nothing."""
    import numpy as np
    rng = random.Random(5)
    family, seen = sd.Family(), set()
    for _ in range(60):
        new = np.unique(np.array([f"{rng.randrange(900):0100d}".encode() for _ in range(rng.randrange(1, 40))], "S100"))
        old = family.seen(new)
        assert old.tolist() == [w in seen for w in new.tolist()]
        family.add(new[~old])
        seen.update(new.tolist())
        assert len(family.levels) <= 12
    assert sum(map(len, family.levels)) == len(seen)


def test_runs_in_pieces_and_batches(monkeypatch):
    """Small pieces, stretches and batches change nothing."""
    import pyarrow as pa
    rows = repeat_rows(60, 8)

    def removed():
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])]
        found = [x for b in sd._find([pa.RecordBatch.from_arrays(cols, names=["doc", "text"])]) for x in b.to_pylist()]
        found.sort(key=lambda r: (r["h"], r["sh"] is None, r["sh"] or 0, r["doc"], r["s0"]))
        schema = pa.schema([(c, pa.int64()) for c in sd._RUN_NAMES])
        batches = [pa.RecordBatch.from_pylist(found[k:k + 7], schema=schema) for k in range(0, len(found), 7)]
        judged = [x for b in sd._settle(batches) for x in b.to_pylist()]
        text = {i: t.encode() for i, t in rows}
        runs = sorted((x["h"], x["doc"], x["s0"], x["nw"], text[x["doc"]][x["s0"]:x["s0"] + x["nw"] + 99]) for x in judged if x["sh"] is not None)
        batch = pa.RecordBatch.from_pylist([dict(zip(("h", "doc", "s0", "nw", "bytes"), r)) for r in runs])
        done = [x for x in judged if x["sh"] is None] + [x for b in sd._scan([batch]) for x in b.to_pylist()]
        covered = defaultdict(set)
        for x in done:
            covered[x["doc"]].update(range(x["s0"], x["s0"] + x["nw"] + 99))
        return {i: len(c) for i, c in covered.items()}

    want = {i: n for i, _, n, _, _ in brute_repeats(rows) if n}
    assert removed() == want
    for name, value in (("PIECE", 150), ("JOINED", 400), ("BATCH_WINDOWS", 60)):
        monkeypatch.setattr(sd, name, value)
        assert removed() == want, name


# ---------------------------------------------------------------- 9

def test_jaccard_edge_rows_equal_sql(edge):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert got(jj.jaccard_components(docs)) == duck(jj.OP9_SQL, pdf(docs))


def test_jaccard_repeated_and_null_ids(edge):
    r = defaultdict(list)
    for x in jj.jaccard_components(edge).collect():
        r[x["doc_id"]].append((x["n_shingles"], x["component_id"]))
    assert r[None][0][1] == 1 and r[6][0][1] == 1 and [c for _, c in r[7]] == [1, 1] and r[12][0][1] == 1
    assert r[2] == [(0, 2)] and r[3] == [(0, 3)] and r[4] == [(0, 4)]
    assert len(r[8]) == 2 and {c for _, c in r[8]} == {8}


def test_jaccard_empty(nothing):
    assert jj.jaccard_components(nothing).count() == 0


def near_copies(seed, n, size):
    """A group whose members drift apart, short texts among them."""
    rng = random.Random(seed)
    out, t = [], [rng.choice("a b c d e f g h i j k l".split()) + str(rng.randrange(30)) for _ in range(size)]
    for i in range(n):
        t = list(t)
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = "w" + str(rng.randrange(1000))
        if rng.random() < .15:
            t.pop()
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block", [2000, 5])
def test_jaccard_equals_sql(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "LIST_BLOCK", block)
    found = [t for k, size in enumerate((9, 10, 12, 20, 24, 40, 148, 2500, 5000)) for t in near_copies(k, 40, size)]
    random.Random(9).shuffle(found)
    docs = spark.createDataFrame(rows_of(list(enumerate(found))), SCHEMA).repartition(4)
    assert got(jj.jaccard_components(docs)) == duck(jj.OP9_SQL, pdf(docs))


def test_light_and_heavy_bounds():
    for n in range(1, 60):
        for m in range(n, 70):
            for o in range(0, n + 1):
                linked = 10 * o >= 9 * (n + m - o)
                if linked and not n == m == o:
                    assert o >= jj.shared(n, m)
                    assert jj.shared(n, m) in jj.subset_sizes(n) and jj.shared(n, m) in jj.subset_sizes(m)
                    assert n - jj.prefix_length(n) + 1 <= o
    assert jj.boundary(1.0) < jj.boundary(50.0) <= jj.LIGHT_LIMIT


def test_components_equal_union_find(spark):
    from keyedit.llm.components import find
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    c = components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["node"]: r["root"] for r in c.collect()} == {x: find(parent, x) for x in nodes}
