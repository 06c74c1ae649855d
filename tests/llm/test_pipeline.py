import hashlib
import random

import duckdb
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from conftest import SF001
from llm.conftest import SCHEMA, got, prose, rows_of
from llm.test_rules_and_dedup import near_copies

from keyedit.llm import decontaminate as dc
from keyedit.llm import jaccard_join as jj
from keyedit.llm import pieces as pc
from keyedit.llm import quality_model as qm
from keyedit.llm import secret_scan as ss
from keyedit.llm.common import table, texts


def duck(sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return con.execute(sql).df()


def test_pipeline_equals_brute_force(spark):
    """Every stage's decisions, made again stage by stage, and the library's ids of what is left."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pc.MODEL))
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    bench = table(spark, SF001, "benchmark").toPandas()
    good = [r["doc_id"] for r in qm.quality_scores(docs, labels).collect() if r["predicted"]]
    left = docs.toPandas().set_index("doc_id", drop=False).loc[good]
    left = left.sort_index()
    left = left.iloc[sorted(set(linked(left.text.tolist(), 5, 4, 5)))]
    hit = duck(dc.OP4_SQL, documents=left.reset_index(drop=True), benchmark=bench)
    left = left.loc[hit[~hit.contaminated].doc_id]
    assert 0 < len(left) < len(good) < docs.count()
    words, forest = ss.learn_secrets(spark.createDataFrame(left.reset_index(drop=True)))
    want = []
    for d, text, source in zip(left.doc_id, left.text, left.source):
        for at, w, p in reversed(ss._judge(text, source, words, forest)):
            if p >= ss.THRESHOLD:
                text = text[:at] + ss.MASK + text[at + len(w):]
        ids = sp.encode(text)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got(cp.run(spark, SF001)) == sorted(want, key=str)


def test_stages_handle_edge_rows(spark, edge, nothing):
    """Nulls, blanks, repeated ids and clashing columns pass every stage; all but the last return the columns of documents."""
    for docs in (edge, nothing):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, SF001)
            if k < len(cp.STAGES) - 1:
                assert out.columns == cp.COLUMNS
            n = out.count()
            assert n <= docs.count()
    ids = sorted((r["doc_id"] for r in cp.near_duplicates(spark, edge, SF001).collect()), key=str)
    # one text under 1, 6, 7, 7, 12 (with a word more) and NULL stays once; the two texts of id 8 are two rows
    assert ids == sorted([1, 2, 3, 4, 5, 8, 8, 9, 10, 11, 13, 14], key=str)


def linked(texts, size, p, q):
    """The smallest place of each text's component, by all pairs."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if q * min(len(x), len(y)) >= p * max(len(x), len(y)) and q * (o := len(x & y)) >= p * (len(x) + len(y) - o):
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    return [find(k) for k in range(len(texts))]


def test_near_duplicates_are_five_words_and_four_fifths(spark):
    """Groups that drift, and copies with a block of new text (similarity between 0.8 and 0.9), of short and long texts."""
    rng = random.Random(11)
    found = [t for k, size in enumerate((4, 5, 6, 8, 9, 12, 24, 148, 2500)) for t in near_copies(k, 24, size)]
    for size in (200, 3000):
        for k in range(6):
            t = prose(rng, size)
            found += [t, t + " " + prose(rng, size * (12 + 3 * k) // 100)]
    want = linked(found, 5, 4, 5)
    assert want != linked(found, 3, 9, 10)
    docs = spark.createDataFrame(rows_of(list(enumerate(found))), SCHEMA).repartition(4)
    comp = jj.jaccard_components(docs, shingle=5, threshold=(4, 5))
    assert {r["doc_id"]: r["component_id"] for r in comp.collect()} == dict(enumerate(want))
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, SF001).collect()) == sorted(set(want))


def test_rows_of_one_id_are_judged_by_themselves(spark):
    """Only real copies and contaminated rows go, whatever other rows hold their id."""
    rng = random.Random(12)
    a, b, c, d, e = (prose(rng, 90) for _ in range(5))
    item = next(r["text"] for r in table(spark, SF001, "benchmark").collect() if len(r["text"].split()) >= 10)
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c), (3, d), (3, b), (None, e), (None, a), (None, None), (None, c + " end"), (None, ""), (4, "")]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5)
    kept = [(1, a), (2, b), (3, c), (3, d), (None, e), (None, None), (None, ""), (4, "")]
    out = cp.near_duplicates(spark, docs, SF001)
    assert out.columns == cp.COLUMNS
    assert got(out.select("doc_id", "text")) == sorted(kept, key=str)
    more = docs.union(spark.createDataFrame(rows_of([(None, c + " " + item), (2, item)]), SCHEMA))
    out = cp.decontaminated(spark, more, SF001)
    assert got(out.select("doc_id", "text")) == sorted(rows, key=str)


def test_pipeline_keeps_what_all_pairs_leave(spark):
    """The stages up to the third against brute force, at five words and 0.8."""
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    good = {r["doc_id"] for r in qm.quality_scores(docs, labels).collect() if r["predicted"]}
    left = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    root = linked([t for _, t in left], 5, 4, 5)
    left = docs.where(F.col("doc_id").isin([left[k][0] for k in set(root)])).toPandas()
    hit = duck(dc.OP4_SQL, documents=left, benchmark=table(spark, SF001, "benchmark").toPandas())
    assert {r["doc_id"] for r in cp.run(spark, SF001).collect()} == set(hit[~hit.contaminated].doc_id)


def test_bounds_at_four_fifths():
    t = 4, 5
    for n in range(1, 50):
        for m in range(n, 64):
            for o in range(0, n + 1):
                if 5 * o >= 4 * (n + m - o) and not n == m == o:
                    assert o >= jj.shared(n, m, t)
                    assert jj.shared(n, m, t) in jj.subset_sizes(n, t) and jj.shared(n, m, t) in jj.subset_sizes(m, t)
                    assert n - jj.prefix_length(n, t) + 1 <= o
    for n in (10, 2000, 100_000):       # unrelated sets differ in half of the bits
        assert jj.sketch_bits(n, t) * 9 > 2 * 2 * n


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality_model", "jaccard_join", "decontaminate", "secret_scan", "pieces"]


def test_dropped_ids_by_broadcast_and_by_shuffle(spark, edge, monkeypatch):
    gone = spark.createDataFrame([(1,), (7,), (None,)], "doc_id long")
    a = got(cp.without(edge, gone).select("doc_id"))
    monkeypatch.setattr(cp, "BROADCAST_IDS", 0)
    assert got(cp.without(edge, gone).select("doc_id")) == a
    assert not {1, 7, None} & {r[0] for r in a}


def test_batches_and_workers_stay_small(spark):
    """Long rows, as the segments of an index, come to a worker a few MB at a time, and its Arrow memory goes back to the system."""
    rows = spark.range(12).repartition(1).selectExpr("id doc_id", "repeat('x', 1 << 20) text")

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"n": b.num_rows, "size": b.column("text").nbytes, "pool": pa.default_memory_pool().backend_name}])

    found = texts(rows).mapInArrow(seen, "n long, size long, pool string").collect()
    assert sum(r["n"] for r in found) == 12
    assert max(r["size"] for r in found) <= 5 << 20
    assert {r["pool"] for r in found} == {"system"}
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512      # rows of a Parquet file decoded at once
