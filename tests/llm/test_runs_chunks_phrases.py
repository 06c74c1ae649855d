"""Operators 11, 12 and 13 against brute force, the tokenizers library and SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF001
from llm.conftest import CLASHING, SCHEMA, got, prose, rows_of

from keyedit.llm import chunk_bpe as cb
from keyedit.llm import collocations as co
from keyedit.llm import periodic_runs as pr
from keyedit.llm.common import table


# ---------------------------------------------------------------- 11: periodic runs

def brute_runs(w, exponent=4, least=6):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            smaller = any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q))
            if size >= max(least, exponent * q) and not smaller:
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def noisy(rng, size):
    k, w = rng.randrange(1, 4), []
    while len(w) < size:
        if rng.random() < .5:
            u = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
            w += (u * rng.randrange(1, 7))[:rng.randrange(1, 60)]
        else:
            w += [rng.randrange(k + 2) for _ in range(rng.randrange(1, 6))]
    return w


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 3), (3, 6), (5, 12), (4, 40)])
def test_runs_equal_brute_force(exponent, least):
    rng, found = random.Random(exponent * 100 + least), 0
    for _ in range(250):
        docs = [noisy(rng, rng.randrange(0, 90)) for _ in range(rng.randrange(1, 6))]
        runs = pr.find_runs(np.array([x for d in docs for x in d], int), np.array([len(d) for d in docs]), exponent, least)
        want = [brute_runs(d, exponent, least) for d in docs]
        assert runs == want
        found += sum(map(len, want))
    assert found > 20


def test_neighbouring_occurrences_are_enough_for_long_periods():
    """Seeds grow with the words, not with the pairs of equal grams, also where one word fills the text."""
    rng = random.Random(4)
    unit = [rng.randrange(50) for _ in range(700)]
    w = [99] * 5000 + unit * 5 + [rng.randrange(50) for _ in range(3000)] + [1, 2] * 4000
    runs = pr.find_runs(np.array(w), np.array([len(w)]))[0]
    assert runs[0] == (0, 5000, 1) and (5000, 3500, 700) in runs and (len(w) - 8000, 8000, 2) in runs
    seeds = sum(len(at) for at, _ in pr._seeds(pr.Grams(np.array(w), np.zeros(len(w), int)), len(w), 4, 6))
    assert seeds < 4 * len(w)
    with pytest.raises(ValueError):
        pr.find_runs(np.array([1, 1]), np.array([2]), exponent=2)


def test_strongest_run_and_ties():
    assert pr.strongest([]) is None
    assert pr.strongest([(9, 12, 3), (0, 8, 2), (0, 12, 3), (4, 7, 2)]) == (0, 8, 2)
    assert pr.strongest([(5, 4 * (10 ** 15) + 1, 10 ** 15), (0, 4, 1)])[0] == 5


def brute_op11(doc_id, text):
    w = [x for x in __import__("re").split("[ \t-\r]+", text or "") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_op11_equals_brute_force(spark):
    rng = random.Random(6)
    given = [(r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect() if len(r["text"] or "") < 9000][:60]
    made = [(10_000 + k, " ".join("abcd"[x % 4] for x in noisy(rng, 120))) for k in range(60)]
    docs = spark.createDataFrame(rows_of(given + made), SCHEMA).repartition(3)
    want = [brute_op11(d, t) for d, t in given + made]
    assert sum(w[1] for w in want) > 30
    assert got(pr.run_digests(docs, pr.planted)) == sorted(want, key=str)


def test_op11_edge_rows(spark, edge, nothing):
    assert pr.run_digests(nothing, pr.planted).collect() == [] and pr.periodic_runs(nothing).collect() == []
    want = [brute_op11(r["doc_id"], r["text"]) for r in edge.collect() if len(r["text"] or "") < 6000]
    short = edge.where(F.coalesce(F.length("text"), F.lit(0)) < 6000)
    assert got(pr.run_digests(short, pr.planted)) == sorted(want, key=str)
    out = {r["doc_id"]: r for r in pr.periodic_runs(edge).collect()}
    assert out[2]["n_words"] == out[3]["n_words"] == out[4]["n_words"] == 0 and out[2]["collapsed"] == "" and out[2]["runs"] == []
    assert [tuple(x) for x in out[14]["runs"]] == [(0, 300, 1)] and out[14]["collapsed"] == "Of"
    assert out[11]["collapsed"] == "Two words"
    assert len(out) == len({r["doc_id"] for r in edge.collect()}) and set(CLASHING) - set(pr.periodic_runs(edge).columns)


# ---------------------------------------------------------------- 12: BPE by chunks

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(cb.MODEL))


@pytest.fixture(scope="module")
def chunked():
    return cb.ChunkEncoder(public_tokenizers.path(cb.MODEL))


ALPHABETS = ["ab", "xyz0129 ", "日本語 é'lsre tv", "  \n\t'sllred a1!", "\x00\x85\xa0 aé1'", "etaoin shrdlu. ", "𝒳👩‍🚀 n", " "]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_any_text_gets_the_ids_of_the_library(chunked, library, alphabet, monkeypatch):
    """Also with chunks of a few bytes, so that joins fall everywhere."""
    rng = random.Random(alphabet)
    for least, most, bits in [(512, 16384, 11), (24, 60, 3), (1, 40, 1)]:
        monkeypatch.setattr(cb, "LEAST", least)
        monkeypatch.setattr(cb, "MOST", most)
        monkeypatch.setattr(cb, "CUT_BITS", bits)
        for size in (0, 1, 7, 60, 700, 6000):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            ids = chunked.encode(text.encode())
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert chunked.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_cuts_follow_content():
    """A passage is cut alike wherever it stands, and chunks put together are the text."""
    rng = random.Random(8)
    passage = prose(rng, 4000).encode()
    cut = cb.chunks_of(passage)
    other = cb.chunks_of(prose(rng, 900).encode() + b" " + passage + b" " + prose(rng, 300).encode())
    assert b"".join(cut) == passage and len(set(cut) & set(other)) >= len(cut) - 4 > 3
    for c in cut + cb.chunks_of("é".encode() * 30_000):
        c.decode()
        assert len(c) <= cb.MOST


def test_texts_with_an_added_token_go_whole(chunked, library):
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x" * 5000 + " <|endoftext|><|endoftext|> end " * 300):
        assert chunked.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 50256 in chunked.encode(b"a <|endoftext|> b")


def digests(library, docs):
    out = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op12_equals_the_library(spark, library, edge, nothing):
    assert got(cb.op12_bpe(spark, SF001)) == digests(library, table(spark, SF001, "documents"))
    assert got(cb.chunked_digests(edge)) == digests(library, edge)
    assert cb.chunked_digests(nothing).collect() == []
    for r in cb.encode_chunked(edge).collect():
        assert r["ids"] == library.encode(r["decoded"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_shared_chunks_are_encoded_once_for_all_tasks(spark, library, monkeypatch):
    """Chunks of a text with many copies, and of a passage in other texts, come back within the bounds; ids stay right."""
    rng = random.Random(9)
    passage = prose(rng, 900)
    pairs = [(k, passage if k < 20 else prose(rng, 40) + " " + passage if k < 30 else prose(rng, 300)) for k in range(40)]
    docs = spark.createDataFrame(rows_of(pairs + [(None, None), (3, "")]), SCHEMA).repartition(6)
    path = public_tokenizers.path(cb.MODEL)
    found = dict(cb.shared_chunks(cb.texts(docs), path))
    assert set(cb.chunks_of(passage.encode())) <= set(found)
    for c, ids in found.items():
        assert np.frombuffer(ids, np.uint16).tolist() == library.encode(c.decode(), add_special_tokens=False).ids
    want = digests(library, docs)
    assert got(cb.chunked_digests(docs)) == want
    monkeypatch.setattr(cb, "SHARED_BYTES", 2000)
    some = cb.shared_chunks(cb.texts(docs), path)
    assert sum(len(c) for c, _ in some) <= 2000 and len(some) < len(found)
    assert got(cb.chunked_digests(docs)) == want


# ---------------------------------------------------------------- 13: collocations

def sql13(rows, least=co.LEAST, top=co.TOP):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": pa.array([r[0] for r in rows], pa.string()),
                                        "lang": pa.array([r[1] for r in rows], pa.string())}))
    sql = co.OP13_SQL.replace(f">= {co.LEAST}", f">= {least}").replace(f"rank <= {co.TOP}", f"rank <= {top}")
    return sorted(con.execute(sql).fetchall(), key=str)


def langs(spark, rows):
    full = [(k, t, lang, *[None] * (2 + len(CLASHING))) for k, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def test_op13_equals_sql(spark):
    want = duckdb.sql(co.OP13_SQL.replace("from documents", f"from read_parquet('{SF001}/documents.parquet')")).fetchall()
    assert got(co.op13_collocations(spark, SF001)) == sorted(want, key=str) and want


def test_phrases_equal_sql_on_odd_texts(spark):
    """Ties, overlaps, separators of all kinds, equal texts in two languages, no language, long and blank texts."""
    rng = random.Random(3)
    words = ["a", "b", "c", "A", "Bé", "\x00", "x-y", "日本"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n\n", "\r", " ; ", "\x0b", "?!"])
                     for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" .\n ", "de"), ("a " * 3000, "en"), ("b c " * 400 + "b", None), ("...", "fr")]
    rows += [("one text that many have in full length, word for word", "en")] * 12
    for least, top in [(3, 2000), (5, 7)]:
        out = co.collocations(langs(spark, rows), least=least, top=top)
        assert got(out) == sql13(rows, least, top)
    assert co.collocations(langs(spark, []).limit(0)).collect() == []


def test_parse_is_free_of_its_surroundings():
    """Chunks overlap by the trigger, cover each text once, and equal passages give equal chunks."""
    rng = random.Random(5)
    passage = prose(rng, 600)
    texts = [t.encode() for t in (passage, prose(rng, 50) + " " + passage + " " + prose(rng, 50), "one", "", " . ", "a " * 2000)]
    parsed = co.parse(texts)
    for text, chunks in zip(texts, parsed):
        tokens = [co.END if x[0] == 10 else x for x in co._TOKENS.findall(text.translate(co._TO_STREAM))]
        tokens = tokens[tokens[:1] == [co.END]:len(tokens) - (tokens[-1:] == [co.END])]
        owned = [x for c in chunks for x in c.split(b" ")[:-co.OVERLAP]]
        assert owned == tokens
        for a, b in zip(chunks, chunks[1:]):
            assert (b.split(b" ") + [co.END] * co.OVERLAP)[:co.OVERLAP] == a.split(b" ")[-co.OVERLAP:]
        assert all(len(c.split(b" ")) <= co.MOST + co.OVERLAP for c in chunks)
    assert len(set(parsed[0]) & set(parsed[1])) >= len(parsed[0]) - 2 > 5


def test_bitmap_holds_what_was_sent(spark):
    h = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 5000)
    held = co.Bitmap(co.bitmap_parts(spark.createDataFrame([(int(x),) for x in h] + [(-1,), (0,), (2 ** 63 - 1,), (-2 ** 63,)], "h long")))
    assert held.holds(h.view(np.uint64)).all() and held.holds(np.array([0, 2 ** 64 - 1, 2 ** 63], np.uint64)).all()
    other = np.random.default_rng(2).integers(-2 ** 63, 2 ** 63 - 1, 5000)
    assert held.holds(other.view(np.uint64)).mean() < 0.01


def test_phrases_of_small_batches_are_summed_together():
    """Spark hands over chunks in batches of a few hundred KB; a phrase is sent once for all of them."""
    chunk = pa.RecordBatch.from_arrays([pa.array(["en"] * 2), pa.array([b"a b c \n \n \n", b"b c d \n \n \n"]), pa.array([3, 4])],
                                       names=["lang", "chunk", "n"])
    rows = [(h, f) for b in co._count_short(iter([chunk] * 20)) for h, f in zip(*(c.to_pylist() for c in b.columns))]
    assert len(rows) == len({h for h, _ in rows}) == 7
    assert sorted(f for _, f in rows) == [60, 60, 80, 80, 140, 140, 140]
