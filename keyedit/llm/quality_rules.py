"""Operator 1, quality rules (DataFrame functions only).

Line first: every line is judged by punctuation, navigation and boilerplate
rules, failing lines are removed, and a document that loses too much of its
text is rejected. Beside the verdict stand the plain counts of the document.

Defined cases: a NULL or empty text has no words, all counts are 0, it fails
the base rule and is not kept. Repeated rows are judged one by one. Other
columns are ignored. All work is per row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import WS_CLASS, table, texts

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a boilerplate line (lower case).
BOILERPLATE = ("licensed under", "all rights reserved", "terms of use", "privacy policy",
               "cookie policy", "click here", "sign up for", "enable javascript", "lorem ipsum")
NAVIGATION = "|<>»"
MIN_WORDS = 50            # base rule: fewer words fail
MAX_REPEAT_PCT = 50       # base rule: more repeated words fail
MAX_SYMBOL_PCT = 10       # line: symbols against non-space characters
MAX_BANG_PCT = 10         # line: exclamation marks against non-space characters
MIN_NAV_MARKS = 3         # line: from so many separators on, and
MIN_NAV_PCT = 20          # so many to 100 words, it is navigation
MAX_BOILER_WORDS = 30     # line: boilerplate phrases count in short lines
MAX_LOSS_PCT = 50         # document: more of its non-space characters lost rejects it


def _n(text, chars: str):
    """Occurrences of any of ``chars`` in a short text."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _solid(words):
    """Code points of an array of words."""
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w))


def _words(text):
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def _line(line):
    """What the line rules look at: each text is scanned once per feature."""
    return F.struct(line.alias("line"), _words(line).alias("words"),
                    F.regexp_replace(line, F.lit("[^!»" + SYMBOLS + "]+"), F.lit("")).alias("marks"))


def _line_fails(x):
    words, solid, nav = F.size(x["words"]), _solid(x["words"]), _n(x["marks"], NAVIGATION)
    marked = x["marks"] != ""
    return ((marked & ((_n(x["marks"], SYMBOLS) * 100 > solid * MAX_SYMBOL_PCT)
                       | (_n(x["marks"], "!") * 100 > solid * MAX_BANG_PCT)
                       | ((nav >= MIN_NAV_MARKS) & (nav * 100 >= words * MIN_NAV_PCT))))
            | ((words <= MAX_BOILER_WORDS) & F.lower(x["line"]).rlike("|".join(BOILERPLATE))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, cleaned text, and the verdict ``kept``."""
    base = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = base.select(
        "doc_id", _words(F.col("text")).alias("words"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.transform(F.split("text", "\n"), _line), lambda x: F.size(x["words"]) > 0).alias("lines"))
    d = d.select(
        "*", F.sort_array(F.slice(
            F.transform("words", lambda w, i: F.struct(
                F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))),
            F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))).alias("win"),
        F.filter("lines", lambda x: ~_line_fails(x)).alias("good"))
    d = d.withColumn("at", F.sort_array(F.filter(
        F.transform("win", lambda x, i: F.when(
            (x["h"] == F.get("win", i - 1)["h"]) | (x["h"] == F.get("win", i + 1)["h"]), x["i"])),
        lambda x: x.isNotNull())))
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        _solid(F.col("words")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct(F.col("lines.line")))).cast("long").alias("n_dup_lines"),
        F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))),
                    F.lit(0), lambda a, b: a + b).cast("long").alias("n_repeat_words"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        F.array_join(F.col("good.line"), "\n").alias("clean_text"),
        F.aggregate(F.col("good.words"), F.lit(0), lambda a, w: a + _solid(w)).alias("left"))
    d = d.withColumn("chars_removed", F.col("word_chars") - F.col("left")).drop("left")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed")
                        & (100 * F.col("chars_removed") <= MAX_LOSS_PCT * F.col("word_chars")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines_removed", "chars_removed")


_W = r"[\x09-\x0D ]"
_CHARS = "length(regexp_replace({0}, '[\\x09-\\x0D ]', '', 'g'))"
_BOIL = " or ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)

OP1_SQL = rf"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text,
        list_filter(regexp_split_to_array(text, '{_W}+'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) as lines
      from t),
win as (select rid, unnest(range(1, len(words) - 1)) as i, words from w),
keyed as (select rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] as k from win),
dups as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from keyed) where n > 1),
rep as (select rid, cast(sum(least(3, coalesce(nx - i, 3))) as bigint) as n_repeat_words
        from (select rid, i, lead(i) over (partition by rid order by i) as nx from dups) group by rid),
f as (select w.*, list_filter(lines, lambda x:
        not (length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 100 > {_CHARS.format('x')} * {MAX_SYMBOL_PCT}
          or length(regexp_replace(x, '[^!]', '', 'g')) * 100 > {_CHARS.format('x')} * {MAX_BANG_PCT}
          or (length(regexp_replace(x, '[^|<>»]', '', 'g')) >= {MIN_NAV_MARKS}
              and length(regexp_replace(x, '[^|<>»]', '', 'g')) * 100 >= {MIN_NAV_PCT} * len(list_filter(regexp_split_to_array(x, '{_W}+'), lambda y: y <> '')))
          or (({_BOIL}) and len(list_filter(regexp_split_to_array(x, '{_W}+'), lambda y: y <> '')) <= {MAX_BOILER_WORDS}))) as good
      from w),
c as (select doc_id, cast(len(words) as bigint) as n_words,
        cast({_CHARS.format('text')} as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words,
        cast(len(lines) - len(good) as bigint) as n_lines_removed,
        cast({_CHARS.format('text')} - coalesce(list_sum(list_transform(good, lambda x: {_CHARS.format('x')})), 0) as bigint) as chars_removed
      from f left join rep using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) as base_failed,
  (not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)
   and 100 * chars_removed <= {MAX_LOSS_PCT} * word_chars) as kept,
  n_lines_removed, chars_removed
from c
"""
