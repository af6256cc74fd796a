"""Line-first cleaning: rules judge lines, failing lines go, documents that lose too much text are rejected.

Native: every column is a Spark SQL expression over one row, so the operator is one scan without a
shuffle, whatever the sources or copies look like.

A line passes if it has a word and
* punctuation: it ends in a sentence mark (closing quotes and brackets may follow), and runs of ``!`` and
  ``?`` are at most one per ``PER_WORDS`` words;
* navigation: separator and markup symbols are at most one per ``PER_WORDS`` words;
* boilerplate: it holds none of the phrases of site chrome and licence notices.

Blank lines stay but count nothing. A document is kept if it passes the base rules (at least
``MIN_WORDS`` words, at most half of them inside repeated three-word windows) and the lines that pass hold
at least ``1 - MAX_LOSS`` of its words.

A null text counts as an empty one: no words, rejected by the base rules, cleaned text null. An empty table
gives an empty result; repeated rows are judged alike; other columns pass through untouched, whatever
their names, except that columns named like the operator's own outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.llm.common import BLANKS, WORD, let, table, with_extras_aside

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS_PERCENT = 30
PER_WORDS = 10
SYMBOLS = "#*$%&|<>"
# Fixed phrases of site chrome and notices, in natural order.
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "is licensed under",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "terms of use",
]
ENDS = r"[.!?:;\x{2026}\x{3002}]['\")\]\x{2019}\x{201D}\x{00BB}]*[\x20\x09-\x0D]*\z"
RUNS = r"[!?][!?]+"
PHRASES = "(?i)" + "|".join(BOILERPLATE)


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


def line_passes(line: Column, words: Column) -> Column:
    return (
        line.rlike(ENDS)
        & (symbols_in(line) * PER_WORDS <= words)
        & (F.regexp_count(line, F.lit(RUNS)) * PER_WORDS <= words)
        & ~line.rlike(PHRASES)
    )


def judged_lines(text: Column) -> Column:
    """Array of (line, words, passes) in order; a blank line passes with no words."""
    def judge(line: Column) -> Column:
        return let(words_in(line), lambda n: F.struct(
            line.alias("line"), n.alias("words"), ((n == 0) | line_passes(line, n)).alias("passes")))

    return F.transform(F.split(text, "\n", -1), judge)


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text, the first occurrence included."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
            return F.array_sort(F.transform(same, lambda x: x.i))

        # two windows that start closer than three words apart share the words between
        at = let(by_hash, repeated)
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    def count(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - 2)
        windows = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return F.when(n < 3, F.lit(0)).otherwise(let(words, count)).cast("bigint")


def clean_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, ``kept`` and ``clean_text`` (the passing lines) to every row."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept", "clean_text"]
    body = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(body, "\n", -1), has_word)
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    judged = let(judged_lines(body), lambda lines: F.struct(
        F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x.passes, x.words).otherwise(0)).alias("n_kept_words"),
        F.array_join(F.transform(F.filter(lines, lambda x: x.passes), lambda x: x.line), "\n").alias("clean_text"),
    ))
    counts = let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    out = df.drop(*[c for c in own if c != text]).select(
        "*",
        counts.alias("__counts"),
        judged.alias("__judged"),
        F.length(F.regexp_replace(body, BLANKS, "")).cast("bigint").alias("word_chars"),
        symbols_in(body).cast("bigint").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    n, repeated, left = F.col("__counts.n_words"), F.col("__counts.n_repeat_words"), F.col("__judged.n_kept_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    return out.withColumns({
        "n_words": n,
        "n_repeat_words": repeated,
        "n_kept_words": left,
        "base_failed": failed,
        "kept": ~failed & (100 * left >= (100 - MAX_LOSS_PERCENT) * n),
        "clean_text": F.when(F.col(text).isNotNull(), F.col("__judged.clean_text")),
    }).drop("__counts", "__judged")


def keep_clean(df: DataFrame) -> DataFrame:
    """The stage form: documents that are kept, with the text that is left and its length; further columns of any name pass through."""
    return with_extras_aside(df, _kept_clean)


def _kept_clean(df: DataFrame) -> DataFrame:
    judged = clean_documents(df).where("kept")
    columns = {"text": F.col("clean_text")}
    if "n_chars" in df.columns:
        columns["n_chars"] = F.length("clean_text").cast("bigint")
    return judged.withColumns(columns).select(*df.columns)


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words"
    )


OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid),
lines AS (
  SELECT rid, line, len(regexp_extract_all(line, '{WORD}')) AS words
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
by_line AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup,
         coalesce(sum(words) FILTER (
           regexp_matches(line, '{ENDS.replace("'", "''")}')
           AND len(regexp_replace(line, '[^{SYMBOLS}]+', '', 'g')) * {PER_WORDS} <= words
           AND len(regexp_extract_all(line, '{RUNS}')) * {PER_WORDS} <= words
           AND NOT regexp_matches(line, '{PHRASES}')), 0) AS passing
  FROM lines WHERE words > 0 GROUP BY rid),
counts AS (
  SELECT d.doc_id, len(w) AS n_words, len(regexp_replace(t, '{BLANKS}', '', 'g')) AS word_chars,
         len(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(passing, 0) AS passing
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN by_line USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * passing >= {100 - MAX_LOSS_PERCENT} * n_words AS kept,
       passing::BIGINT AS n_kept_words
FROM counts
"""
