"""Source divergence audit: how far the sources of a language stand apart in the words they use.

Terms are runs of letters and of characters beyond ASCII, with only A-Z lower-cased. What a count vectorizer of each
language gives, with a least number of documents for a term and no limit on the vocabulary, is built where documents are read: a
document's exact sparse vector is added to the sum of its language and source, and its distinct terms to their
document counts. Sums of vectors may be cut to a vocabulary after adding up, so fit, transform and sums are one
pass over the text. A task passes its sums on when they grow large; Spark adds them up by term, where the documents of all
sources of a language decide what is kept. No vocabulary and no dense vector exists anywhere: the vocabulary is a table
that is dealt by term, and what stays are counts by term, language and source, without zeros.

With ``N`` the group's kept occurrences and ``V`` the language's kept terms, ``p = 1 + 10**9 * (count + 1) // (N + V)``
and two groups differ at a term by ``(p - q)**2 // q``. The sum over *all* kept terms needs no zeros written out: for terms
that only one side holds it follows from that side's histogram of counts, for terms that neither holds it is one
product, and only terms that both hold are met in a join, whose rows are added up where they arise. All of it is whole-number
arithmetic; sums stay below ``(10**9 + V)**2``, and counts beyond a long's range are widened.

Null texts, languages and sources read as ''. A group without terms is still audited; a language without kept terms has
value 0 for every pair. Equal rows and rows that share an id count as often as they occur. Only ``text``, ``lang`` and
``source`` are read, so further columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillshard.llm.common import staged, table, text_batches

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
MIN_DOCS = 3
TOP_TERMS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Entries of its sums that a task holds before it passes them on.
_HELD = 400_000
SUMMED = "lang string, source string, term string, count bigint, docs bigint"


def words(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text; ``lower`` of bytes changes A-Z only, and bytes from 0x80 on are the characters beyond ASCII."""
    return _TERM.findall(text.lower()) if text else []


def _sum_batches(batches):
    """Sums of sparse document vectors, and documents that hold a term, by language and source."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on():
        for (lang, source), (counts, holders) in sums.items():
            n = len(counts)
            # both counters met the same terms, but not in the same order
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n),
                 pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()),
                 pa.array([holders[t] for t in counts], pa.int64())],
                names=["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            own = words(text)
            if own:
                counts, holders = sums.setdefault((lang, source), (Counter(), Counter()))
                counts.update(own)
                holders.update(set(own))
        if sum(len(counts) for counts, _ in sums.values()) > _HELD:
            yield from passed_on()
            sums = {}
    yield from passed_on()


def _named(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def group_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``term_id, lang, source, term, count`` for the kept terms; no zeros."""
    text_batches(docs.sparkSession)
    summed = docs.select(*_named(docs), docs["text"].cast("binary").alias("text")).mapInArrow(_sum_batches, SUMMED)
    # one shuffle for both: a term's sums by source, and its documents in all sources
    by_term = summed.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = by_term.withColumns({"holders": F.sum("docs").over(term), "term_id": F.min(F.monotonically_increasing_id()).over(term)})
    return staged(kept.where(F.col("holders") >= min_docs).select("term_id", "lang", "source", "term", "count"), "divergence-counts")


def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + 10**9 * (count + 1) // (n + v)``, null for a language without kept terms."""
    def parts(kind: str) -> Column:
        return F.call_function("div", (count + 1).cast(kind) * F.lit(1_000_000_000).cast(kind), F.nullif(n + v, F.lit(0)).cast(kind))

    return 1 + F.when(count < 9_000_000_000, parts("bigint")).otherwise(parts("decimal(28,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by divergence, and terms a source uses most above its language."""
    counts = group_counts(docs, min_docs)
    kept = counts.groupBy("term_id", "lang").agg(F.sum("count").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("held"))
    groups = docs.select(*_named(docs)).distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0)
    groups = staged(groups.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("n"), F.col("v"))), "divergence-groups")
    held = counts.join(groups.select("lang", "source", "n", "v", "p0"), ["lang", "source"])
    held = staged(held.withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))).drop("n", "v", "count"), "divergence-shares")
    return _pairs(groups, held).unionByName(_terms(kept, held, groups, top_terms))


def _pairs(groups: DataFrame, held: DataFrame) -> DataFrame:
    a = groups.select("lang", "source", "v", F.col("held").alias("held_a"), F.col("p0").alias("pa"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held_b"), F.col("p0").alias("pb"))
    p0_a, p0_b = F.col("pa"), F.col("pb")
    neither = a.join(b, "lang").where(F.col("source") != F.col("item")).select(
        "lang", "source", "item", F.coalesce((F.col("v") - F.col("held_a") - F.col("held_b")) * apart(p0_a, p0_b), F.lit(0)).alias("value"))
    # as if no term were held by both: each side's distinct shares, as often as they occur, against the other's share of nothing
    drawn = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    of_a = drawn.join(b, "lang").where(F.col("source") != F.col("item")).select(
        "lang", "source", "item", (F.col("times") * apart(F.col("p"), p0_b)).alias("value"))
    of_b = drawn.withColumnRenamed("source", "item").join(a, "lang").where(F.col("source") != F.col("item")).select(
        "lang", "source", "item", (F.col("times") * apart(p0_a, F.col("p"))).alias("value"))
    # terms of both: what they are apart, instead of what was taken for them above
    x = held.select("term_id", "lang", F.col("source").alias("x"), F.col("p").alias("px"), F.col("p0").alias("x0"))
    y = held.select("term_id", F.col("source").alias("y"), F.col("p").alias("py"), F.col("p0").alias("y0"))
    both = x.join(y, "term_id").where(F.col("x") < F.col("y"))

    def instead(p: str, q: str, p0: str, q0: str) -> Column:
        p, q, p0, q0 = F.col(p), F.col(q), F.col(p0), F.col(q0)
        return F.sum(apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))

    mended = both.groupBy("lang", "x", "y").agg(instead("px", "py", "x0", "y0").alias("there"), instead("py", "px", "y0", "x0").alias("back"))
    mended = mended.select("lang", F.inline(F.array(
        F.struct(F.col("x").alias("source"), F.col("y").alias("item"), F.col("there").alias("value")),
        F.struct(F.col("y").alias("source"), F.col("x").alias("item"), F.col("back").alias("value")))))
    total = neither.unionByName(of_a).unionByName(of_b).unionByName(mended).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(kept: DataFrame, held: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    spoken = kept.join(of_lang, "lang").select("term_id", share(F.col("total"), F.col("n"), F.col("v")).alias("q"))
    above = held.join(spoken, "term_id").where(F.col("p") > F.col("q")).withColumn("value", apart(F.col("p"), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    ranked = above.withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w
  FROM documents),
spoken AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM spoken GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
occurs AS (SELECT lang, source, term, count(*) AS c FROM spoken JOIN kept USING (lang, term) GROUP BY ALL),
sets AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, sum(c) AS n FROM occurs GROUP BY ALL),
grid AS (
  SELECT s.lang, s.source, k.term, coalesce(o.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 1)) // (coalesce(n.n, 0) + z.v) AS p
  FROM sets s JOIN kept k USING (lang) JOIN sizes z USING (lang)
  LEFT JOIN occurs o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
  LEFT JOIN sums n ON n.lang = s.lang AND n.source = s.source),
whole AS (SELECT lang, term, sum(c) AS c FROM grid GROUP BY ALL),
general AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q
  FROM whole JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sets a JOIN sets b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM grid JOIN general USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
