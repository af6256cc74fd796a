"""URL filter: longest-match rules first, host word segmentation and naive Bayes for the rest.

Host and path are cut from the url, and the longest rule that fits decides. Urls without a rule are judged
by their words. Host labels are runs of letters; a concatenated run (``cheappills``) is split by a unigram Viterbi:
the split with the largest product of word probabilities, where word counts come from the visible text of all
pages and a word never seen costs ``10 / (total * 10 ** length)``. Path words are its letter runs, and a
digit run counts as its length. A multinomial naive Bayes with add-one smoothing over host and path words is
learned from all urls that a rule decided, and blocks a url if block is the likelier class.

Counts are aggregates that combine before their shuffle. The substrings of the *distinct* runs meet the word counts in
an equi-join, so no vocabulary is capped or broadcast unless it was counted as small; the splits are found per run, word
weights join exploded words, and a host that a third of the pages share is split once.

A null url or one without ``://`` has an empty host and path, no rule, and is judged by the class sizes alone. A null
html gives no words. Rows are judged one by one, so repeated rows and null ids are fine. With no page that a rule
decides every url is allowed. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.llm.common import sized, staged, table

# Words up to this length meet the runs by equality; longer ones by their first letters, this many, and are then compared.
SHORT_WORD = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. For rule lists of a size to be read by people."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def word_counts(html: DataFrame) -> DataFrame:
    """``word, n`` over the text between the tags of all pages."""
    visible = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    words = html.select(F.explode(F.regexp_extract_all(visible, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest split; ``known`` has the counts of words by (start, end), ties go to the longer last word.

    What an unknown word costs is linear in its length, so of all unknown words that end somewhere the best one begins at the same
    place as the best one that ends a letter earlier, or at that letter: one candidate for each end, whatever the length.
    """
    ends: dict[int, list[tuple[int, int]]] = {}
    for (start, end), n in known.items():
        ends.setdefault(end, []).append((start, n))
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    unseen, letter = math.log(10.0 / max(total, 1)), math.log(10.0)
    opening = 0
    for end in range(1, len(name) + 1):
        if best[end - 1] + (end - 1) * letter > best[opening] + opening * letter:
            opening = end - 1
        found = [(best[opening] + (unseen - (end - opening) * letter), opening)]
        found += [(best[start] + math.log(n / total), start) for start, n in ends.get(end, [])]
        best[end], back[end] = max(found, key=lambda x: (x[0], -x[1]))
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def _splitter(total: int):
    def split(batches):
        for batch in batches:
            words = []
            for name, pieces in zip(batch.column("name").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                known = {(p["start"], p["start"] + len(p["word"])): p["n"] for p in pieces}
                words.append(split_name(name, known, total))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return split


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` for distinct letter runs."""
    counts = staged(counts, "url-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = names.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("name") - 1)))
    pieces = starts.select("name", "start", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(SHORT_WORD), F.length("name") - F.col("start")))).alias("size"))
    pieces = pieces.select("name", "start", F.col("name").substr(F.col("start") + 1, F.col("size")).alias("word"))
    short = pieces.join(counts, "word").select("name", "start", "word", "n")
    # every longer word, however long, begins with a piece of the longest size
    long_words = counts.where(F.length("word") > SHORT_WORD).withColumn("opening", F.substring("word", 1, SHORT_WORD))
    opened = pieces.where(F.length("word") == SHORT_WORD).withColumnRenamed("word", "opening").join(long_words, "opening")
    here = F.col("name").substr(F.col("start") + 1, F.length("word")) == F.col("word")
    known = short.unionByName(opened.where(here).select("name", "start", "word", "n")).groupBy("name").agg(F.collect_list(F.struct("start", "word", "n")).alias("pieces"))
    empty = F.array().cast("array<struct<start:int,word:string,n:bigint>>")
    full = names.join(known, "name", "left").select("name", F.coalesce("pieces", empty).alias("pieces"))
    return full.mapInArrow(_splitter(total), "name string, words array<string>")


def path_words(path: Column) -> Column:
    runs = F.regexp_extract_all(F.lower(path), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(runs, lambda x: F.concat(F.lit("path "), F.when(
        x.rlike("^[0-9]"), F.concat(F.lit("digits "), F.length(x).cast("string"))).otherwise(x)))


def host_tokens(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``host, tokens`` per distinct host: its segmented words and its digit runs as lengths."""
    hosts = parts.select("host").where(F.col("host") != "").distinct()
    runs = staged(hosts.select("host", F.posexplode(
        F.regexp_extract_all("host", F.lit("[a-z]+|[0-9]+"), F.lit(0))).alias("at", "name")), "url-runs")
    letters = runs.where(F.col("name").rlike("^[a-z]"))
    split = staged(segment(letters.select("name").distinct(), counts), "url-split")
    words = letters.join(sized(split, split.count()), "name").select("host", "at", "words")
    digits = runs.where(~F.col("name").rlike("^[a-z]")).select(
        "host", "at", F.array(F.concat(F.lit("digits "), F.length("name").cast("string"))).alias("words"))
    listed = words.union(digits).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("runs"))
    return listed.select("host", F.transform(
        F.flatten(F.transform("runs", lambda r: r["words"])), lambda w: F.concat(F.lit("host "), w)).alias("host_tokens"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds, tokens`` per row of ``page_id, url, html``."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = longest_rule(F.col("host"), F.col("path"), rules)
    parts = staged(cut.withColumn("found", found).select(
        F.monotonically_increasing_id().alias("row"), "page_id", "host", "path",
        F.col("found.rule").alias("rule"), F.col("found.verdict").alias("decided")), "url-parts")
    hosts = staged(host_tokens(parts, word_counts(pages.select("html"))), "url-hosts")
    # at most BROADCAST_ROWS short rows are broadcast; beyond, the join on a frequent host is Spark's to split
    both = parts.join(sized(hosts, hosts.count()), "host", "left")
    tokens = F.concat(F.coalesce("host_tokens", F.array().cast("array<string>")), path_words(F.col("path")))
    tokened = staged(both.withColumn("tokens", tokens).drop("host_tokens"), "url-tokens")
    blocks, allows = F.col("decided") == "block", F.col("decided") == "allow"
    classes = tokened.agg(F.count_if(blocks).alias("b"), F.count_if(allows).alias("a")).first()
    counted = staged(
        tokened.where(F.col("decided").isNotNull()).select("decided", F.explode("tokens").alias("token")).groupBy("token").agg(
            F.count_if(blocks).alias("b"), F.count_if(allows).alias("a")), "url-model")
    sums = counted.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count("*").alias("v")).first()
    weight = F.log((F.col("b") + 1.0) / (sums["b"] + sums["v"])) - F.log((F.col("a") + 1.0) / (sums["a"] + sums["v"]))
    weights = counted.select("token", weight.alias("weight"))
    open_rows = tokened.where(F.col("decided").isNull()).select("row", F.explode("tokens").alias("token"))
    scores = open_rows.join(sized(weights, sums["v"]), "token").groupBy("row").agg(F.sum("weight").alias("words"))
    prior = math.log((classes["b"] + 1) / (classes["a"] + 1))
    odds = F.round(F.lit(prior) + F.coalesce("words", F.lit(0.0)), 9)
    judged = tokened.join(scores, "row", "left").withColumn("log_odds", F.when(F.col("decided").isNull(), odds))
    says = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("decided", says).alias("verdict"), "log_odds", "tokens")


def op10_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{x.verdict}', '{x.host}', '{x.path}')" for x in RULES)}),
ruled AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS decided
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g')), '[a-z]+')) AS word FROM pages)
  GROUP BY word),
total AS (SELECT greatest(coalesce(sum(n), 0), 1)::DOUBLE AS t FROM words),
runs AS (
  SELECT host, unnest(range(1, len(list) + 1)) AS at, unnest(list) AS name
  FROM (SELECT host, regexp_extract_all(host, '[a-z]+|[0-9]+') AS list FROM (SELECT DISTINCT host FROM parts))),
names AS (SELECT DISTINCT name FROM runs WHERE name >= 'a'),
starts AS (SELECT name, unnest(range(0, length(name))) AS s FROM names),
pieces AS (SELECT name, substr(name, s + 1, l) AS word FROM (SELECT name, s, unnest(range(1, length(name) - s + 1)) AS l FROM starts)),
known AS (SELECT name, map(list(word), list(n)) AS m FROM (SELECT DISTINCT name, word, n FROM pieces JOIN words USING (word)) GROUP BY name),
best AS (
  SELECT name, m, 0 AS pos, [0.0::DOUBLE] AS scores, [0] AS backs FROM names LEFT JOIN known USING (name)
  UNION ALL
  SELECT name, m, pos + 1, list_append(scores, list_max(c)), list_append(backs, (list_position(c, list_max(c)) - 1)::INTEGER)
  FROM (
    SELECT best.*, list_transform(range(0, pos + 1), lambda s: scores[s + 1]
      + coalesce(ln(m[substr(name, s + 1, pos + 1 - s)] / t), ln(10.0 / t) - (pos + 1 - s) * ln(10.0))) AS c
    FROM best, total WHERE pos < length(name))),
back AS (
  SELECT name, backs, pos AS stop, []::VARCHAR[] AS split FROM best WHERE pos = length(name)
  UNION ALL
  SELECT name, backs, backs[stop + 1], list_prepend(substr(name, backs[stop + 1] + 1, stop - backs[stop + 1]), split)
  FROM back WHERE stop > 0),
host_words AS (
  SELECT host, unnest(split) AS word FROM runs JOIN back ON back.name = runs.name AND back.stop = 0
  UNION ALL SELECT host, 'digits ' || length(name) FROM runs WHERE name < 'a'),
tokens AS (
  SELECT r, 'host ' || word AS token FROM parts JOIN host_words USING (host)
  UNION ALL
  SELECT r, 'path ' || CASE WHEN x < 'a' THEN 'digits ' || length(x) ELSE x END
  FROM (SELECT r, unnest(regexp_extract_all(lower(path), '[a-z]+|[0-9]+')) AS x FROM parts)),
model AS (
  SELECT token, count(*) FILTER (decided = 'block') AS b, count(*) FILTER (decided = 'allow') AS a
  FROM tokens JOIN ruled USING (r) GROUP BY token),
sums AS (SELECT coalesce(sum(b), 0) + count(*) AS b, coalesce(sum(a), 0) + count(*) AS a FROM model),
classes AS (SELECT count(*) FILTER (decided = 'block') + 1.0 AS b, count(*) FILTER (decided = 'allow') + 1.0 AS a FROM ruled),
odds AS (
  SELECT r, sum(ln((model.b + 1.0) / sums.b) - ln((model.a + 1.0) / sums.a)) AS w
  FROM tokens JOIN model USING (token), sums GROUP BY r)
SELECT page_id, host, path, rule,
       coalesce(decided, CASE WHEN round(ln(classes.b / classes.a) + coalesce(w, 0), 9) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN ruled USING (r) LEFT JOIN odds USING (r), classes
"""
