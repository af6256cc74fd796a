import itertools
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from quillshard.llm.url_filter import OP10_SQL, RULES, judge, op10_url_words, split_name
from tests.conftest import SF_SMALL


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def best_split(name, counts, total):
    best = None
    for bars in itertools.product([0, 1], repeat=len(name) - 1):
        words, at = [], 0
        for i, bar in enumerate(bars, 1):
            if bar:
                words.append(name[at:i])
                at = i
        words.append(name[at:])
        p = sum(math.log(counts[w] / total) if counts.get(w) else math.log(10 / total) - len(w) * math.log(10) for w in words)
        if best is None or p > best + 1e-12:
            best = p
    return best


def brute(rows):
    counts = Counter()
    for _, _, html in rows:
        counts.update(w for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").lower()))
    total = sum(counts.values())

    def words(name):
        known = {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}
        return split_name(name, known, total)

    pages = []
    for page_id, url, _ in rows:
        host, path = cut(url)
        tokens = []
        for run in re.findall("[a-z]+|[0-9]+", host):
            tokens += ["host " + w for w in (words(run) if run[0].isalpha() else [f"digits {len(run)}"])]
        tokens += ["path " + (r if r[0].isalpha() else f"digits {len(r)}") for r in re.findall("[a-z]+|[0-9]+", path.lower())]
        pages.append((page_id, host, path, rule_of(host, path), tokens))
    seen = {"block": Counter(), "allow": Counter()}
    n = Counter()
    for *_, rule, tokens in pages:
        if rule:
            seen[rule.verdict].update(tokens)
            n[rule.verdict] += 1
    vocabulary = set(seen["block"]) | set(seen["allow"])
    size = {k: sum(c.values()) + len(vocabulary) for k, c in seen.items()}
    out = []
    for page_id, host, path, rule, tokens in pages:
        odds = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(
            math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"]) for t in tokens if t in vocabulary)
        verdict = rule.verdict if rule else "block" if odds > 1e-9 else "allow"
        out.append((page_id, host, path, rule.text if rule else None, verdict, tuple(tokens)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], tuple(r["tokens"])) for r in judge(df).collect()]
    return sorted(got, key=repr)


LONG_WORD = "incomprehensibilitiesxyzab"
ODD = [
    (1, None, None), (2, "", ""), (3, "no scheme", "<p>cheap pills</p>"), (4, "http://", "<b>free</b> bets"),
    (5, "HTTP://A.NET", "x"), (6, "http://a.net/", "x"), (7, "http://example.net/en/a?b#c", "x"), (8, "http://xexample.net/en/", "x"),
    (9, "http://m.Example.com/de/1", "x"), (10, "https://x.org/fr/", "x"), (11, "https://x.org?fr/", "x"), (12, "a://b://c/d", "x"),
    (13, "https://cheappills.example.com/en/12", "cheap cheap pills win casino casino"), (13, "https://cheappills.example.com/en/12", "x"),
    (None, "http://casino7win.biz/x-y/99", None), (14, "http://" + "q" * 300 + ".com/" + "z/" * 500, "x"), (15, "http://net/", "x"),
    (19, "http://" + LONG_WORD + "shop.example.com/en/", f"<p>{LONG_WORD} {LONG_WORD} shop {LONG_WORD}{LONG_WORD}{'z' * 300}</p>"),
    (20, "http://best" + LONG_WORD + "s" + LONG_WORD * 2 + "z" * 300 + ".org/", "best"),
    (16, "http://a.org/fr", "x"), (17, "http://user@a.net:80/en/", "x"), (18, "http://\u00e9t\u00e9.com/\u00c9n\n", "x"),
]


def test_odd_urls(spark, folder):
    want = brute(ODD)
    assert run(spark, ODD) == want
    spark.createDataFrame(ODD, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    assert sorted(con.execute(OP10_SQL).fetchall(), key=repr) == sorted((r[:5] for r in want), key=repr)


def test_long_words_are_words(spark):
    tokens = {r[0]: r[5] for r in run(spark, ODD)}
    assert tokens[19][:2] == (f"host {LONG_WORD}", "host shop")
    assert tokens[20][1] == f"host {LONG_WORD}" and f"host {LONG_WORD}{LONG_WORD}{'z' * 300}" in tokens[20]


def test_more_urls_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = "cheap pills free bets blog news casino win garden".split()
    rows = []
    for i in range(250):
        host = ".".join(["".join(rng.choices(vocabulary, k=rng.randint(1, 3))), "example", rng.choice(["net", "com", "org"])])
        path = f"/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(vocabulary)}/{rng.randrange(10**rng.randint(1, 5))}"
        rows.append((i, f"http://{host}{path}", "<p class='x'>" + " ".join(rng.choices(vocabulary, k=20)) + "</p>"))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("name", ["cheappills", "aab", "thethe", "xyz"])
def test_split_is_the_likeliest(name):
    counts = {"cheap": 5, "pills": 4, "a": 3, "ab": 2, "the": 9, "het": 1, "pill": 2, "s": 7}
    known = {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}
    total = sum(counts.values())
    words = split_name(name, known, total)
    p = sum(math.log(counts[w] / total) if counts.get(w) else math.log(10 / total) - len(w) * math.log(10) for w in words)
    assert "".join(words) == name and p == pytest.approx(best_split(name, counts, total))


def test_registered_query_and_empty(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = sorted((tuple(r) for r in op10_url_words(spark, SF_SMALL).collect()), key=repr)
    assert got == sorted((r[:5] for r in brute(rows)), key=repr)
    assert run(spark, []) == []
