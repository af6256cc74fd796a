import random
from collections import defaultdict

from quillshard.llm.packing import best_fit, op8_best_fit_packing, pack, packed_texts
from tests.llm.helpers import documents, folder_of, odd_rows


def brute_best_fit(items, capacity):
    bins, placed = [], []
    for length, source, cluster in items:
        fits = [
            (b["room"], i) for i, b in enumerate(bins)
            if b["room"] >= length and not b["s"] & source and not b["c"] & cluster
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "s": 0, "c": 0})
        placed.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= length
        bins[i]["s"] |= source
        bins[i]["c"] |= cluster
    return placed


def test_search_finds_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(60):
        items = sorted(
            ((rng.randint(0, 60), 1 << rng.randint(0, 4), 1 << rng.randint(0, 9)) for _ in range(rng.randint(1, 120))),
            reverse=True)
        assert best_fit(items, 60) == brute_best_fit(items, 60)


def test_invariants_and_whole_words(spark):
    rows = odd_rows(5, 150)
    docs = documents(spark, rows)
    out = [r.asDict() for r in pack(docs, capacity=100, group_rows=32).collect()]
    bins = defaultdict(list)
    words = defaultdict(int)
    for r in out:
        bins[r["pack_id"]].append(r)
        words[r["doc_id"]] += r["n_words"]
    for own in bins.values():
        assert sum(r["n_words"] for r in own) <= 100
        at = sorted((r["bin_start"], r["n_words"]) for r in own)
        assert all(a + n <= b for (a, n), (b, _) in zip(at, at[1:]))
        for column in ("source", "cluster"):
            given = [r[column] for r in own if r[column] is not None]
            assert len(given) == len(set(given))
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += len((r[1] or "").split())
    assert words == want


def test_texts_of_sequences(spark):
    docs = documents(spark, [(1, "a b c d e", "en", "x", 1), (2, "f g", "en", "y", 1), (3, None, "en", "z", 1)])
    placed = pack(docs, capacity=4)
    texts = sorted((r["n_words"], r["text"]) for r in packed_texts(docs, placed).collect())
    assert texts in ([(3, "f g e"), (4, "a b c d")], [(1, "e"), (2, "f g"), (4, "a b c d")])


def test_columns_that_clash_and_a_given_cluster(spark):
    docs = documents(spark, odd_rows(6, 20)).selectExpr("*", "'c' AS cluster", "1 AS bin", "2 AS piece", "3 AS n")
    out = pack(docs, cluster="cluster").groupBy("pack_id").count().collect()
    assert all(r["count"] == 1 for r in out)
    assert pack(documents(spark, [])).count() == 0


def test_registered_query_keeps_every_document(spark, folder):
    sf = folder_of(documents(spark, odd_rows(7)), folder)
    assert op8_best_fit_packing(spark, sf).where("piece = 0").count() == len(odd_rows(7))


def test_sources_may_share_a_sequence_if_asked(spark):
    docs = documents(spark, [(i, f"a{i} b{i} c{i}", "en", "same", 1) for i in range(9)])
    alone, shared = (pack(docs, capacity=9, spread_sources=s).select("pack_id").distinct().count() for s in (True, False))
    assert (alone, shared) == (9, 3)


def test_a_row_repeated_without_end_fills_all_groups_alike(spark, monkeypatch):
    from quillshard.llm import packing

    same = spark.range(200_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'en' AS lang", "'hot' AS source", "5L AS n_chars")
    placed = packing.pack(same, spread_sources=False)
    groups = placed.selectExpr("shiftright(pack_id, 24) AS g").groupBy("g").count().collect()
    assert sum(r["count"] for r in groups) == 200_000
    assert max(r["count"] for r in groups) <= 2 * packing.GROUP_ROWS
    assert placed.select("pack_id").distinct().count() == 200_000
