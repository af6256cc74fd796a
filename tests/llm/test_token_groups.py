import random
import re

import numpy as np
import pytest

from quillshard.llm import token_groups as g
from tests.llm.helpers import documents, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= 90 * len(a | b):
                root[find(a)] = find(b)
    smallest = {}
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            smallest[find(s)] = min(r[0], smallest.get(find(s), r[0]))
    return [(r[0], len(s), r[0] if not s or r[0] is None else smallest[find(s)]) for r, s in zip(rows, sets)]


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def family_rows(seed):
    rng = random.Random(seed)
    rows, at, shared = odd_rows(seed, 30), 1000, prose(rng, 60)
    for _ in range(10):
        base = prose(rng, rng.randint(8, 160))
        texts = [base, *(edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(2, 12))), f"{prose(rng, 50)} {shared} {prose(rng, 20)}"]
        # prefixes and extensions just above and below the threshold
        texts += [" ".join(base.split()[: -k]) for k in (1, 3, 9) if len(base.split()) > k]
        for text in texts:
            rows.append((at, text, "en", "s", 1))
            at += 1
    base = prose(rng, 200)
    for _ in range(60):
        rows.append((at, edited(rng, base, rng.randint(0, 9)), "en", "s", 1))
        at += 1
    chain = prose(rng, 300).split()
    for i in range(25):
        rows.append((at, " ".join(chain[i * 4 : i * 4 + 100]), "en", "s", 1))
        at += 1
    return rows


@pytest.mark.parametrize("rounds, members", [(3, 32), (1, 2)])
def test_components_equal_brute_force(spark, monkeypatch, rounds, members):
    # with pairs for groups and a single round, nearly all links come through the matrix
    monkeypatch.setattr(g, "ROUNDS", rounds)
    monkeypatch.setattr(g, "GROUP_ROWS", members)
    rows = family_rows(31)
    docs = documents(spark, rows).selectExpr("*", "1 AS node", "2 AS tie", "3 AS component_id", "4 AS cluster").repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in g.similar_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_prefixes_hold_what_partners_share():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        base = rng.choice(10**6, n + 12, replace=False)
        a, b = (np.unique(base[: n + int(k)]) for k in rng.integers(0, 12, 2))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * len(np.union1d(a, b)):
            pa, pb = a[: g.prefix_length(len(a))], b[: g.prefix_length(len(b))]
            assert len(np.intersect1d(pa, pb)) >= min(g.agreed(len(a)), g.agreed(len(b)))
            short = [len(p) - len(s) for p, s in ((pa, a), (pb, b))]
            assert len(np.intersect1d(pa, pb)) >= common + min(short)


def test_members_of_a_group_are_tied_by_exact_similarity():
    sets = [np.arange(a, a + n, dtype=np.int64) for a, n in ((0, 100), (5, 100), (10, 100), (500, 9), (500, 10), (0, 90), (70_000, 200_000), (70_001, 200_000))]
    assert g.tied_members(sets) == [0, 0, 0, 3, 3, 0, 6, 6]


def test_columns_of_a_family_meet_by_each_shingle_once(spark):
    # 60 members in three columns, all with the same shingles, and a class of its own
    rows = [(k, k // 20, 2, list(range(10))) for k in range(60)] + [(99, 9, 1, [50, 51])]
    asking = spark.createDataFrame(rows, "node bigint, cluster bigint, need bigint, tokens array<bigint>")
    held = asking.selectExpr("cluster", "tokens AS union").distinct()
    met = g._met(asking, held).collect()
    pairs = {(r["asker"], r["cluster"]): sorted(r["met"]) for r in met}
    assert pairs == {(a, b): list(range(9)) for a in range(3) for b in range(3)} | {(9, 9): [50, 51]}
    assert sum(len(r["met"]) for r in met) == 9 * 9 + 2


def linked(a, b):
    return 100 * len(a & b) >= 90 * len(a | b)


def named(sets, pairs):
    """The components of sets under pairs of their places."""
    first = list(range(len(sets)))
    for a, b in pairs:
        low, high = sorted((first[a], first[b]))
        first = [low if f == high else f for f in first]
    return first


def test_a_family_opens_few_pairs(spark, monkeypatch):
    # copies of one text with one to five words changed: most pairs share nearly all and still miss the threshold
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(10**4)}" for _ in range(150))
    texts = [edited(rng, base, 1 + k % 5) for k in range(200)]
    rows = [(k, text, "en", "s", 1) for k, text in enumerate(texts)]
    opened, confirmed = [], g._confirmed
    monkeypatch.setattr(g, "_confirmed", lambda pairs, sets: opened.append(pairs.count()) or confirmed(pairs, sets))
    # shorter copies, so that what is changed occurs twice and reach rules no class out
    rows += [(1000 + k, " ".join(text.split()[:120]), "en", "s", 1) for k, text in enumerate(texts)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in g.similar_documents(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert opened[0] <= 20 * len(rows)


def test_classes_of_a_centre_are_linked_by_what_they_differ_in(spark):
    rng = random.Random(8)
    for size, fresh, most in ((60, 20, 8), (40, 400, 6)):
        centre = set(range(size))
        sets = []
        for _ in range(90):
            left = centre - set(rng.sample(range(size), rng.randint(0, most)))
            sets.append(frozenset(left | {size + rng.randrange(fresh) for _ in range(rng.randint(0, most))}))
        sets = list(dict.fromkeys(sets))
        comps = named(sets, [(a, b) for a in range(9) for b in range(a) if linked(sets[a], sets[b])])
        rows = [(k, comps[k], len(s), "c", size, len(s & centre), sorted(s ^ centre)) for k, s in enumerate(sets)]
        family = spark.createDataFrame(rows, "node bigint, comp bigint, n bigint, centre string, core bigint, held bigint, apart array<bigint>")
        pairs = [(r["a"], r["b"]) for r in g._one_centre(family).collect()]
        assert len(set(pairs)) == len(pairs) and all(comps[a] != comps[b] for a, b in pairs)
        every = [(a, b) for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b])]
        known = [(k, c) for k, c in enumerate(comps)]
        assert named(sets, known + [(a, b) for a, b in pairs if linked(sets[a], sets[b])]) == named(sets, every)
        assert 0 < len(pairs) < len(sets) * (len(sets) - 1) // 2


def test_a_class_against_the_centre_that_takes_its_own_place(spark):
    shape, other = list(range(100)), list(range(3, 103))
    rows = [(k, "c", 100, 99, [5, 500 + k], shape if k == 0 else None) for k in range(20)]
    rows += [(k, "d", 100, 98, [50, 60, 700, 701], other if k == 30 else None) for k in range(30, 33)]
    rows += [(40, "e", 10, 9, [4000, 900], list(range(4000, 4010))), (41, None, 0, None, None, None)]
    told = spark.createDataFrame(rows, "node bigint, centre string, core bigint, held bigint, apart array<bigint>, shape array<bigint>")
    got = {r["node"]: (r["centre"], r["core"], r["held"], sorted(r["apart"])) for r in g._centred(told).collect()}
    assert got[4] == ("c", 100, 99, [5, 504]) and got[40] == ("e", 10, 9, [900, 4000]) and 41 not in got
    member = (set(other) - {50, 60}) | {700, 701}
    assert got[31] == ("c", 100, len(member & set(shape)), sorted(member ^ set(shape)))


def test_empty(spark):
    assert g.similar_documents(documents(spark, [])).count() == 0
    assert [r["component_id"] for r in g.similar_documents(documents(spark, [(1, None, None, None, None)])).collect()] == [1]
