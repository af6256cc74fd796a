import random
from collections import defaultdict

from quillshard.llm.substring_dedup import UNIT_WORDS, drop_repeats, gear_hashes, op9_gear_chunks, repeated_spans, units_of, GEAR
from tests.llm.helpers import documents, folder_of, odd_rows, prose


def brute_spans(rows):
    """The same rule over one list of units, without Spark."""
    found = defaultdict(set)
    for doc_id, text in {(r[0], r[1]) for r in rows if r[0] is not None and r[1]}:
        d, a, b = units_of(text.encode())
        for digest, start, end in zip(map(tuple, d.tolist()), a.tolist(), b.tolist()):
            found[digest].add((doc_id, text, start, end))
    removed = defaultdict(set)
    for places in found.values():
        if len(places) < 2:
            continue
        keeper = min(p[0] for p in places)
        own = sorted((p for p in places if p[0] == keeper), key=lambda p: p[2])
        texts = {p[1] for p in own}
        assert len(texts) == 1, "the brute-force version takes unique ids"
        stays = own[0]
        for doc_id, text, start, end in places - {stays}:
            if doc_id == keeper:
                start = max(start, stays[3])
            removed[(doc_id, text)].update(range(start, end))
    return removed


def test_gear_hash_rolls_over_sixteen_bytes():
    data = bytes(random.Random(1).randrange(256) for _ in range(200))
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF
        want.append(h)
    assert gear_hashes(data).tolist() == want


def test_against_brute_force(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = [r for r in odd_rows(12, 60) if r[0] != 106]
    rows += [(300 + i, f"{prose(rng, rng.randint(0, 40))} {passage} {prose(rng, rng.randint(0, 40))}", "en", "s", 1) for i in range(12)]
    rows += [(400, "same " * 300, "en", "s", 1), (401, prose(rng, 30) + " " + passage + "\n" + passage, "en", "s", 1)]
    want = brute_spans(rows)
    got = defaultdict(set)
    text_of = {r[0]: r[1] for r in rows}
    for r in repeated_spans(documents(spark, rows)).collect():
        span = set(range(r["start"], r["end"]))
        assert not span & got[(r["doc_id"], text_of[r["doc_id"]])]
        got[(r["doc_id"], text_of[r["doc_id"]])] |= span
    assert dict(got) == {k: v for k, v in want.items() if v}
    # the passage is cut from every document but the first, to within a few words at its ends
    for i in range(1, 12):
        assert len(got[(300 + i, text_of[300 + i])]) >= 35


def test_passages_resist_shifts():
    rng = random.Random(13)
    missed = 0
    for _ in range(300):
        passage = prose(rng, 51)
        a, b = (f"{prose(rng, rng.randint(3, 60))} {passage} {prose(rng, rng.randint(3, 60))}" for _ in range(2))
        missed += not {*map(tuple, units_of(a.encode())[0].tolist())} & {*map(tuple, units_of(b.encode())[0].tolist())}
    assert missed <= 3


def test_text_after_the_cut(spark):
    rng = random.Random(14)
    first, copy, other = prose(rng, 120), None, prose(rng, 90)
    copy = first
    rows = [(1, first, "en", "a", 1), (2, copy, "de", "b", 2), (3, other, "en", "a", 3), (4, None, None, None, None),
            (5, "", "en", "a", 0), (None, first, "en", "a", 1), (6, f"{other}\n\n{prose(rng, 40)}", "en", "a", 1)]
    docs = documents(spark, rows)
    out = {r["doc_id"]: r for r in drop_repeats(docs).collect()}
    assert set(out) == {1, 3, 4, 5, None, 6}
    assert out[1]["text"] == first and out[3]["text"] == other and out[None]["text"] == first
    assert len(out[6]["text"].split()) < 40 + UNIT_WORDS and out[6]["n_chars"] == len(out[6]["text"])
    assert drop_repeats(docs).columns == docs.columns


def test_repeated_rows_and_ids(spark):
    rng = random.Random(15)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a + " " + b, "en", "s", 1)]
    out = sorted((r["doc_id"], len(r["text"].split())) for r in drop_repeats(documents(spark, rows)).collect())
    assert out[:2] == [(1, 100), (1, 100)] and len(out) == 3 or len(out) == 4
    clash = documents(spark, rows).selectExpr("*", "1 AS start", "2 AS tie", "3 AS d1", "4 AS kept_doc_id")
    assert drop_repeats(clash).columns == clash.columns


def test_clean_and_empty(spark, folder):
    rng = random.Random(16)
    clean = documents(spark, [(i, prose(rng, 150), "en", "s", 1) for i in range(50)])
    assert repeated_spans(clean).count() == 0
    assert drop_repeats(documents(spark, [])).count() == 0
    assert op9_gear_chunks(spark, folder_of(documents(spark, odd_rows(17)), folder)).where("doc_id = 105").count() == 1
