import random
import shutil
import zlib
from collections import Counter, defaultdict

from quillshard.llm.resharding import min_cost_flow, op6_flow_resharding, plan_runs, read_resharded, reshard, with_slots, write_sharded
from tests.llm.helpers import documents, folder_of, odd_rows


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(40):
        supply = [rng.randint(0, 100) for _ in range(rng.randint(1, 7))]
        m = rng.randint(1, 9)
        share, more = divmod(sum(supply), m)
        capacity = [share + (j < more) for j in range(m)]
        flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert all(sum(u for (i, _), u in flow.items() if i == k) == s for k, s in enumerate(supply))
        assert all(sum(u for (_, j), u in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        stay = sum(min(s, c) for s, c in zip(supply, capacity))
        assert sum(u for (i, j), u in flow.items() if i != j) == sum(supply) - stay


def test_flow_respects_costs():
    cost = [[4, 1, 9], [1, 2, 9]]
    assert min_cost_flow([5, 5], [5, 5, 5], lambda i, j: cost[i][j]) == {(0, 1): 5, (1, 0): 5}
    assert min_cost_flow([5, 5], [5, 0, 5], lambda i, j: [[0, 0, 1], [0, 0, 3]][i][j]) == {(0, 2): 5, (1, 0): 5}


def test_runs_cover_each_shard():
    for run_list in (plan_runs([10, 20, 0, 5], [9, 9, 9, 8]), plan_runs([], [0, 0])):
        at = defaultdict(int)
        for r in run_list:
            assert r.start == at[r.shard]
            at[r.shard] = r.end


def test_contract(spark, folder):
    rows = odd_rows(8, 900)
    sf = folder_of(documents(spark, rows), folder)
    out = [r.asDict() for r in op6_flow_resharding(spark, sf).collect()]
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    usual = sum(sizes.values()) / 24
    biggest = max(r["size"] for r in out)
    assert all(abs(sizes[s] - usual) <= 3 * biggest for s in range(24))


def test_rows_that_stay_keep_their_shard_and_nothing_is_lost(spark, folder):
    docs = documents(spark, odd_rows(9, 400)).selectExpr("*", "1 AS slot_", "'m' AS extra")
    old = write_sharded(docs, f"{folder}/old", 4)
    new = with_slots(reshard(old, f"{folder}/moved", 6))
    rows = new.collect()
    assert len(rows) == docs.count()
    assert all((r["shard"] != r["old_shard"]) == r["moved"] for r in rows)
    size = sum(r["__size"] for r in rows)
    moved = sum(r["__size"] for r in rows if r["moved"])
    biggest = max(r["__size"] for r in rows)
    assert moved <= size / 3 + 12 * biggest
    assert spark.read.parquet(f"{folder}/moved").count() == sum(r["moved"] for r in rows)


def brute_force_shards(rows, n_new):
    """New shard of each (doc_id, tie), from the plan of runs and the blocks in their order."""
    blocks = defaultdict(list)
    for r in rows:
        blocks[r["shard"], r["block"]].append(r)
    totals = Counter()
    for r in rows:
        totals[r["shard"]] += r["__size"]
    old = [totals[i] for i in range(max(totals) + 1)]
    share, more = divmod(sum(old), n_new)
    runs = plan_runs(old, [share + (j < more) for j in range(n_new)])

    def at(shard, byte):
        return next(r.to for r in runs if r.shard == shard and r.start <= byte < r.end)

    want, begin, crossed = Counter(), Counter(), set()
    for (shard, block), members in sorted(blocks.items()):
        start = begin[shard]
        size = sum(r["__size"] for r in members)
        begin[shard] += size
        whole = at(shard, start) if at(shard, start) == at(shard, start + size - 1) else None
        if whole is None:
            crossed.add((shard, block))
        for r in sorted(members, key=lambda r: (r["__tie"], r["doc_id"])):
            want[r["doc_id"], r["__tie"], at(shard, start + r["__size"] // 2) if whole is None else whole] += 1
            start += r["__size"]
    return want, crossed


def test_placement_equals_brute_force_and_only_kept_blocks_are_read_again(spark, folder):
    docs = documents(spark, [(i, "w" * (i % 97), "en", "s", None) for i in range(600)])
    old = write_sharded(docs, f"{folder}/old", 4)
    before = [r.asDict() for r in old.select("doc_id", "shard", "block", "__size", "__tie").collect()]
    want, crossed = brute_force_shards(before, 6)
    new = reshard(old, f"{folder}/moved", 6)
    rows = [r.asDict() for r in new.collect()]
    assert Counter((r["doc_id"], r["__tie"], r["shard"]) for r in rows) == want and crossed
    kept = {(r.shard, r.block) for r in spark.read.parquet(f"{folder}/moved-kept").collect()}
    assert kept and not kept & crossed
    for shard, block in kept:
        shutil.copytree(f"{folder}/old/shard={shard}/block={block}", f"{folder}/left/shard={shard}/block={block}")
    left = spark.read.schema(old.schema).parquet(f"{folder}/left")
    again = read_resharded(left, f"{folder}/moved").select(*new.columns)
    assert Counter(map(str, (r.asDict() for r in again.collect()))) == Counter(map(str, rows))


def test_columns_with_reserved_names_keep_their_values(spark, folder):
    extra = ("Shard", "block", "old_shard", "moved", "slot", "__size", "__tie", "__to", "__first", "original_Shard")
    docs = documents(spark, odd_rows(5, 60)).selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in extra])
    new = with_slots(reshard(write_sharded(docs, f"{folder}/old", 3), f"{folder}/moved", 2))
    names = {c: f"original_{c}" for c in extra} | {"Shard": "original_original_Shard", "original_Shard": "original_Shard"}
    for r in new.collect():
        assert all(r[into] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c, into in names.items())
    assert new.count() == docs.count()


def test_empty(spark, folder):
    sf = folder_of(documents(spark, []), folder)
    assert op6_flow_resharding(spark, sf).count() == 0
