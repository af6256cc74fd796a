"""Positions, hot groups and limits against brute force, with parts and slices forced to be small."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillshard.operators import groups, limits, positions, splits
from tests.conftest import SF_SMALL, plan_of


def positioned(df, layout):
    return {tuple(r)[:-1]: r["position"] for r in positions.with_position(df, layout).collect()}


@pytest.mark.parametrize("rows_per_part", [7, 50, 1_000_000])
@pytest.mark.parametrize("parts", [1, 5])
def test_range_position_composite_key(spark, rows_per_part, parts):
    rng = random.Random(1)
    keys = {(rng.choice(["a", "b", "ccc"]), rng.randrange(10**6)) for _ in range(500)}
    keys |= {("hot", i) for i in range(400)}
    df = spark.createDataFrame(sorted(keys, key=lambda _: rng.random()), "g string, i int").repartition(parts)
    got = positioned(df, positions.range_layout(df, ["g", "i"], rows_per_part))
    assert got == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize(
    "kind, values",
    [
        ("bigint", [(-1) ** i * i**5 for i in range(200)]),
        ("double", [i / 7 for i in range(-100, 100)]),
        ("string", [f"k{i}é" for i in range(200)]),
        ("timestamp_ntz", [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=i * 333) for i in range(200)]),
        ("date", [dt.date(2000, 1, 1) + dt.timedelta(days=3 * i) for i in range(200)]),
        ("decimal(20,3)", None),
    ],
)
def test_range_position_types(spark, kind, values):
    if values is None:
        df = spark.range(200).select((F.col("id") / 8).cast(kind).alias("k"))
        values = [r.k for r in df.collect()]
    else:
        df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    got = positioned(df.repartition(4), positions.range_layout(df, ["k"], 20))
    assert got == {(k,): i for i, k in enumerate(sorted(values))}


@pytest.mark.parametrize("rows_per_part", [9, 1_000_000])
def test_shuffled_position(spark, rows_per_part):
    import hashlib

    df = spark.range(777).withColumnRenamed("id", "k")
    got = positioned(df, positions.shuffled_layout(df, ["k"], 5, rows_per_part))
    order = sorted(range(777), key=lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest())
    assert got == {(k,): i for i, k in enumerate(order)}


def test_position_of_an_empty_table(spark):
    df = spark.range(0).withColumnRenamed("id", "k")
    for layout in (positions.range_layout(df, ["k"]), positions.shuffled_layout(df, ["k"], 1)):
        assert layout.total == 0 and positions.with_position(df, layout).count() == 0


def test_bad_keys_are_refused(spark):
    nulls = spark.createDataFrame([(1,), (None,)], "k int")
    with pytest.raises(ValueError, match="null"):
        positions.range_layout(nulls, ["k"])
    with pytest.raises(ValueError, match="null"):
        positions.shuffled_layout(nulls, ["k"], 1)
    copies = spark.range(2000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias("k"))
    for make in (lambda: positions.range_layout(copies, ["k"], 20), lambda: positions.shuffled_layout(copies, ["k"], 1, 20)):
        with pytest.raises(ValueError, match="not unique"):
            make()


def test_rows_that_appear_after_counting_fail_loudly(spark):
    few = spark.range(50).withColumnRenamed("id", "k")
    more = spark.range(500).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="when rows were counted"):
        positions.with_position(more, positions.shuffled_layout(few, ["k"], 1)).collect()


def test_position_plan_has_one_exchange_and_no_single_task(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey")
    for layout in (positions.range_layout(df, ["o_orderkey"]), positions.shuffled_layout(df, ["o_orderkey"], 1)):
        plan = plan_of(positions.with_position(df, layout))
        assert "SinglePartition" not in plan and "Python" not in plan
        assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and plan.count("hashpartitioning") == 0


def test_parts_are_contiguous_and_bounded(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    out = positions.with_position(df, positions.shuffled_layout(df, ["k"], 3, 500)).withColumn("p", F.spark_partition_id())
    parts = out.groupBy("p").agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("z")).collect()
    assert len(parts) == 10
    assert all(r.z - r.a + 1 == r.n and r.n < 1000 for r in parts)


@pytest.fixture(scope="module")
def grouped(spark):
    """One group holds most rows, one is null, several are small; every third value is missing."""
    rng = random.Random(2)
    rows = [("hot", rng.random(), i) for i in range(900)] + [("warm", rng.random(), 1000 + i) for i in range(150)]
    rows += [(rng.choice(["a", "b", None]), rng.random(), 2000 + i) for i in range(60)]
    rows = [(g, t, i, None if i % 3 or i < 40 else float(i), f"v{i}") for g, t, i in rows]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, t double, i int, v double, s string").repartition(6).cache()


ORDER = ["t", "i"]


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("per_slice", [10, 100, 1_000_000])
def test_group_operators_match_plain_windows(grouped, per_slice):
    window = Window.partitionBy("g").orderBy(*ORDER)
    numbered = groups.number_rows(grouped, ["g"], ORDER, "n", per_slice)
    same(numbered, grouped.withColumn("n", (F.row_number().over(window) - 1).cast("bigint")))
    filled = groups.fill_forward(grouped, ["g"], ORDER, {"v": "f"}, 0.0, per_slice)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    same(filled, grouped.withColumn("f", F.coalesce(F.last("v", ignorenulls=True).over(so_far), F.lit(0.0))))
    replaced = groups.fill_forward(grouped, ["g"], ORDER, {"v": "v"}, None, per_slice)
    same(replaced, grouped.withColumn("v", F.last("v", ignorenulls=True).over(so_far)))
    following = groups.next_row(grouped, ["g"], ORDER, {"v": "nv", "s": "ns"}, per_slice)
    same(following, grouped.withColumns({"nv": F.lead("v").over(window), "ns": F.lead("s").over(window)}))


def test_text_carried_between_slices_is_not_forced_into_a_broadcast(spark, grouped):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fixed = grouped.withColumn("g", F.xxhash64("g"))
        text = groups.fill_forward(fixed, ["g"], ORDER, {"s": "f"}, None, 100)
        number = groups.fill_forward(fixed, ["g"], ORDER, {"v": "f"}, None, 100)
        text_key = groups.fill_forward(grouped, ["g"], ORDER, {"v": "f"}, None, 100)
        assert plan_of(text).count("BroadcastHashJoin") < plan_of(number).count("BroadcastHashJoin")
        assert plan_of(text_key).count("BroadcastHashJoin") < plan_of(number).count("BroadcastHashJoin")
        same(text, fixed.withColumn("f", F.col("s")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_hot_group_is_cut_beyond_the_cap_too(spark, monkeypatch):
    monkeypatch.setattr(groups, "MAX_HOT_GROUPS", 4)
    df = spark.range(1200).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 20 + 1).alias("g"), F.col("id").alias("i"))
    slices = groups.Slices(df, ["g"], ["i"], 10)
    assert {r.g for r in slices.df.where("__slice > 0").select("g").distinct().collect()} == set(range(21))
    numbered = groups.number_rows(df, ["g"], ["i"], "n", 10)
    same(numbered, df.withColumn("n", (F.row_number().over(Window.partitionBy("g").orderBy("i")) - 1).cast("bigint")))


def test_hot_group_is_spread(grouped):
    slices = groups.Slices(grouped, ["g"], ORDER, 100)
    sizes = {(r.g, r["__slice"]): r["count"] for r in slices.df.groupBy("g", "__slice").count().collect()}
    assert max(sizes.values()) < 250
    assert len([k for k in sizes if k[0] == "hot"]) >= 5
    assert {k[1] for k in sizes if k[0] in ("a", "b", None)} == {0}


@pytest.mark.parametrize("limit", [0, 1, 37, 499, 500, 900, 10_000])
@pytest.mark.parametrize("top_keys", [5, 100_000])
def test_first_rows(spark, limit, top_keys):
    keys = sorted({(i % 7, i * 31 % 503) for i in range(900)})
    df = spark.createDataFrame(keys, "a int, b int").repartition(4)
    got = sorted(tuple(r) for r in limits.first_rows(df, limit, ["a", "b"], top_keys).collect())
    assert got == keys[:limit]


def test_limit_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = plan_of(limits.first_rows(df, 50, ["doc_id"]))
    assert "LessThanOrEqual(doc_id,49)" in plan and "Exchange" not in plan
    assert limits.first_rows(df, None, ["doc_id"]) is df
    with pytest.raises(ValueError):
        limits.first_rows(df, -1, ["doc_id"])


def test_the_largest_number_of_buckets(spark):
    """Boundary arithmetic must not overflow when both buckets and samples are at their bound."""
    df = spark.range(600_000).withColumnRenamed("id", "k")
    layout = positions.range_layout(df, ["k"], 10)
    assert layout.total == 600_000 and len(layout.lookup) > 60_000 and layout.num_parts == 60_000
    assert layout.lookup["__part"].is_monotonic_increasing


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_limits_and_splits_do_not_depend_on_the_session_time_zone(spark, zone):
    """Keys of every type, through the plain and the narrowing search, give the same rows in any zone."""
    base = spark.range(300).select(
        "id",
        F.expr("timestamp_micros(1700000000000000 + id * 3600000007)").alias("ltz"),
        F.expr("CAST('2024-03-10 00:00:00.000001' AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(id AS INT))").alias("ntz"),
        F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("day"),
        F.expr("CAST(id AS DECIMAL(20, 4)) / 7").alias("dec"),
        F.expr("CAST(id AS DOUBLE) / 3").alias("dbl"),
        F.expr("CAST(lpad(CAST(id AS STRING), 5, '0') AS BINARY)").alias("bin"),
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = base.collect()
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for key in ("ltz", "ntz", "day", "dec", "dbl", "bin"):
            for top in (100_000, 16):
                got = {r["id"] for r in limits.first_rows(base, 120, [key], top_keys=top).select("id").collect()}
                assert got == set(range(120)), (key, top)
        split = {r["id"] for r in splits.ratio_split(base.select("ltz", "id"), 0.2, ["ltz"], 1)[0].where("split = 'val'").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(rows) == 300
    assert split == {r["id"] for r in splits.ratio_split(base.select("ltz", "id"), 0.2, ["ltz"], 1)[0].where("split = 'val'").collect()}


@pytest.mark.parametrize("first,end", [(0, 10), (95, 260), (999, 1000), (400, 400), (0, 1000)])
def test_a_range_of_positions_moves_only_its_buckets(spark, first, end):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(4)
    whole = positions.range_layout(df, ["k"], 50)
    part = positions.with_position(df, whole.between(first, end))
    got = {(r["k"], r["position"]) for r in part.collect() if first <= r["position"] < end}
    assert got == {(i, i) for i in range(first, end)}
    if end - first < 200:
        moved = part.count()
        assert moved <= end - first + 200
    plan = plan_of(part)
    assert plan.index("BroadcastHashJoin") > plan.index("Exchange"), "rows are chosen below the exchange"


def test_train_only_split_equals_the_train_part(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    both = {(r["k"], r["position"]) for r in splits.ratio_split(df, 0.3, ["k"], 5, 40)[0].where("split = 'train'").collect()}
    alone, totals = splits.ratio_split(df, 0.3, ["k"], 5, 40, train_only=True)
    assert {(r["k"], r["position"]) for r in alone.collect()} == both and totals == {"train": 350, "val": 150}


@pytest.mark.parametrize("layout", [positions.range_layout, lambda df, keys: positions.shuffled_layout(df, keys, 42)])
def test_duplicate_keys_are_refused_at_any_size(spark, layout):
    pairs = spark.range(2000).selectExpr("id DIV 2 AS id", "concat('k', repeat('x', 300), id DIV 2) AS t")
    for keys in (["id"], ["t"], ["id", "t"]):
        with pytest.raises(ValueError, match="not unique: 1000 keys occur more than once, one of them 2 times"):
            layout(pairs, keys)
    one_pair = spark.range(5000).union(spark.range(1).selectExpr("4321L AS id"))
    with pytest.raises(ValueError, match="not unique: 1 keys"):
        layout(one_pair, ["id"])
    near_equal = spark.range(2000).selectExpr("id DIV 2 AS a", "id % 2 AS b")
    assert layout(near_equal, ["a", "b"]).total == 2000


def test_rows_that_appear_in_a_table_counted_empty_fail_loudly(spark):
    layout = positions.range_layout(spark.range(0).withColumnRenamed("id", "k"), ["k"])
    with pytest.raises(Exception, match="was not there when rows were counted"):
        positions.with_position(spark.range(3).withColumnRenamed("id", "k"), layout).collect()
