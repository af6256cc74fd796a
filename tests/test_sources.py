import pytest

from quillshard.session import scratch_dir
from quillshard.sources.datasets import read_examples, spread_small_input
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(i, f"q{i}", "en" if i % 2 else "fr", "train" if i % 5 else "test") for i in range(20)], "k int, q string, subset string, split string"
    )


@pytest.mark.parametrize("fmt, options", [("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"})])
def test_formats(spark, rows, folder, fmt, options):
    rows.write.format(fmt).options(**options).save(f"{folder}/d")
    got = read_examples(spark, f"{folder}/d", fmt, "train", "en", schema=rows.schema, options=options)
    assert sorted(r.k for r in got.collect()) == [i for i in range(20) if i % 2 and i % 5]
    assert read_examples(spark, f"{folder}/d", fmt, None, None, schema=rows.schema, options=options).count() == 20


def test_limit_follows_the_key(spark, rows, folder):
    rows.repartition(3).write.parquet(f"{folder}/d")
    read = lambda n, **kw: sorted(r.k for r in read_examples(spark, f"{folder}/d", split="train", limit=n, **kw).collect())
    assert read(3, key=["k"]) == [1, 2, 3]
    assert len(read(99, key=["k"])) == 16
    with pytest.raises(ValueError, match="key"):
        read(3)


def test_text_is_one_column_and_one_split(spark, rows, folder):
    rows.select("q").write.text(f"{folder}/t")
    assert read_examples(spark, f"{folder}/t", "text", "train").count() == 20


def test_partitioned_layout_prunes_folders(spark, rows, folder):
    rows.write.partitionBy("subset", "split").parquet(f"{folder}/p")
    got = read_examples(spark, f"{folder}/p", split="train", subset="fr")
    assert sorted(r.k for r in got.collect()) == [i for i in range(20) if not i % 2 and i % 5]
    plan = plan_of(got)
    assert "PartitionFilters: [isnotnull(subset" in plan and "DataFilters: []" in plan


def test_errors(spark, rows, folder):
    with pytest.raises(FileNotFoundError):
        read_examples(spark, f"{folder}/none")
    with pytest.raises(ValueError):
        read_examples(spark, folder, "xml")
    rows.drop("subset").write.parquet(f"{folder}/d")
    with pytest.raises(ValueError, match="subset"):
        read_examples(spark, f"{folder}/d", subset="en")


class FakeSession:
    """Just enough of a session: its settings and its master."""

    def __init__(self, master, **settings):
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_follows_the_session_setting():
    cluster = FakeSession("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://shared/place/"})
    first, second = scratch_dir(cluster, "x"), scratch_dir(cluster, "x")
    assert first.startswith("hdfs://shared/place/x-") and first != second
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(FakeSession("spark://host:7077"), "x")
    assert scratch_dir(FakeSession("local[2]"), "x").startswith("/")


def test_only_small_inputs_are_spread(spark, folder):
    rows = spark.range(100)
    rows.coalesce(1).write.parquet(f"{folder}/one")
    one = spread_small_input(spark.read.parquet(f"{folder}/one"))
    assert one.rdd.getNumPartitions() == 8 and one.count() == 100
    rows.repartition(60).write.parquet(f"{folder}/many")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))
    try:
        many = spark.read.parquet(f"{folder}/many")
        assert spread_small_input(many) is many
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
