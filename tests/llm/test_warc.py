import base64
import hashlib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillshard.llm.warc import MAGIC, OP2_SQL, base32, candidates, op2_boundary_chain, read_warc, write_warc
from tests.conftest import SF_SMALL
from tests.oracle_check import rows_of

SCHEMA = "page_id bigint, url string, html string"


def fake(n):
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: {n}\r\n\r\n"


def odd_pages():
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.net/{i}", "".join(rng.choice("ab<é>\r\n ") for _ in range(rng.randint(0, 900)))) for i in range(150)]
    rows += [(200 + i, "http://x/y z\r\n", f"before {MAGIC} middle {fake(rng.randint(0, 4000))} after {MAGIC}{'x' * 300}") for i in range(20)]
    rows += [(300, None, None), (301, "u", ""), (302, "u", ""), (303, "u", "same"), (304, "u", "same"), (304, "u", "same"),
             (None, "u", "same"), (None, None, None), (305, "u", "é" * 5000), (306, "u", MAGIC), (307, "u", MAGIC * 50), (308, "u", fake(0))]
    return rows


def walk(data: bytes):
    """The records of one file, read front to back by their lengths alone."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        assert head.startswith(MAGIC.encode())
        n = int(re.search(rb"Content-Length: (\d+)\r\n", head)[1])
        assert data[end + n : end + n + 4] == b"\r\n\r\n"
        out.append((at, re.search(rb"WARC-Record-ID: (\S+)", head)[1].decode(), re.search(rb"WARC-Type: (\S+)", head)[1].decode(), data[end : end + n]))
        at = end + n + 4
    return out


@pytest.mark.parametrize("split", ["128m", "700b", "3k"])
def test_chain_equals_a_front_to_back_walk(spark, folder, split):
    root = f"{folder}/warc"
    write_warc(spark.createDataFrame(odd_pages(), SCHEMA).repartition(3), root)
    want = []
    for name in sorted(os.listdir(root)):
        if name.startswith("part-"):
            with open(f"{root}/{name}", "rb") as f:
                want += [(name, *r) for r in walk(f.read())]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_warc(spark, root).collect()
        if split != "128m":
            assert candidates(spark, root).select("file", "block").distinct().count() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["record_id"], r["record_type"], bytes(r["payload"] or b"")) for r in rows)
    assert got == sorted(want) and len(got) == len(odd_pages())
    for r in rows:
        if r["record_type"] == "response":
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
            assert r["payload_bytes"] == len(r["payload"])


def test_contract_equals_sql_on_odd_pages(spark, folder):
    spark.createDataFrame(odd_pages(), SCHEMA).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.execute(OP2_SQL)
    columns = [d[0] for d in want.description]
    got = op2_boundary_chain(spark, folder)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    want = con.execute(OP2_SQL)
    columns = [d[0] for d in want.description]
    got = op2_boundary_chain(spark, SF_SMALL)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_base32(spark):
    texts = [str(i) for i in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32(F.sha1("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}


def test_min_bytes_and_empty(spark, folder):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")]
    write_warc(spark.createDataFrame(rows, SCHEMA), f"{folder}/a", min_bytes=3)
    assert sorted(r["record_type"] for r in read_warc(spark, f"{folder}/a", payloads=False).collect()) == ["response"] * 3 + ["revisit"]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/pages.parquet")
    assert op2_boundary_chain(spark, folder).count() == 0
