"""WARC archives: written by Spark's text writer, read by boundary-chain verification.

Writing. A record is a header, a blank line, the payload and two line ends; the text writer's line separator is those
line ends, so a task streams its records into a valid WARC 1.1 file through Spark's own commit protocol. Of
records with equal payloads the one with the largest page id is a response with the payload; the others are revisit
records without it, which name the response and give the payload's digest and length.

Reading. The archive is split into byte ranges like any text file, with the record magic as line separator, so
each row is what stands between two magics, real or inside a payload. A task knows the order and the bytes of its
rows, parses each as if it were a record, and emits a *candidate*: its offset in the split and that of the successor
which its Content-Length announces. Inside the split it already follows each candidate's chain to where it leaves.
The lengths of the splits before turn these into file offsets. From offset 0 of each file, pointer jumping
over the chain ends (every round doubles the jump) finds where the true chain enters each split, and each split
then marks the records on its own chain. Candidates off the chain are payload bytes and are rejected. A payload that
holds magics lies in several rows; those rows belong to the record before them and are joined to it again.

Everything that is gathered is bounded by one split or one record. Chain tables are staged in the shared
folder. A null html is an empty payload; a null url has no target line, and blanks in a url are written as %20 and the like.
Rows without an id are responses, or revisit a row with an id; repeated rows are records of the same kind. An empty
table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillshard.llm.common import sized, staged, table, text_batches
from quillshard.session import scratch_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LENGTH = re.compile(rb"^Content-Length: *([0-9]{1,18})\r$", re.MULTILINE)
_FIELD = {name: re.compile(rb"^%s: *([^\r\n]*)\r$" % key, re.MULTILINE) for name, key in {
    "record_type": b"WARC-Type", "record_id": b"WARC-Record-ID", "target_uri": b"WARC-Target-URI",
    "refers_to_id": b"WARC-Refers-To", "payload_digest": b"WARC-Payload-Digest", "payload_bytes": b"X-Payload-Length"}.items()}
CANDIDATE = (
    "file string, block bigint, at bigint, next bigint, leaves bigint, size bigint, content_length bigint, whole boolean,"
    " record_type string, record_id string, target_uri string, refers_to_id string, header_digest string, header_bytes bigint,"
    " digest string"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string, five bits at a time."""
    digits = []
    for i in range(32):
        first, shift = divmod(5 * i, 4)
        pair = F.conv(F.rpad(F.substring(hex_digest, first + 1, 2), 2, "0"), 16, 10).cast("int")
        digits.append(F.substring(F.lit(ALPHABET), F.shiftright(pair, 3 - shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*digits)


# --- writing -----------------------------------------------------------------------------------


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, sha, refers_to`` of the rows that are revisits: the largest id with the same payload stays a response."""
    payload = F.coalesce("html", F.lit(""))
    keys = staged(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("bytes")), "warc-keys")
    shared = keys.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to")).where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    others = keys.join(shared.select("sha", "refers_to"), "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return staged(others.select("page_id", "sha", "refers_to").distinct(), "warc-revisits")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_warc(pages: DataFrame, root: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One record per row of ``page_id, url, html`` in uncompressed archives under ``root``."""
    revisits = record_types(pages, min_bytes)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    named = revisits.select(F.col("page_id").alias("__page"), F.col("sha").alias("__sha"), "refers_to")
    # few revisits are broadcast by their counted rows and the payloads stay where they are read
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha") == F.col("__sha"))
    marked = rows.join(sized(named, revisits.count()), same, "left")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    uri = F.col("url")
    for blank, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(blank), F.lit(code))
    header = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Refers-To", F.when(revisit, record_urn(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        _line("X-Payload-Length", F.octet_length("payload").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    marked.select(F.concat(header, body).alias("value")).write.option("lineSep", END).text(root)


# --- reading -----------------------------------------------------------------------------------


def _segments(spark: SparkSession, root: str) -> DataFrame:
    """Bytes between two magics, with the file and the split they were read in."""
    text_batches(spark)
    return spark.read.option("lineSep", MAGIC).text(root).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def parse(segment: bytes) -> dict | None:
    """What follows a magic, read as a record: header fields, content length and its start; None if it is no header."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = segment[: end + 2]
    length = _LENGTH.search(head)
    if not length:
        return None
    fields = {name: (m[1].decode(errors="replace") if (m := p.search(head)) else None) for name, p in _FIELD.items()}
    return fields | {"start": end + 4, "length": int(length[1])}


def _chain_ends(rows: list[dict]) -> None:
    """For each candidate of one split, where its chain leaves the split (or runs into no candidate)."""
    by_offset = {r["at"]: r for r in rows}
    for r in reversed(rows):
        after = by_offset.get(r["next"]) if r["next"] is not None else None
        r["leaves"] = after["leaves"] if after else r["next"]


def _candidate_batches(batches):
    split, rows, at = None, [], 0

    def out():
        _chain_ends(rows)
        names = [f.split()[0] for f in CANDIDATE.split(",")]
        types = [pa.bool_() if "boolean" in f else pa.int64() if "bigint" in f else pa.string() for f in CANDIDATE.split(",")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    for batch in batches:
        for segment, file, block in zip(*(batch.column(n).to_pylist() for n in ("value", "file", "block")), strict=True):
            if (file, block) != split:
                if rows:
                    yield out()
                split, rows, at = (file, block), [], 0
            segment = segment or b""
            found = parse(segment)
            length = found["length"] if found else None
            whole = found is not None and found["start"] + length <= len(segment)
            payload = segment[found["start"] : found["start"] + length] if whole else b""
            # at: offset of the row in its split; its own magic stands right before it
            rows.append({
                "file": file, "block": block, "at": at, "size": len(segment),
                "next": None if found is None else at + found["start"] + length + len(END) + len(MAGIC),
                "leaves": None, "content_length": length, "whole": whole,
                "record_type": found and found["record_type"], "record_id": found and found["record_id"],
                "target_uri": found and found["target_uri"], "refers_to_id": found and found["refers_to_id"],
                "header_digest": found and (found["payload_digest"] or "").removeprefix("sha1:") or None,
                "header_bytes": int(found["payload_bytes"]) if found and found["payload_bytes"] else None,
                "digest": base32_sha1(payload) if whole else None,
            })
            at += len(segment) + len(MAGIC)
    if rows:
        yield out()


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """Every candidate with file offsets: ``at``, ``next`` and ``leaves`` count from the file's first byte after a magic."""
    local = staged(_segments(spark, root).mapInArrow(_candidate_batches, CANDIDATE), "warc-candidates")
    splits = local.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    placed = local.join(sized(bases, bases.count()), ["file", "block"])
    return placed.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves")}).drop("base")


def _entries(nodes: DataFrame) -> DataFrame:
    """``file, at``: where the chain from each file's start enters splits, by pointer jumping over chain ends."""
    jump = staged(nodes.where(F.col("leaves").isNotNull()).select("file", "at", F.col("leaves").alias("to")), "warc-jump")
    # the row before a file's first magic is empty; the first record comes right after that magic
    reached = staged(nodes.where(F.col("at") == len(MAGIC)).select("file", "at"), "warc-reached")
    n = reached.count()
    while True:
        step = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = staged(reached.union(step).distinct(), "warc-reached")
        more = reached.count()
        if more == n:
            return reached
        n = more
        twice = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = staged(jump.join(twice, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "warc-jump")


def _mark(rows: pa.Table) -> pa.Table:
    """One split: follow the chain from its entry; ``owner`` is the record that a row's bytes belong to."""
    rows = rows.sort_by("at")
    at, following, entry = rows["at"].to_pylist(), rows["next"].to_pylist(), rows["entry"].to_pylist()
    expected = next((a for a, e in zip(at, entry, strict=True) if e), None)
    owner, current = [], None
    for a, f in zip(at, following, strict=True):
        if a == expected and f is not None:
            current, expected = a, f
        owner.append(current)
    return rows.select(["file", "block", "at"]).append_column("owner", pa.array(owner, pa.int64()))


def owners(cand: DataFrame) -> DataFrame:
    """``file, at, owner`` per candidate; a candidate is a record where ``owner = at``."""
    entries = _entries(cand.select("file", "at", "leaves")).withColumn("entry", F.lit(True))
    light = cand.select("file", "block", "at", "next").join(entries, ["file", "at"], "left").select("file", "block", "at", "next", "entry")
    marked = staged(
        light.groupBy("file", "block").applyInArrow(_mark, "file string, block bigint, at bigint, owner bigint"), "warc-marked")
    # rows before a split's entry continue the last record of the splits before it
    last = marked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    joined = marked.join(sized(carried, carried.count()), ["file", "block"])
    return joined.select("file", "at", F.coalesce("owner", "carried").alias("owner"))


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``root``.

    ``file, offset, record_type, record_id, target_uri, refers_to_id, payload_bytes, payload_digest`` and, if asked for, ``payload``
    (null for revisits). Digests and lengths of responses are computed from their bytes; revisits state them.
    """
    cand = staged(candidates(spark, root), "warc-placed")
    owned = staged(owners(cand), "warc-owners")
    records = cand.join(owned, ["file", "at"]).where(F.col("owner") == F.col("at"))
    digests = records.where("whole").select("file", "at", "digest")
    broken = staged(records.where(~F.col("whole")).select("file", "owner"), "warc-broken")
    response = F.col("record_type") != "revisit"
    parts = None
    if payloads or not broken.isEmpty():
        # only a payload that holds magics, or one that is asked for, is read again
        parts = _assembled(spark, root, cand, owned if payloads else owned.join(broken, ["file", "owner"], "left_semi"))
        again = broken.withColumnRenamed("owner", "at")
        digests = digests.union(parts.join(again, ["file", "at"], "left_semi").select("file", "at", "digest"))
    full = records.drop("digest").join(digests, ["file", "at"], "left")
    columns = [
        "file", (F.col("at") - len(MAGIC)).alias("offset"), "record_type", "record_id", "target_uri", "refers_to_id",
        F.when(response, F.col("content_length")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("header_digest")).alias("payload_digest"),
    ]
    if not payloads:
        return full.select(*columns)
    bodies = parts.select("file", "at", "payload")
    return full.join(bodies, ["file", "at"], "left").select(*columns, F.when(response, F.col("payload")).alias("payload"))


def _assemble(rows: pa.Table) -> pa.Table:
    """One record from its rows in order: the magics between them are payload."""
    rows = rows.sort_by("at")
    data = MAGIC.encode().join(v or b"" for v in rows["value"].to_pylist())
    found = parse(data)
    payload = data[found["start"] : found["start"] + found["length"]]
    return pa.table({
        "file": rows["file"][:1], "at": pa.array([rows["at"][0].as_py()], pa.int64()),
        "digest": [base32_sha1(payload)], "payload": pa.array([payload], pa.binary())})


def _offset_batches(batches):
    split, at = None, 0
    for batch in batches:
        offsets = []
        for segment, file, block in zip(*(batch.column(n).to_pylist() for n in ("value", "file", "block")), strict=True):
            if (file, block) != split:
                split, at = (file, block), 0
            offsets.append(at)
            at += len(segment or b"") + len(MAGIC)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offsets, pa.int64())], names=[*batch.schema.names, "local"])


def _assembled(spark: SparkSession, root: str, cand: DataFrame, wanted: DataFrame) -> DataFrame:
    """``file, at, digest, payload`` of the records whose rows are wanted; a second scan of the archives."""
    read = _segments(spark, root).mapInArrow(_offset_batches, "value binary, file string, block bigint, local bigint")
    firsts = cand.groupBy("file", "block").agg(F.min("at").alias("base"))
    placed = read.join(sized(firsts, firsts.count()), ["file", "block"]).select("file", (F.col("base") + F.col("local")).alias("at"), "value")
    rows = placed.join(wanted.where(F.col("owner").isNotNull()), ["file", "at"])
    return rows.groupBy("file", "owner").applyInArrow(_assemble, "file string, at bigint, digest string, payload binary")


def op2_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), root)
    page = lambda urn: F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return read_warc(spark, root, payloads=False).select(
        page(F.col("record_id")).alias("page_id"), F.col("payload_bytes").cast("bigint").alias("payload_bytes"), "payload_digest",
        "record_type", page(F.col("refers_to_id")).alias("refers_to"))


OP2_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS sha FROM pages),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS newest FROM p),
bits AS (
  SELECT *, list_transform(range(0, 32), lambda i: substr('{ALPHABET}', 1 + CAST((
      (16 * (strpos('0123456789abcdef', substr(sha, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1)
       + greatest(strpos('0123456789abcdef', substr(sha || '0', CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1, 0))
      >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31 AS INTEGER), 1)) AS digits
  FROM marked)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, array_to_string(digits, '') AS payload_digest,
       CASE WHEN bytes >= {MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= {MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM bits
"""
