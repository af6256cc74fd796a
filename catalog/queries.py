"""One registered query per operator, over the given tables."""

from __future__ import annotations

import json
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import tables as t
from quillshard.functions import metrics as m
from quillshard.functions.encoders import ByteEncoder, FileEncoder, HashWordEncoder
from quillshard.functions.examples import attention_mask, encode_rows, pad_ids, to_examples
from quillshard.functions.formatting import InstructionFormatter, full_text, with_prompt_target
from quillshard.operators import batches as b
from quillshard.operators import telemetry as tele
from quillshard.operators.limits import first_rows
from quillshard.operators.permutation import Permutation, permuted_epochs
from quillshard.operators.positions import range_layout, shuffled_layout, with_position
from quillshard.operators.shards import assign_shards, one_shard, shard_bounds, shard_size
from quillshard.operators.splits import TRAIN, VALIDATION, ordered_split, ratio_split
from quillshard.operators.validation import validate
from quillshard.plans.config import PreprocessConfig
from quillshard.plans.preprocess import place_rows, preprocess, read_rows, tokenized_examples
from quillshard.plans.steps import step_plan
from quillshard.session import scratch_dir
from quillshard.sources import runlogs, shards, snapshots
from quillshard.sources.datasets import read_examples, spread_small_input
from quillshard.sources.slices import read_slices
from quillshard.streaming import examples as stream_examples
from quillshard.streaming import metrics as stream_metrics

SEED = 42
LENGTH = 512
TEMPLATE = "### Q: {instruction} {{as is}}\n### Context: {input}\n### A:"

DOC_FORMAT = InstructionFormatter("lang", "text", "source")
PAIR_FORMAT = InstructionFormatter("instruction", "output", "input")


def digest(ids: Column) -> Column:
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "documents")


def docs_to_encode(spark: SparkSession, sf: str) -> DataFrame:
    return spread_small_input(docs(spark, sf))


def doc_config(sf: str, **changes) -> PreprocessConfig:
    return PreprocessConfig(f"{sf}/documents.parquet", ("doc_id",), **changes)


def example_digests(examples: DataFrame, *keep: str) -> DataFrame:
    return examples.select(
        *keep,
        digest(F.col("input_ids")).alias("ids_md5"),
        b.token_count(F.col("attention_mask")).alias("n_tokens"),
        digest(F.col("labels")).alias("labels_md5"),
    )


# --- sources and sinks -------------------------------------------------------------------------


def q_read_examples(spark, sf):
    rows = read_examples(spark, f"{sf}/documents.parquet", "parquet", "train", "fr", subset_column="lang")
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def q_split_slices(spark, sf):
    """Slices of three languages as one training set, in their order."""
    rows = read_slices(spark, f"{sf}/documents.parquet", "fr[:10%]+de[5:15]+en[-20:]", ["doc_id"], split_column="lang")
    return rows.select("position", "lang", "doc_id", F.md5("text").alias("text_md5"))


def q_limit_first_n(spark, sf):
    return first_rows(docs(spark, sf), 150, ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


def q_limit_by_time(spark, sf):
    """The first events by time, through the plain and the narrowing search of the bound."""
    events = t.table(spark, sf, "events")
    few = first_rows(events, 150, ["ts", "event_id"]).select("event_id", F.lit("plain").alias("search"))
    return few.union(first_rows(events, 700, ["ts", "event_id"], top_keys=64).select("event_id", F.lit("narrowing").alias("search")))


def q_rewrite_keep_stale(spark, sf):
    """A rerun with fewer rows than shards over an earlier run: planned shards are replaced, empty ones too."""
    root = scratch_dir(spark, "shards")
    cfg = doc_config(sf, output_dir=root, num_train_shards=6)
    preprocess(spark, cfg, DOC_FORMAT, ByteEncoder())
    preprocess(spark, replace(cfg, train_max_examples=5, num_train_shards=4, keep_stale=True), DOC_FORMAT, ByteEncoder())
    found = shards.read_all_shards(spark, root).groupBy("split", "shard_id").agg(F.count(F.lit(1)).alias("stored_rows"))
    rows = shards.read_manifest(spark, root).join(found, ["split", "shard_id"], "left")
    return rows.select("shard_name", "num_rows", F.coalesce("stored_rows", F.lit(0)).cast("bigint").alias("stored_rows"))


def q_snapshot_rewrite(spark, sf):
    """A reader pinned before a rewrite into fewer shards, and the version after it, whose last shards are carried over."""
    root = scratch_dir(spark, "snapshots")
    cfg = doc_config(sf, output_dir=root, num_train_shards=6, keep_position=True, snapshots=True)
    preprocess(spark, cfg, DOC_FORMAT, ByteEncoder())
    pinned = snapshots.open_snapshot(spark, root)
    preprocess(spark, replace(cfg, num_train_shards=4, keep_stale=True), DOC_FORMAT, ByteEncoder())
    readers = {"pinned": pinned, "newest": snapshots.open_snapshot(spark, root)}
    seen = [s.read_all(keep_position=True).withColumn("reader", F.lit(name)) for name, s in readers.items()]
    return example_digests(seen[0].unionByName(seen[1]), "reader", "shard_id", "position")


def q_load_shard(spark, sf):
    root = scratch_dir(spark, "shards")
    preprocess(spark, doc_config(sf, output_dir=root, num_train_shards=4, keep_position=True), DOC_FORMAT, ByteEncoder())
    return example_digests(shards.load_shard(spark, root, "shard_1", keep_position=True), "position")


def _doc_manifest(spark, sf, train, val) -> DataFrame:
    placed, totals = ratio_split(docs(spark, sf).select("doc_id"), 0.1, ["doc_id"], SEED)
    counts = {TRAIN: train, VALIDATION: val}
    return shards.shard_manifest(assign_shards(placed, totals, counts), counts)


def q_resolve_shards(spark, sf):
    return shards.resolve_shards(_doc_manifest(spark, sf, 3, 2), "shard_{rank}", 5).select(
        "rank", "shard_name", "found", "num_rows"
    )


def q_val_visibility(spark, sf):
    manifest = _doc_manifest(spark, sf, 3, 2)
    out = None
    for label, template in {"none": None, "shared": "val_shard_1", "by rank": "val_shard_{rank}", "padded": "val_shard_{id:05d}"}.items():
        seen = shards.visible_validation_shards(manifest, template, 3).withColumn("template", F.lit(label))
        out = seen if out is None else out.unionByName(seen)
    return out


def q_write_read_roundtrip(spark, sf):
    root = scratch_dir(spark, "shards")
    cfg = doc_config(sf, output_dir=root, num_train_shards=4, num_val_shards=2, val_split_ratio=0.1, keep_position=True)
    preprocess(spark, cfg, DOC_FORMAT, ByteEncoder())
    return example_digests(shards.read_all_shards(spark, root, keep_position=True), "split", "shard_id", "position")


def q_shard_manifest(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_orderkey")
    placed, totals = ratio_split(orders, 0.05, ["o_orderkey"], SEED)
    counts = {TRAIN: 7, VALIDATION: 3}
    return shards.shard_manifest(assign_shards(placed, totals, counts), counts)


def q_run_summary(spark, sf):
    root = scratch_dir(spark, "summaries")
    steps = t.step_log(spark, sf)
    config = F.struct(
        F.col("run_id").alias("model_name"), F.lit(4).alias("batch_size"), F.lit(5e-5).alias("lr"), F.lit(False).alias("use_lora")
    )
    runs = steps.where(F.col("rank") == 0).groupBy("run_id").agg(
        F.max("step").alias("global_step"), F.sum("duration").alias("total_time_seconds")
    ).withColumn("config", config)
    runlogs.write_run_summaries(runs, root)
    return runlogs.read_run_summaries(spark, root).select(
        F.col("config.model_name").alias("model_name"),
        F.col("config.batch_size").alias("batch_size"),
        "global_step",
        F.round("total_time_seconds", 4).alias("total_time_seconds"),
    )


# --- run logs ----------------------------------------------------------------------------------


def q_parse_logs(spark, sf):
    """The step log as text files, scanned back into records."""
    root = scratch_dir(spark, "logs")
    t.log_lines(t.step_log(spark, sf)).select("value").write.text(root)
    return runlogs.read_run_logs(spark, root, "*.txt").drop("file")


def q_log_records(spark, sf):
    """The step log as text files, a file for each run and rank, scanned back into whole records with their continuation lines."""
    root = scratch_dir(spark, "records")
    steps = t.step_log(spark, sf)
    more = t.log_lines(steps).withColumns({"nth": F.when(F.col("value").startswith("  "), 1).otherwise(0)})
    placed = more.join(steps.select("event_id", "rank", "step"), "event_id").repartition("run_id", "rank")
    ordered = placed.sortWithinPartitions("run_id", "rank", "step", "nth")
    ordered.select("value", "run_id", "rank").write.partitionBy("run_id", "rank").text(root)
    folder = F.regexp_extract("_metadata.file_path", "run_id=(.*)/rank=([0-9]+)", 0)
    return runlogs.read_log_records(spark, root, "*.txt", log=folder, turn=F.col("_metadata.file_name")).drop("log")


def q_other_log_lines(spark, sf):
    """Continuation lines and malformed lines of the log, counted by their text; nothing is lost in silence."""
    steps = t.step_log(spark, sf)
    bad = steps.where(F.col("step") % 7 == 0).select(F.explode(F.array(*[F.lit(x) for x in t.BAD_LOG_LINES])).alias("value"))
    lines = t.log_lines(steps).select("value").union(bad)
    return runlogs.other_log_lines(lines).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def q_parse_step_metrics(spark, sf):
    lines = t.log_lines(t.step_log(spark, sf))
    records = runlogs.parse_log_lines(lines.select("event_id", "value"))
    return runlogs.parse_metric_messages(records.select("event_id", "message"))


# --- formatting, encoding, examples ------------------------------------------------------------


def q_format_default(spark, sf):
    return with_prompt_target(t.sft_pairs(spark, sf), PAIR_FORMAT).select("conv_id", "turn", "prompt", "target")


def q_format_template(spark, sf):
    formatter = InstructionFormatter("text", "text", "source", TEMPLATE)
    pair = with_prompt_target(docs(spark, sf), formatter)
    return pair.select("doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def q_full_text(spark, sf):
    pair = with_prompt_target(docs(spark, sf), DOC_FORMAT)
    text = full_text(F.col("prompt"), F.col("target"))
    return pair.select("doc_id", F.md5(text).alias("text_md5"), F.length(text).alias("text_chars"))


class ShoutFormatter:
    """A caller's own formatter: columns of its own making."""

    def columns(self, df: DataFrame) -> tuple[Column, Column]:
        return F.concat(F.lit("["), F.upper("lang"), F.lit("] "), "source", F.lit(":")), F.trim("text", F.lit(" "))


def q_custom_formatter(spark, sf):
    pair = with_prompt_target(docs(spark, sf), ShoutFormatter())
    return pair.select("doc_id", "prompt", F.md5("target").alias("target_md5"))


def q_format_on_null(spark, sf):
    """Null fields as text, as empty text, and as a reason to drop the row."""
    rows = docs(spark, sf).withColumns(
        {"lang": F.when(F.col("lang") != "fr", F.col("lang")), "source": F.when(F.col("doc_id") % 3 != 0, F.col("source"))})
    by_rule = [
        with_prompt_target(rows, InstructionFormatter("lang", "text", "source", on_null=rule)).select(
            "doc_id", F.lit(rule).alias("on_null"), "prompt") for rule in ("text", "empty", "drop")]
    return by_rule[0].union(by_rule[1]).union(by_rule[2])


def q_read_formats(spark, sf):
    """Documents as partitioned JSON and as CSV with a header, read back by the job's own reader."""
    root = scratch_dir(spark, "formats")
    source = docs(spark, sf).select("doc_id", F.md5("text").alias("text_md5"), "lang", F.pmod("doc_id", F.lit(2)).cast("string").alias("part"))
    source.write.partitionBy("lang", "part").json(f"{root}/json")
    source.write.option("header", True).csv(f"{root}/csv")
    schema = "doc_id BIGINT, text_md5 STRING, lang STRING, part STRING"
    own = {"schema": schema, "split_column": "part", "subset_column": "lang", "split": "1", "subset": "de"}
    read = lambda fmt, **more: read_rows(spark, PreprocessConfig(f"{root}/{fmt}", ("doc_id",), fmt=fmt, **own, **more), "de")
    rows = {"json": read("json"), "csv": read("csv", options={"header": "true"})}
    pick = lambda fmt: rows[fmt].select("doc_id", "text_md5", F.lit(fmt).alias("fmt"))
    return pick("json").union(pick("csv"))


def _encoded(spark, sf, encoder) -> DataFrame:
    """Whole-text ids next to the ids cut to the model length."""
    pair = with_prompt_target(docs_to_encode(spark, sf), DOC_FORMAT)
    text = pair.select("doc_id", "prompt", full_text(F.col("prompt"), F.col("target")).alias("text"))
    whole = encoder.attach(text, "prompt", "text", None).withColumnsRenamed({"payload": "whole", "prompt_len": "whole_prompt_len"})
    both = encoder.attach(whole, "prompt", "text", LENGTH)
    ids = both.select(
        "doc_id", F.col("whole_prompt_len").alias("prompt_len"), encoder.ids(F.col("whole")).alias("ids"),
        encoder.ids(F.col("payload")).alias("cut"),
    )
    return ids.select(
        "doc_id", "prompt_len", F.size("ids").alias("n_ids"), digest(F.col("ids")).alias("ids_md5"),
        digest(F.col("cut")).alias("cut_md5"),
    )


def q_encode_bytes(spark, sf):
    return _encoded(spark, sf, ByteEncoder())


def q_encode_hash(spark, sf):
    return _encoded(spark, sf, HashWordEncoder())


def byte_level_tokenizer() -> str:
    """A tokenizer file with one token per byte and a begin token, from the public byte-level alphabet rule.

    Printable bytes stand for themselves; the others, in order, take the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in printable]
    letter = {byte: chr(byte) for byte in printable} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}
    vocab = {letter[byte]: byte for byte in range(256)} | {"<eos>": 256, "<bos>": 257}
    special = lambda i, text: {
        "id": i, "content": text, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True
    }
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [special(256, "<eos>"), special(257, "<bos>")],
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "post_processor": {
                "type": "TemplateProcessing",
                "single": [{"SpecialToken": {"id": "<bos>", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}],
                "pair": [{"Sequence": {"id": "A", "type_id": 0}}, {"Sequence": {"id": "B", "type_id": 1}}],
                "special_tokens": {"<bos>": {"id": "<bos>", "ids": [257], "tokens": ["<bos>"]}},
            },
            "model": {"type": "BPE", "vocab": vocab, "merges": [], "fuse_unk": False, "byte_fallback": False},
        }
    )


def q_encode_file(spark, sf):
    """Each whole text goes through the tokenizer, which cuts its ids to the model length."""
    encoder = FileEncoder(byte_level_tokenizer(), eos_token="<eos>")
    rows = encode_rows(docs_to_encode(spark, sf), DOC_FORMAT, encoder, LENGTH)
    return example_digests(to_examples(rows, encoder, LENGTH, ("doc_id",)), "doc_id")


def q_pad_mask(spark, sf):
    encoder = HashWordEncoder()
    rows = encode_rows(docs_to_encode(spark, sf), DOC_FORMAT, encoder, LENGTH).select("doc_id", encoder.ids(F.col("payload")).alias("ids"))
    return rows.select(
        "doc_id",
        F.size("ids").alias("n_ids"),
        digest(pad_ids(F.col("ids"), LENGTH, encoder.pad_id)).alias("ids_md5"),
        digest(attention_mask(F.size("ids"), LENGTH)).alias("mask_md5"),
    )


def q_labels(spark, sf):
    rows = encode_rows(t.sft_pairs(spark, sf), PAIR_FORMAT, ByteEncoder(), LENGTH)
    return example_digests(to_examples(rows, ByteEncoder(), LENGTH, ("conv_id", "turn")), "conv_id", "turn")


def q_labels_mask_padding(spark, sf):
    rows = encode_rows(t.sft_pairs(spark, sf), PAIR_FORMAT, ByteEncoder(), LENGTH)
    masked = to_examples(rows, ByteEncoder(), LENGTH, ("conv_id", "turn"), mask_padding=True)
    return example_digests(masked, "conv_id", "turn")


def q_final_schema(spark, sf):
    """The stored columns of every example, with their lengths."""
    root = scratch_dir(spark, "shards")
    preprocess(spark, doc_config(sf, output_dir=root, num_train_shards=2), DOC_FORMAT, HashWordEncoder())
    stored = spark.read.parquet(f"{root}/examples/split=train/shard_id=0", f"{root}/examples/split=train/shard_id=1")
    lengths = F.map_from_arrays(
        F.array(*[F.lit(c) for c in stored.columns]), F.array(*[F.size(c) for c in stored.columns])
    )
    return stored.select(F.explode(lengths).alias("column", "length")).groupBy("column", "length").agg(
        F.count(F.lit(1)).alias("examples")
    )


# --- position, split, shard, batch -------------------------------------------------------------


def q_global_position(spark, sf):
    events = t.table(spark, sf, "events").select("event_id", "ts")
    ordered = with_position(events, range_layout(events, ["ts", "event_id"]))
    return with_position(ordered, shuffled_layout(events, ["event_id"], SEED), "shuffled_position").select(
        "event_id", "position", "shuffled_position"
    )


def _sharded_orders(spark, sf, num_shards):
    orders = t.table(spark, sf, "orders").select("o_orderkey")
    placed, totals = ordered_split(orders, TRAIN, ["o_orderkey"])
    return assign_shards(placed, totals, {TRAIN: num_shards}), totals[TRAIN]


def q_shard_assign(spark, sf):
    return _sharded_orders(spark, sf, 7)[0].select("o_orderkey", "position", "shard_id")


def q_shard_one(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_orderkey")
    layout = range_layout(orders, ["o_orderkey"])
    wanted = layout.between(*shard_bounds(layout.total, 7, 6))
    return one_shard(with_position(orders, wanted), layout.total, 7, 6)


def q_split_ratio(spark, sf):
    return ratio_split(t.table(spark, sf, "orders").select("o_orderkey"), 0.07, ["o_orderkey"], SEED)[0]


def q_split_by_time(spark, sf):
    """A split keyed on a moment in time; its digest does not depend on the session's time zone."""
    events = t.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return ratio_split(events, 0.2, ["ts", "event_id"], SEED)[0].select("event_id", "split", "position")


def q_split_subset(spark, sf):
    cfg = doc_config(sf, num_train_shards=3, num_val_shards=2, val_split_ratio=0.5, val_max_examples=100)
    read = lambda lang: docs(spark, sf).where(F.col("lang") == lang)
    placed = place_rows(read("en"), cfg, DOC_FORMAT, ByteEncoder(), read("fr"))
    return placed.df.select("doc_id", "split", "shard_id", "position")


def q_split_val_unwritten(spark, sf):
    cfg = doc_config(sf, num_train_shards=2, num_val_shards=0, val_split_ratio=0.1)
    placed = place_rows(docs(spark, sf), cfg, DOC_FORMAT, ByteEncoder())
    return placed.df.groupBy("split", "shard_id").agg(F.count(F.lit(1)).alias("num_rows"))


def _order_epochs(spark, sf):
    rows, total = _sharded_orders(spark, sf, 4)
    return b.shuffled_epochs(rows, 2, SEED, largest_shard=shard_size(total, 4))


def q_epoch_shuffle(spark, sf):
    return _order_epochs(spark, sf).select("epoch", "shard_id", "o_orderkey", "rn")


def _document_shards(spark, sf, shards_wanted=4):
    """Documents as stored shards: the id is the position. The counts are the manifest's."""
    d = docs(spark, sf).select("doc_id")
    total = d.count()
    size = shard_size(total, shards_wanted)
    rows = d.withColumns({"shard_id": F.floor(F.col("doc_id") / size).cast("int"), "row_in_shard": F.col("doc_id") % size})
    return rows, [end - first for first, end in (shard_bounds(total, shards_wanted, s) for s in range(shards_wanted))]


def q_epoch_permutation(spark, sf):
    rows, counts = _document_shards(spark, sf)
    placed = permuted_epochs(rows, counts, 3, SEED)
    return b.with_batches(placed, 12).select("epoch", "shard_id", "doc_id", "rn", "batch_id")


def q_epoch_batch(spark, sf):
    """One batch of each epoch of a shard, read by its computed positions alone."""
    rows, counts = _document_shards(spark, sf)
    wanted = [(e, p) for e in range(3) for p in Permutation(counts[1], SEED, e).batch(2, 12)]
    nth = F.array(*[F.struct(F.lit(e).alias("epoch"), F.lit(p).cast("bigint").alias("p"), F.lit(i % 12).alias("row_in_batch")) for i, (e, p) in enumerate(wanted)])
    own = rows.where((F.col("shard_id") == 1) & F.col("row_in_shard").isin(sorted({p for _, p in wanted})))
    hits = own.withColumn("hit", F.explode(F.filter(nth, lambda x: x["p"] == F.col("row_in_shard"))))
    return hits.select("hit.epoch", "hit.row_in_batch", "doc_id")


def q_batches(spark, sf):
    batches = b.assemble_batches(b.with_batches(_order_epochs(spark, sf), 12), ["o_orderkey"])
    return batches.select(
        "epoch", "shard_id", "batch_id", F.size("o_orderkey").alias("examples"),
        F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("order_keys"),
    )


def q_val_batches(spark, sf):
    """Validation batches: the stored order, and the training batch size where none is given."""
    rows, total = _sharded_orders(spark, sf, 4)
    ordered = b.stored_order(rows, F.col("shard_id") * shard_size(total, 4))
    batches = b.assemble_batches(b.with_batches(ordered, b.validation_batch_size(None, 12)), ["o_orderkey"])
    return batches.select(
        "shard_id", "batch_id", F.size("o_orderkey").alias("examples"),
        F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("order_keys"),
    )


def q_batch_tokens(spark, sf):
    encoder = HashWordEncoder()
    placed = place_rows(docs_to_encode(spark, sf), doc_config(sf, num_train_shards=4), DOC_FORMAT, encoder)
    slim = placed.df.select("split", "shard_id", "position", encoder.length(F.col("payload")).alias("n_tokens"))
    largest = shard_size(placed.totals[TRAIN], 4)
    return b.batch_tokens(b.with_batches(b.shuffled_epochs(slim, 2, SEED, largest_shard=largest), 4)).drop("split")


def q_step_plan(spark, sf):
    return step_plan(q_shard_manifest(spark, sf), batch_size=4, epochs=3, warmup_ratio=0.03)


def q_preprocess(spark, sf):
    cfg = doc_config(sf, num_train_shards=4, num_val_shards=1, val_split_ratio=0.05)
    examples = tokenized_examples(docs_to_encode(spark, sf), cfg, DOC_FORMAT, ByteEncoder())
    return example_digests(examples, "doc_id", "split", "shard_id", "position")


def q_preprocess_pairs(spark, sf):
    cfg = PreprocessConfig("", ("conv_id", "turn"), num_train_shards=3, num_val_shards=1, val_split_ratio=0.1)
    examples = tokenized_examples(t.sft_pairs(spark, sf), cfg, PAIR_FORMAT, ByteEncoder())
    return example_digests(examples, "conv_id", "turn", "split", "shard_id", "position")


# --- step metrics ------------------------------------------------------------------------------

STEP = ("run_id", "rank", "step")


def q_log_cadence(spark, sf):
    return tele.every_n_steps(t.step_log(spark, sf), 50).select(*STEP, "event_id")


def q_val_cadence(spark, sf):
    return tele.validation_steps(t.step_log(spark, sf), 20).select(*STEP, "event_id")


def q_max_steps(spark, sf):
    return tele.executed_steps(t.step_log(spark, sf), 100).groupBy("run_id", "rank").agg(
        F.max("step").alias("last_step"), F.sum("tokens").alias("tokens")
    )


def q_rank0_metrics(spark, sf):
    steps = t.step_log(spark, sf)
    unknown = steps.withColumn("loss", F.when(F.col("tokens") % 7 != 0, F.col("loss")))
    return tele.published(unknown).select(*STEP, F.round("loss", 6).alias("loss"))


def q_step_metrics(spark, sf):
    steps = t.step_log(spark, sf)
    unknown = steps.withColumns({
        "loss": F.when(F.col("step") % 5 != 0, F.col("loss")),
        "duration": F.when(F.col("step") % 11 == 0, F.lit(float("nan"))).when(F.col("step") % 7 != 0, F.col("duration")),
    })
    return tele.step_metrics(unknown).select(
        *STEP,
        F.round("perplexity", 4).alias("perplexity"),
        F.round("step_duration", 4).alias("step_duration"),
        F.round("steps_per_second", 4).alias("steps_per_second"),
        F.round("tokens_per_second", 4).alias("tokens_per_second"),
        F.round("grad_norm_payload", 6).alias("grad_norm_payload"),
    )


def q_step_time_summary(spark, sf):
    s = tele.step_time_summary(t.step_log(spark, sf))
    return s.select(
        "run_id", "rank", "step_time_count", F.round("step_time_sum", 4).alias("step_time_sum"),
        F.round("step_time_mean", 6).alias("step_time_mean"),
    )


def q_grad_norm(spark, sf):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    norms = t.table(spark, sf, "embeddings").select(F.col("label").alias("step"), "vec_id", norm.alias("norm"))
    return tele.gradient_norm(norms).select("step", F.round("grad_norm", 6).alias("grad_norm"))


def q_val_mean(spark, sf):
    means = tele.validation_means(t.val_batches(spark, sf), ["run_id", "step"])
    return means.select("run_id", "step", "metric", F.round("mean", 6).alias("mean"), "num_batches")


def token_counts(batch: pa.Table, batch_id: int) -> dict[str, float]:
    """A validation step: real tokens and unmasked labels of a whole batch; a partial one reports nothing."""
    if batch.num_rows < 16:
        return {}
    labels = pc.list_flatten(batch["labels"])
    return {"tokens": pc.sum(pc.list_flatten(batch["attention_mask"])).as_py(), "unmasked": pc.sum(pc.not_equal(labels, -100)).as_py()}


def q_val_hook(spark, sf):
    """A validation step over the batches of stored validation shards."""
    root = scratch_dir(spark, "shards")
    cfg = doc_config(sf, output_dir=root, num_train_shards=3, num_val_shards=2, val_split_ratio=0.1, keep_position=True)
    total = sum(r["num_rows"] for r in preprocess(spark, cfg, DOC_FORMAT, ByteEncoder()).where(F.col("split") == VALIDATION).collect())
    rows = shards.read_all_shards(spark, root, keep_position=True).where(F.col("split") == VALIDATION)
    batches = b.with_batches(b.stored_order(rows, F.col("shard_id") * shard_size(total, 2)), 16)
    return validate(batches.drop("split", "epoch", "rn", "position"), token_counts, ["shard_id"])


def q_cross_rank(spark, sf):
    c = tele.across_ranks(t.step_log(spark, sf))
    return c.select(
        "run_id", "step", "tokens", F.round("duration", 4).alias("duration"), F.round("loss", 6).alias("loss"), "ranks"
    )


def q_accum_loss(spark, sf):
    return tele.accumulated_loss(t.micro_steps(spark, sf), 4).select(*STEP, F.round("loss", 6).alias("loss"))


def q_gauge_ffill(spark, sf):
    history = tele.gauge_history(t.step_log(spark, sf), ["step"], {"grad_norm": "grad_norm_gauge"})
    return history.select(*STEP, F.round("grad_norm_gauge", 6).alias("grad_norm_gauge"))


def q_gauge_ffill_sliced(spark, sf):
    """The same gauge with every group above 100 rows cut into slices, as groups above a million rows are."""
    history = tele.gauge_history(t.step_log(spark, sf), ["step"], {"grad_norm": "grad_norm_gauge"}, rows_per_slice=100)
    return history.select(*STEP, F.round("grad_norm_gauge", 6).alias("grad_norm_gauge"))


def q_pairs_sliced(spark, sf):
    return t.sft_pairs(spark, sf, rows_per_slice=3).select("conv_id", "turn", "instruction", "input", "output")


def q_gauge_latest(spark, sf):
    return tele.current_gauges(t.gauge_samples(spark, sf), ["ts", "event_id"])


def q_scrape_5s(spark, sf):
    return tele.scraped_gauges(t.gauge_samples(spark, sf), ["ts", "event_id"])


def q_scrape_standing(spark, sf):
    """Every five-second scrape of every gauge, whether or not it was set since the scrape before, told by the hour."""
    ticks = tele.standing_gauges(t.gauge_samples(spark, sf), ["ts", "event_id"])
    return ticks.groupBy("run_id", "rank", "metric", F.date_trunc("hour", "window_start").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("scrapes"), F.sum("samples").alias("samples"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.max_by("value", "window_start").alias("last"))


def q_resource_ffill(spark, sf):
    names = list(t.RESOURCE_OF_EVENT.values())
    return tele.resource_history(t.resource_samples(spark, sf), ["ts", "event_id"], names).select("event_id", "rank", *names)


def q_detect_rank(spark, sf):
    e = t.event_rows(spark, sf)
    kind = F.col("k") % 4
    rank = F.when(kind == 1, "x").when(kind == 2, F.col("rank").cast("string")).when(kind == 3, "1.5")
    slurm = F.when(F.col("k") % 3 == 0, F.format_string(" %d ", "user_id")).when(F.col("k") % 3 == 1, "")
    world = F.when(F.col("k") % 2 == 0, F.col("k").cast("string"))
    return e.select(
        "event_id", m.env_rank(rank, slurm).alias("rank"), m.env_world_size(world).alias("world_size")
    )


# --- streams -----------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: a plain path must be a folder, a pattern may name either."""
    schema = t.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def q_stream_scrape(spark, sf):
    root = scratch_dir(spark, "scrape")
    events = _stream(spark, sf, "events")
    samples = events.select(
        F.lit("run").alias("run_id"), F.pmod("user_id", F.lit(3)).cast("int").alias("rank"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("metric"), "value",
    )
    windows = stream_metrics.scrape_stream(samples, "1 minute", ["ts", "event_id"])
    stream_metrics.upsert_windows(windows, f"{root}/windows", f"{root}/state", available_now=True).awaitTermination()
    latest = stream_metrics.read_windows(spark, f"{root}/windows")
    return latest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def q_stream_scrape_triggers(spark, sf):
    """The scrape over four quarters in time order, one per trigger, with what the watermark lost (nothing) beside it."""
    root = scratch_dir(spark, "scrape")
    samples = t.gauge_samples(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = samples.select(F.percentile_approx("ts", [0.25, 0.5, 0.75]).alias("q")).first()["q"]
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = samples.where((F.lit(low is None) | (F.col("ts") > F.lit(low))) & (F.lit(high is None) | (F.col("ts") <= F.lit(high))))
        # as many files as the scan has tasks; each start of the stream takes what is new as one batch
        part.write.mode("append").parquet(f"{root}/in")
        windows = stream_metrics.scrape_stream(spark.readStream.schema(samples.schema).parquet(f"{root}/in"), "1 minute", ["ts", "event_id"])
        stream_metrics.upsert_windows(windows, f"{root}/windows", f"{root}/state", available_now=True).awaitTermination()
    latest = stream_metrics.read_windows(spark, f"{root}/windows")
    lost = stream_metrics.lost_samples(samples, latest, ["ts", "event_id"]).select(*t.RUN_METRIC, "window_start", "lost")
    joined = latest.join(lost, [*t.RUN_METRIC, "window_start"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    return joined.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def q_stream_scrape_late(spark, sf):
    """The scrape when the older half of the time span arrives after the newer one: its windows are closed, and what they lost is counted."""
    root = scratch_dir(spark, "scrape")
    samples = t.gauge_samples(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    middle = samples.select(F.call_function("div", F.min(at) + F.max(at), F.lit(2)).alias("m")).first()["m"]
    newer = at > F.lit(middle)
    for part in (samples.where(newer), samples.where(~newer)):
        part.write.mode("append").parquet(f"{root}/in")
        windows = stream_metrics.scrape_stream(spark.readStream.schema(samples.schema).parquet(f"{root}/in"), "1 minute", ["ts", "event_id"])
        stream_metrics.upsert_windows(windows, f"{root}/windows", f"{root}/state", available_now=True, merge_every=2).awaitTermination()
    latest = stream_metrics.read_windows(spark, f"{root}/windows")
    lost = stream_metrics.lost_samples(samples, latest, ["ts", "event_id"])
    both = latest.join(lost, [*t.RUN_METRIC, "window_start"], "full")
    return both.withColumns({
        "window_start": F.col("window_start").cast("timestamp_ntz"), "samples": F.coalesce("samples", F.lit(0)),
        "lost": F.coalesce("lost", F.lit(0))})


def q_stream_preprocess(spark, sf):
    root = scratch_dir(spark, "examples")
    raw = _stream(spark, sf, "documents")
    examples = stream_examples.example_stream(raw, ["doc_id"], DOC_FORMAT, ByteEncoder(), LENGTH, 8, SEED)
    stream_examples.append_examples(examples, f"{root}/examples", f"{root}/state", available_now=True).awaitTermination()
    return example_digests(spark.read.parquet(f"{root}/examples"), "doc_id", "shard_id")


def q_stream_slots(spark, sf):
    """All documents in three micro-batches, each after a restart, with gapless slots in each shard."""
    root = scratch_dir(spark, "slots")
    rows = docs_to_encode(spark, sf)
    for turn in range(3):
        # as many files as the scan has tasks; each start of the stream takes what is new as one batch
        rows.where(F.pmod("doc_id", F.lit(3)) == turn).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        stream_examples.append_numbered(
            stream, ["doc_id"], DOC_FORMAT, ByteEncoder(), LENGTH, 8, f"{root}/out", f"{root}/state", SEED, available_now=True,
        ).awaitTermination()
    return example_digests(stream_examples.read_numbered(spark, f"{root}/out"), "doc_id", "shard_id", "slot")


def q_metrics_callback(spark, sf):
    root = scratch_dir(spark, "payloads")
    t.step_log(spark, sf).write.parquet(f"{root}/steps")
    steps = spark.readStream.schema(spark.read.parquet(f"{root}/steps").schema).parquet(f"{root}/steps")

    def keep(payloads: DataFrame, batch_id: int) -> None:
        payloads.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    stream_metrics.publish_stream(steps, keep, f"{root}/state", available_now=True).awaitTermination()
    sent = spark.read.parquet(f"{root}/out").select(*STEP, F.explode("payload").alias("metric", "value"))
    return sent.select(*STEP, "metric", F.round("value", 4).alias("value"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("q_")}
