"""Run logs, metric messages and run summaries as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The layout of a log line and of a metric message.
LOG_SEPARATOR = r" \| "
METRIC_STEP = r"^\[step [0-9]{1,18}\] "
LOG_TIME = "yyyy-MM-dd HH:mm:ss.SSS"
LOG_FILES = "*_rank_*.log*"

# The fields of a stored run summary.
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField(
            "config",
            T.StructType(
                [
                    T.StructField("model_name", T.StringType()),
                    T.StructField("data_dir", T.StringType()),
                    T.StructField("trainer_class", T.StringType()),
                    T.StructField("batch_size", T.LongType()),
                    T.StructField("val_batch_size", T.LongType()),
                    T.StructField("num_epochs", T.LongType()),
                    T.StructField("lr", T.DoubleType()),
                    T.StructField("weight_decay", T.DoubleType()),
                    T.StructField("warmup_ratio", T.DoubleType()),
                    T.StructField("output_dir", T.StringType()),
                    T.StructField("use_lora", T.BooleanType()),
                    T.StructField(
                        "lora",
                        T.StructType(
                            [
                                T.StructField("r", T.LongType()),
                                T.StructField("alpha", T.LongType()),
                                T.StructField("dropout", T.DoubleType()),
                                T.StructField("target_modules", T.ArrayType(T.StringType())),
                            ]
                        ),
                    ),
                    T.StructField("train_shard_template", T.StringType()),
                    T.StructField("val_shard_template", T.StringType()),
                    # free-form settings of the training engine stay JSON text
                    T.StructField("deepspeed_config", T.StringType()),
                    T.StructField("metrics_port", T.LongType()),
                    T.StructField("max_steps", T.LongType()),
                    T.StructField("log_every_n_steps", T.LongType()),
                ]
            ),
        ),
        T.StructField("global_step", T.LongType()),
        T.StructField("total_time_seconds", T.DoubleType()),
    ]
)


def log_line(ts: Column, level: Column, rank: Column, world_size: Column, process: Column, message: Column) -> Column:
    """A record in the log line layout."""
    return F.concat_ws(
        " | ",
        F.date_format(ts, LOG_TIME),
        F.rpad(level, 8, " "),
        F.concat(F.lit("rank "), F.format_string("%2d", rank), F.lit("/"), F.format_string("%-2d", world_size)),
        process,
        message,
    )


def metric_message(step: Column, metrics: dict[str, Column]) -> Column:
    """A metric message; metrics that are null are left out."""
    pairs = [F.when(v.isNotNull(), F.format_string(f"{k}=%.4f", v)) for k, v in metrics.items()]
    return F.concat(F.lit("[step "), step.cast("string"), F.lit("] "), F.concat_ws(" ", *pairs))


def read_run_logs(spark: SparkSession, root: str, files: str = LOG_FILES) -> DataFrame:
    """Every rank's log files below ``root``, one row per record, with the file it came from."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .text(root)
        .withColumn("file", F.col("_metadata.file_name"))
    )
    return parse_log_lines(lines)


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines as typed columns. Lines that are no record are in ``other_log_lines``."""
    other = [F.col(c) for c in lines.columns if c != column]
    fields = ("ts", "level", "rank", "world_size", "process", "message")
    found = _log_fields(lines, column).where(F.col("__log.message").isNotNull())
    return found.select(*other, *[F.col(f"__log.{f}").alias(f) for f in fields])


def read_log_records(
    spark: SparkSession, root: str, files: str = LOG_FILES, log: Column | None = None, turn: Column | None = None
) -> DataFrame:
    """Every record below ``root`` with all its lines: ``log``, the fields of its first line, and ``body``.

    ``body`` is the text of the continuation lines that follow, joined by line ends, and null without any. Lines come in file order inside
    a split, so records are put together where a split is read; only the lines before a split's first record travel, to
    the last record of the nearest split before it that has one. Splits are in order of file and place, and the files of one log
    follow each other as they were rotated, so a record goes on over both borders. Results do not depend on the split size.

    A file belongs to the log named before ``.log`` up to its rank; what its name holds between is when it was rotated away, and
    the file without it is the newest. ``log`` and ``turn`` (sorted, null last) are these as columns of ``_metadata``. Lines before
    the first record of a log are a row of their own, with the fields null.
    """
    name = F.col("_metadata.file_name")
    log = F.regexp_extract(name, r"^(.*_rank_[0-9]+)", 1) if log is None else log
    rotated = F.regexp_extract(name, r"^.*_rank_[0-9]+[._-]?(.*?)[.]?log", 1)
    turn = F.when(rotated != "", rotated) if turn is None else turn
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(root)
    placed = lines.select(
        "value", log.alias("log"), F.struct(turn.isNull().alias("newest"), turn.alias("turn"), F.col("_metadata.file_path").alias("path"),
                                            F.col("_metadata.file_block_start").alias("start")).alias("split"))
    marked = _log_fields(placed, "value").withColumn("opens", F.col("__log.message").isNotNull()).drop("__log")
    schema = T.StructType([f for f in placed.schema if f.name != "value"] + [
        T.StructField("nth", T.LongType()), T.StructField("value", T.StringType()), T.StructField("body", T.StringType())])
    pieces = marked.select("log", "split", "value", "opens").mapInArrow(_record_batches, schema)
    # one row for each split: its last record, and the lines that another split's record goes on with
    ends = pieces.groupBy("log", "split").agg(
        F.max("nth").alias("last"), F.max(F.when(F.col("nth") == 0, F.col("body"))).alias("head"))
    before = Window.partitionBy("log").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("last") > 0, F.struct("split", "last")), ignorenulls=True).over(before)
    heads = ends.withColumn("owner", owner).where(F.col("head").isNotNull())
    tails = heads.groupBy("log", F.col("owner.split").alias("split"), F.col("owner.last").alias("nth")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "head"))), lambda x: x["head"]), "\n").alias("tail"))
    owned = pieces.where(F.col("nth") > 0).join(tails.where(F.col("nth").isNotNull()), ["log", "split", "nth"], "left")
    whole = F.when(F.col("tail").isNull(), F.col("body")).when(F.col("body").isNull(), F.col("tail")).otherwise(F.concat_ws("\n", "body", "tail"))
    records = parse_log_lines(owned.select("log", "value", whole.alias("body")))
    orphans = tails.where(F.col("nth").isNull()).select("log", F.col("tail").alias("body"))
    return records.unionByName(orphans, allowMissingColumns=True)


def _record_batches(batches):
    """Records of each split with the lines that follow them there; ``nth`` counts from 1, and 0 holds the lines before."""
    at = first = None
    nth, rest = 0, []
    out: list[tuple] = []

    def close():
        if nth or rest:
            out.append((*at, nth, first, "\n".join(rest) if rest else None))

    for batch in batches:
        columns = [batch.column(c) for c in ("log", "split")]
        rows = zip(*(c.to_pylist() for c in columns), batch.column("value").to_pylist(), batch.column("opens").to_pylist(), strict=True)
        for log, split, value, opens in rows:
            if (log, split) != at:
                if at is not None:
                    close()
                at, nth, first, rest = (log, split), 0, None, []
            if opens:
                close()
                nth, first, rest = nth + 1, value, []
            else:
                rest.append(value)
        if out:
            yield _record_batch(out, columns)
            out = []
    if at is not None:
        close()
        if out:
            yield _record_batch(out, columns)


def _record_batch(rows: list[tuple], like: list[pa.Array]) -> pa.RecordBatch:
    types = [*(c.type for c in like), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["log", "split", "nth", "value", "body"])


def other_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are no record: continuations of the record before them, and malformed lines, as they are."""
    return _log_fields(lines, column).where(F.col("__log.message").isNull()).select(*lines.columns)


def _log_fields(lines: DataFrame, column: str) -> DataFrame:
    """Adds ``__log``, the fields of a record, null where a part does not fit.

    The line is split where an array is exploded, and Spark carries what a generator gave out as a value, so that the fields
    and every filter on them see one split instead of copies of it.
    """
    split = lines.withColumn("__parts", F.explode(F.array(F.split(F.col(column), LOG_SEPARATOR, 5))))
    part = lambda i: F.get("__parts", F.lit(i))
    read = F.struct(
        part(0).try_cast("timestamp_ntz").alias("ts"), F.rtrim(part(1)).alias("level"),
        F.split(F.trim(F.substring(part(2), 6, 40)), "/", -1).alias("ranks"))
    known = split.withColumn("__read", F.explode(F.array(read)))
    ranks = F.col("__read.ranks")
    counts = F.struct(F.get(ranks, F.lit(0)).try_cast("int").alias("rank"), F.get(ranks, F.lit(1)).try_cast("int").alias("size"))
    counted = known.withColumn("__counts", F.explode(F.array(counts)))
    ts, level, rank, size = F.col("__read.ts"), F.col("__read.level"), F.col("__counts.rank"), F.col("__counts.size")
    fits = (
        (F.size("__parts") == 5) & ts.isNotNull() & part(0).contains(" ") & part(2).startswith("rank ")
        & (F.size(ranks) == 2) & (rank >= 0) & (size >= 0) & level.rlike(r"^\w+$") & part(3).rlike(r"^\S+$")
    )
    log = F.when(fits, F.struct(
        ts.alias("ts"), level.alias("level"), rank.alias("rank"), size.alias("world_size"),
        part(3).alias("process"), part(4).alias("message")))
    return counted.withColumn("__log", F.explode(F.array(log))).drop("__parts", "__read", "__counts")


def parse_metric_messages(records: DataFrame, column: str = "message") -> DataFrame:
    """Metric messages as a long table: one row per (record, metric)."""
    other = [F.col(c) for c in records.columns if c != column]
    found = records.where(F.col(column).rlike(METRIC_STEP))
    words = found.select(*other, F.split(F.col(column), " ").alias("__words"))
    step = F.rtrim(F.get("__words", F.lit(1)), F.lit("]")).cast("bigint")
    pairs = words.select(*other, step.alias("step"), F.explode(F.slice("__words", F.lit(3), F.size("__words"))).alias("__pair"))
    # a name may itself hold '=', so the value is what follows the last one
    value = F.substring_index("__pair", "=", -1)
    return pairs.where(F.col("__pair").contains("=")).select(
        *other,
        "step",
        F.substring(F.col("__pair"), F.lit(1), F.length("__pair") - F.length(value) - 1).alias("metric"),
        value.try_cast("double").alias("value"),
    )


def write_run_summaries(runs: DataFrame, root: str, run_column: str = "run_id") -> None:
    """One summary folder per run: ``config``, ``global_step`` and ``total_time_seconds`` as JSON."""
    runs.select(run_column, "config", "global_step", "total_time_seconds").write.mode("overwrite").option(
        "ignoreNullFields", False
    ).partitionBy(run_column).json(root)


def read_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries (a glob over ``summary.json`` files, or a folder of runs), one row per run."""
    return spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(path)
