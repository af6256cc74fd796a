"""The given tables in the shapes the operators expect, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.operators.groups import ROWS_PER_SLICE, fill_forward, next_row, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("instruction"), F.col("source").alias("input"), F.col("text").alias("output")
    )


DOC_ROWS = "doc_rows AS (SELECT doc_id, lang AS instruction, source AS input, text AS output FROM documents)"


def sft_pairs(spark: SparkSession, sf_dir: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """A user turn and the assistant turn right after it; the system message in force is the input."""
    turns = table(spark, sf_dir, "conversations")
    system = F.when(F.col("role") == "system", F.col("text"))
    known = fill_forward(turns.withColumn("system", system), ["conv_id"], ["turn"], {"system": "system_text"}, rows_per_slice=rows_per_slice)
    paired = next_row(known, ["conv_id"], ["turn"], {"role": "next_role", "text": "next_text"}, rows_per_slice)
    return paired.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        "conv_id",
        "turn",
        F.col("text").alias("instruction"),
        F.coalesce("system_text", F.lit("")).alias("input"),
        F.col("next_text").alias("output"),
    )


SFT_PAIRS = """turns AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
         last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS system_text
  FROM conversations),
sft_pairs AS (
  SELECT conv_id, turn, text AS instruction, coalesce(system_text, '') AS input, next_text AS output
  FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("run_id"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("rank"),
        "user_id",
        "value",
        k.alias("k"),
    )


EVENT_ROWS = r"""event_rows AS (
  SELECT event_id, ts, event_type AS run_id, (user_id % 3)::INTEGER AS rank, user_id, value,
         regexp_extract(props, '"k": (\d+)', 1)::INTEGER AS k
  FROM events)"""


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the step log of several runs with three ranks each."""
    numbered = number_rows(event_rows(spark, sf_dir), ["run_id", "rank"], ["ts", "event_id"], "__n")
    return numbered.select(
        "run_id",
        "rank",
        (F.col("__n") + 1).alias("step"),
        "ts",
        "event_id",
        (F.col("value") / 20.0).alias("loss"),
        (F.col("k") / 100.0).alias("duration"),
        (F.col("k") * 16).cast("bigint").alias("tokens"),
        F.when(F.col("k") % 10 != 0, F.col("value") / 100.0).alias("grad_norm"),
    )


STEP_LOG = EVENT_ROWS + """,
step_log AS (
  SELECT run_id, rank, row_number() OVER (PARTITION BY run_id, rank ORDER BY ts, event_id) AS step, ts, event_id,
         value / 20.0 AS loss, k / 100.0 AS duration, (k * 16)::BIGINT AS tokens,
         CASE WHEN k % 10 <> 0 THEN value / 100.0 END AS grad_norm
  FROM event_rows)"""


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select(
        F.lit("run").alias("run_id"), "rank", "ts", "event_id", F.col("run_id").alias("metric"), "value"
    )


RUN_METRIC = ("run_id", "rank", "metric")

GAUGE_SAMPLES = EVENT_ROWS + """,
gauge_samples AS (SELECT 'run' AS run_id, rank, ts, event_id, run_id AS metric, value FROM event_rows)"""

# Which event type stands for which resource reading.
RESOURCE_OF_EVENT = {"click": "gpu", "view": "mem", "purchase": "cpu", "signup": "rss"}


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_rows(spark, sf_dir)
    readings = {name: F.when(F.col("run_id") == kind, F.col("value")) for kind, name in RESOURCE_OF_EVENT.items()}
    return events.withColumns(readings).select(
        F.lit("run").alias("run_id"), "rank", "ts", "event_id", *readings
    )


RESOURCE_SAMPLES = EVENT_ROWS + ", resource_samples AS (SELECT 'run' AS run_id, rank, ts, event_id, " + ", ".join(
    f"CASE WHEN run_id = '{kind}' THEN value END AS {name}" for kind, name in RESOURCE_OF_EVENT.items()
) + " FROM event_rows)"


def val_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_rows(spark, sf_dir)
    reported = F.when(F.col("k") % 10 != 0, F.create_map("run_id", "value")).otherwise(
        F.create_map().cast("map<string,double>")
    )
    return events.select(
        F.col("rank").alias("run_id"), F.floor(F.col("event_id") / 10).alias("step"), reported.alias("metrics")
    )


def micro_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select(
        "run_id",
        "rank",
        F.floor(F.col("event_id") / 4).alias("step"),
        F.pmod("event_id", F.lit(4)).alias("micro"),
        (F.col("value") / 20.0).alias("loss"),
    )


def log_lines(steps: DataFrame) -> DataFrame:
    """Log lines of the step log: its metric messages, and a continuation line after some of them."""
    from quillshard.sources.runlogs import log_line, metric_message

    message = metric_message(F.col("step"), {"train_loss": F.col("loss"), "grad_norm": F.col("grad_norm")})
    level = F.when(F.col("loss") > 5, "WARNING").otherwise("INFO")
    line = log_line(F.col("ts"), level, F.col("rank"), F.lit(3), F.col("run_id"), message)
    continuation = F.when(F.col("step") % 5 == 0, F.array(F.lit("  step: more"))).otherwise(F.array().cast("array<string>"))
    return steps.select(
        "run_id", "event_id", F.explode(F.concat(F.array(line), continuation)).alias("value")
    )


# Lines that look like records and are none: no time, an impossible time, no rank, a rank that is no number.
BAD_LOG_LINES = [
    "foo bar | INFO     | rank  0/1  | train | hi",
    "2024-13-45 00:00:00.000 | INFO     | rank  0/1  | train | hi",
    "2024-01-01 00:00:00.000 | INFO     | rank  0  | train | hi",
    "2024-01-01 00:00:00.000 | INFO     | rank  x/1  | train | hi",
]
