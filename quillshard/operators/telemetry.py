"""Step metrics, gauges and validation means as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillshard.functions.metrics import per_second, perplexity, step_duration
from quillshard.operators.groups import ROWS_PER_SLICE, fill_forward, join_on, next_row

# Fixed value: seconds between two reads of the gauges.
SCRAPE_SECONDS = 5
RUN = ["run_id", "rank"]
# An interval is cut into at most this many pieces at a time, and as many times as 170 years of scrapes take.
_PIECE, _LEVELS = 1024, 3


def step_metrics(steps: DataFrame) -> DataFrame:
    """Derived metrics of each step: perplexity, rates, and the payload form of the gradient norm."""
    return steps.withColumns(
        {
            "perplexity": perplexity(F.col("loss")),
            "step_duration": step_duration(F.col("duration")),
            "steps_per_second": per_second(F.lit(1.0), F.col("duration")),
            "tokens_per_second": per_second(F.col("tokens"), F.col("duration")),
            "grad_norm_payload": F.coalesce("grad_norm", F.lit(0.0)),
        }
    )


def metric_payload() -> Column:
    """The name -> value map handed to a metrics callback, from ``step_metrics`` columns."""
    columns = {
        "loss": "loss",
        "perplexity": "perplexity",
        "grad_norm": "grad_norm_payload",
        "step_duration": "step_duration",
        "steps_per_second": "steps_per_second",
        "tokens_per_second": "tokens_per_second",
    }
    return F.create_map(*[x for name, col in columns.items() for x in (F.lit(name), F.col(col))])


def published(steps: DataFrame) -> DataFrame:
    """Only rank 0 publishes, and only once a loss exists."""
    return steps.where((F.col("rank") == 0) & F.col("loss").isNotNull())


def every_n_steps(steps: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("a logging cadence must be a positive number of steps")
    return steps.where(F.col("step") % n == 0)


def validation_steps(steps: DataFrame, val_every: int | None) -> DataFrame:
    """Steps after which validation runs; none without a cadence."""
    if val_every is None:
        return steps.where(F.lit(False))
    return steps.where((F.col("step") > 0) & (F.col("step") % val_every == 0))


def executed_steps(steps: DataFrame, max_steps: int | None) -> DataFrame:
    """Steps that run under ``max_steps``; the check comes after a step, so one always runs."""
    return steps if max_steps is None else steps.where(F.col("step") <= max(1, max_steps))


def step_time_summary(steps: DataFrame) -> DataFrame:
    observed = step_duration(F.col("duration"))
    return steps.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("step_time_count"),
        F.sum(observed).alias("step_time_sum"),
        F.avg(observed).alias("step_time_mean"),
    )


def gradient_norm(norms: DataFrame) -> DataFrame:
    """Global L2 norm per step from per-parameter norms; null where no parameter has one."""
    return norms.groupBy("step").agg(F.sqrt(F.sum(F.col("norm") * F.col("norm"))).alias("grad_norm"))


def validation_means(batches: DataFrame, group_by: list[str], metrics: str = "metrics") -> DataFrame:
    """Mean of each metric over the batches that reported anything.

    The divisor counts every batch with a non-empty map, also those that lack the metric. Sums and
    divisor come from one scan: each such batch adds one entry without a name.
    """
    reported = batches.where(F.size(metrics) > 0)
    marker = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(1.0).alias("value")))
    entries = reported.select(*group_by, F.explode(F.concat(F.map_entries(metrics), marker)).alias("e"))
    sums = entries.groupBy(*group_by, F.col("e.key").alias("metric")).agg(F.sum("e.value").alias("total"))
    # by now there is one row per metric name, so collecting them per validation is small
    rows = F.collect_list(F.when(F.col("metric").isNotNull(), F.struct("metric", "total")))
    divisor = F.max(F.when(F.col("metric").isNull(), F.col("total")))
    folded = sums.groupBy(*group_by).agg(rows.alias("rows"), divisor.alias("num_batches"))
    each = folded.select(*group_by, "num_batches", F.explode("rows").alias("r"))
    return each.select(
        *group_by,
        F.col("r.metric").alias("metric"),
        (F.col("r.total") / F.col("num_batches")).alias("mean"),
        F.col("num_batches").cast("bigint").alias("num_batches"),
    )


def across_ranks(steps: DataFrame) -> DataFrame:
    """One row per run and step over all ranks."""
    return steps.groupBy("run_id", "step").agg(
        F.sum("tokens").alias("tokens"),
        F.max(step_duration(F.col("duration"))).alias("duration"),
        F.avg("loss").alias("loss"),
        F.count(F.lit(1)).alias("ranks"),
    )


def accumulated_loss(micro_steps: DataFrame, accumulation: int) -> DataFrame:
    """Loss of a step as the sum of its micro-step losses, each divided by the accumulation count."""
    return micro_steps.groupBy(*RUN, "step").agg(F.sum(F.col("loss") / accumulation).alias("loss"))


def gauge_history(
    steps: DataFrame, order_by: list[str], columns: dict[str, str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """What a gauge shows after each step: its last value set so far, 0 before the first."""
    return fill_forward(steps, RUN, order_by, columns, initial=0.0, rows_per_slice=rows_per_slice)


def current_gauges(samples: DataFrame, order_by: list[str]) -> DataFrame:
    """The latest value of each gauge."""
    return samples.groupBy(*RUN, "metric").agg(F.max_by("value", F.struct(*order_by)).alias("value"))


def scraped_gauges(samples: DataFrame, order_by: list[str], seconds: int = SCRAPE_SECONDS) -> DataFrame:
    """The last value of each gauge in every scrape interval that has one."""
    window = F.window("ts", f"{seconds} seconds")
    return samples.groupBy(*RUN, "metric", window.alias("w")).agg(
        F.max_by("value", F.struct(*order_by)).alias("value"), F.count(F.lit(1)).alias("samples")
    ).select(*RUN, "metric", F.col("w.start").alias("window_start"), "value", "samples")


def standing_gauges(
    samples: DataFrame, order_by: list[str], seconds: int = SCRAPE_SECONDS, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """What every scrape of a run and rank reads, from a gauge's first sample on: a gauge keeps its value between sets.

    A scraped value is an interval, up to the gauge's next one or through the last scrape in which the run and rank set any
    gauge; ``samples`` is 0 at its ticks without a new sample. An interval is cut into up to
    a thousand pieces, and these again, until the pieces are single ticks, so no array grows with time, and the pieces of a long one are dealt out to all tasks.
    """
    scraped = scraped_gauges(samples, order_by, seconds)
    ends = scraped.groupBy(*RUN).agg(F.max("window_start").alias("__end"))
    followed = next_row(scraped, [*RUN, "metric"], ["window_start"], {"window_start": "__next"}, rows_per_slice)
    spans = join_on(followed, ends, RUN, bounded=False)
    until = F.coalesce(F.col("__next"), F.col("__end") + F.make_dt_interval(secs=F.lit(seconds)))
    # a difference of wall-clock times, whatever the session's time zone
    lasts = (until - F.col("window_start")).cast("interval second").cast("decimal(18,6)")
    pieces = spans.withColumns({"__from": F.lit(0).cast("bigint"), "__ticks": (lasts / seconds).cast("bigint")}).drop("__next", "__end")
    for level in range(_LEVELS - 1, -1, -1):
        width = _PIECE**level
        cut = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("__ticks") - 1, F.lit(width).cast("bigint")))
        cut = pieces.withColumn("__at", F.explode(cut))
        left = F.least(F.lit(width).cast("bigint"), F.col("__ticks") - F.col("__at") * width)
        pieces = cut.withColumns({"__from": F.col("__from") + F.col("__at") * width, "__ticks": left}).drop("__at")
        if level == 1:
            # an interval without end is pieces by now; even ones go to all tasks
            pieces = pieces.hint("rebalance")
    step = F.make_dt_interval(secs=F.col("__from") * seconds)
    return pieces.select(
        *RUN, "metric", (F.col("window_start") + step).alias("window_start"), "value",
        F.when(F.col("__from") == 0, F.col("samples")).otherwise(F.lit(0).cast("bigint")).alias("samples"))


def resource_history(
    samples: DataFrame, order_by: list[str], columns: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Resource readings where a failed probe leaves its last reading standing."""
    return fill_forward(samples, RUN, order_by, {c: c for c in columns}, initial=0.0, rows_per_slice=rows_per_slice)
