"""Job bookkeeping: state counts, batch metrics, latencies, failures, usage cost."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.functions import vocab
from merchlens.functions.numbers import money_sum, ratio
from merchlens.functions.text import bind, strip
from merchlens.operators.ranks import exact_quantiles

DURATION_DEFAULT_MS = 2500.0
DURATION_HISTORY = 25
SAMPLE_IDS = 5


def job_status_counts(items: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Per job: items by state and, given ``total_duration_ms``, seconds left."""

    def state(name: str) -> Column:
        return F.count_if(F.col("state") == name)

    counts = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        state("enriched").alias("enriched"),
        state("failed").alias("failed"),
        state("pending_enrich").alias("queued"),
    ).withColumn("processed", F.col("enriched") + F.col("failed"))
    if durations is None:
        return counts
    rate = F.try_divide(F.col("processed"), F.nullif(F.col("total_duration_ms"), F.lit(0.0)) / 1000.0)
    eta = F.when((F.col("queued") > 0) & (rate > 0), F.col("queued") / rate)
    return counts.join(durations, "job_id", "left").withColumn("eta_estimate", eta)


def batch_metrics(facts: DataFrame) -> DataFrame:
    """Rows, duration and throughput of each (job, batch)."""
    per_batch = facts.groupBy("job_id", "batch_no").agg(
        F.count(F.lit(1)).alias("rows"), money_sum(F.col("duration_ms")).alias("duration_ms")
    )
    return per_batch.withColumn(
        "throughput", ratio(F.col("rows") * 1000.0, F.col("duration_ms"))
    )


def recent_metrics(metrics: DataFrame, n: int = 50, newest: str | None = None) -> DataFrame:
    """The ``n`` newest batches by the column ``newest``, else by job; ties by job and batch."""
    first = [F.desc(newest)] if newest else []
    return metrics.orderBy(*first, F.desc("job_id"), F.desc("batch_no")).limit(n)


def import_history(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` imports created last; of those created together, larger ids first.

    A top-k: each task hands on ``n`` rows, nothing is sorted as a whole.
    """
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def latency_summary(df: DataFrame, latency: str, wall_seconds: float, groups: list[str] | None = None) -> DataFrame:
    """Requests, exact p50 / p95 (interpolated), total and effective concurrency."""
    groups = groups or []
    spread = exact_quantiles(df, latency, {"p50": 0.5, "p95": 0.95}, groups)
    totals = df.groupBy(*groups).agg(money_sum(F.col(latency)).alias("total"))
    joined = spread.join(totals, groups) if groups else spread.withColumn("total", totals.select("total").scalar())
    return joined.withColumnRenamed("n", "requests").withColumn(
        "concurrency_eff", F.bround(F.col("total") / F.lit(max(wall_seconds, 1e-6)), 2)
    )


def size_bucket(total: Column) -> Column:
    """The smallest bucket a job size fits in, the largest for anything above."""
    *steps, largest = vocab.DURATION_BUCKETS
    bucket = F.when(total <= 0, 0)
    for step in steps:
        bucket = bucket.when(total <= step, step)
    return bucket.otherwise(largest)


def duration_estimate(runs: DataFrame) -> DataFrame:
    """Milliseconds per item and bucket: median of the last 25 runs, 2500 without any.

    ``runs`` holds ``run_id, total, duration_ms``. The row limit per bucket is applied
    before the shuffle.
    """
    spark = runs.sparkSession
    usable = runs.where((F.col("total") > 0) & (F.col("duration_ms") > 0)).select(
        size_bucket(F.col("total")).alias("bucket"),
        (F.col("duration_ms") / F.col("total")).alias("per_item"),
        "run_id",
    )
    newest = Window.partitionBy("bucket").orderBy(F.desc("run_id"))
    recent = usable.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= DURATION_HISTORY)
    medians = recent.groupBy("bucket").agg(
        F.percentile("per_item", 0.5).alias("ms_per_item"), F.count(F.lit(1)).alias("runs")
    )
    buckets = spark.createDataFrame([(b,) for b in vocab.DURATION_BUCKETS], "bucket int")
    return buckets.join(medians, "bucket", "left").select(
        "bucket",
        F.coalesce("ms_per_item", F.lit(DURATION_DEFAULT_MS)).alias("ms_per_item"),
        F.coalesce("runs", F.lit(0)).alias("runs"),
    )


def failure_code(reason: Column) -> Column:
    """Struct of code and whether a retry may help, by the first rule that matches."""

    def payload(code: str, retryable: bool) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(retryable).alias("retryable"))

    def classify(text: Column) -> Column:
        result = F.when(text == "", payload(*vocab.FAILURE_EMPTY))
        for code, retryable, groups in vocab.FAILURE_RULES:
            hits = [reduce(lambda a, b: a | b, [text.contains(w) for w in words]) for words in groups]
            result = result.when(reduce(lambda a, b: a & b, hits), payload(code, retryable))
        return result.otherwise(payload(*vocab.FAILURE_OTHER))

    return bind(F.lower(strip(F.coalesce(reason, F.lit("")))), classify)


def failure_summary(failures: DataFrame, reason: str = "reason", key: str = "id", samples: int = SAMPLE_IDS) -> DataFrame:
    """Count, retry flag, explanation, remedy and the smallest few ids per failure code.

    Counts combine map-side; the sample is a top-k per code, limited before the shuffle.
    """
    coded = failures.select(F.col(key).alias("id"), failure_code(F.col(reason)).alias("f")).select("id", "f.*")
    counts = coded.groupBy("code", "retryable").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("code").orderBy("id")
    first = coded.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= samples)
    lists = first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    texts = [(F.lit(code), F.struct(*map(F.lit, text))) for code, text in vocab.FAILURE_TEXTS.items()]
    text = F.element_at(F.create_map(*(c for pair in texts for c in pair)), F.col("code"))
    told = counts.withColumn("message", text["col1"]).withColumn("remedy", text["col2"])
    return told.join(lists, "code")


def usage_cost(df: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Adds ``tokens_in``, ``tokens_out`` and ``cost`` from usage fields with fall-backs.

    Prompt: prompt, input, in or total tokens. Completion: completion, output, out, or the
    total less the prompt.
    """

    def read(name: str) -> Column:
        return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")

    def filled(name: str) -> Column:
        return F.nullif(read(name), F.lit(0.0))

    total = read("total_tokens")
    prompt = F.coalesce(read("prompt_tokens"), filled("input_tokens"), read("tokens_in"), total)
    rest = F.when(prompt.isNotNull(), F.greatest(F.lit(0.0), F.coalesce(total, F.lit(0.0)) - prompt))
    completion = F.coalesce(read("completion_tokens"), filled("output_tokens"), read("tokens_out"), rest)
    tokens_in, tokens_out = F.coalesce(prompt, F.lit(0.0)), F.coalesce(completion, F.lit(0.0))
    cost = tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out
    return df.withColumn("tokens_in", tokens_in).withColumn("tokens_out", tokens_out).withColumn("cost", cost)


def usage_totals(costed: DataFrame, groups: list[str]) -> DataFrame:
    return costed.groupBy(*groups).agg(
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        money_sum(F.col("cost")).alias("cost"),
    )


def expire_stale_jobs(jobs: DataFrame, now: datetime, minutes: int) -> DataFrame:
    """Pending jobs created at or before the cut-off become errors."""
    stale = (F.col("status") == "pending") & (F.col("created_at") <= F.lit(now - timedelta(minutes=minutes)))
    stale = F.coalesce(stale, F.lit(False))
    return jobs.withColumn("error", F.when(stale, "server restarted").otherwise(F.col("error"))).withColumn(
        "updated_at", F.when(stale, F.lit(now)).otherwise(F.col("updated_at"))
    ).withColumn("status", F.when(stale, "error").otherwise(F.col("status")))
