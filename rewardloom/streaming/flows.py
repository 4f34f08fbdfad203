"""Streaming reports and flows built from the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.operators.balance import balance_partitions
from rewardloom.operators.reduce import partial_rollout_stats, percentile_report, step_rule, workload
from rewardloom.plans.scale import keyed_join
from rewardloom.session import ensure_checkpoint_dir


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is there, through a Parquet sink with its own checkpoint, and read the result."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Process what is there with a function per micro-batch; retried batches carry the same id."""
    folder = folder or work_folder(stream.sparkSession)
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()


# ---------------------------------------------------------------- staleness


def with_staleness(df: DataFrame, current: Column, version: str = "param_version") -> DataFrame:
    return df.withColumn("lag", current - F.col(version)).withColumn("stale", F.col("lag") >= 1)


def staleness(df: DataFrame, current: Column, version: str = "param_version", by: tuple[str, ...] = (), trajectories: Column | None = None):
    """Samples and trajectories at least one version behind, and the widest lag."""
    size = trajectories if trajectories is not None else F.lit(1)
    return with_staleness(df, current, version).groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("stale").cast("long")).alias("stale_samples"),
        F.sum(F.when(F.col("stale"), size).otherwise(0)).cast("long").alias("stale_trajectories"), F.max("lag").alias("max_lag"),
    )


def staleness_budget(df: DataFrame, queue_size: str, stale: str, max_queue: int, required: int, threshold: float, sync_steps: int):
    """Whether production should pause: queue full, or stale samples past the budget."""
    budget = int(required * (1 + threshold) * sync_steps)
    return df.withColumn("pause", (F.col(queue_size) >= max_queue) | (F.col(stale) >= budget)).withColumn("budget", F.lit(budget))


# ---------------------------------------------------------------- windows and metrics


def step_metrics_stream(stream: DataFrame, sync_steps: int) -> DataFrame:
    """METRICS rows reduced by rule per window of ``sync_steps`` steps."""
    g = stream.groupBy(F.floor(F.col("step") / sync_steps).alias("sync"), "key").agg(
        F.max_by("value", "step").alias("last"), F.sum("value").alias("sum"), F.avg("value").alias("avg"),
        F.max("value").alias("max"), F.min("value").alias("min"),
    )
    rule = step_rule(F.col("key"))
    value = F.when(rule == "last", F.col("last")).when(rule.isin("sum", "time_sum"), F.col("sum")).when(
        rule == "max", F.col("max")).when(rule == "min", F.col("min")).otherwise(F.col("avg"))
    return g.select("sync", "key", rule.alias("rule"), value.alias("value"))


def sliding_rate(stream: DataFrame, ts: str, by: str, width: str = "1 minute", slide: str = "10 seconds", delay: str = "1 minute"):
    """Events per sliding window."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), by, "n")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of events without a longer pause."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def validation_stream(stream: DataFrame, flag: str = "validate") -> tuple[DataFrame, DataFrame]:
    """Training and validation channels of one stream."""
    on = F.coalesce(F.col(flag), F.lit(False))
    return stream.where(~on), stream.where(on)


# ---------------------------------------------------------------- flows


def stream_dynamic_sampling(
    groups: DataFrame, prompts: int, max_batches: int | None = None, folder: str | None = None
) -> DataFrame:
    """Groups with varying scores (or a lone rollout) collected batch by batch until the target is met.

    ``groups`` is the output of ``complete_groups``. Survivors are written per micro-batch id, so a
    retried batch replaces its own rows; the first ``prompts`` by uid order of arrival are returned.
    What is known of earlier batches is read from the folder: a restart with the same folder goes on
    where it stopped.
    """
    spark = groups.sparkSession
    folder = folder or work_folder(spark)
    spread = lambda s: F.array_max(s) != F.array_min(s)
    kind = groups.withColumn("batch_id", F.lit(0).cast("long"))
    spark.createDataFrame([], kind.schema).write.mode("append").parquet(f"{folder}/kept/start")

    def survivors() -> DataFrame:
        return spark.read.schema(kind.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/kept")

    def collect(batch: DataFrame, batch_id: int) -> None:
        earlier = survivors().where(F.col("batch_id") < batch_id).agg(F.count("*").alias("rows")).first()
        if earlier["rows"] >= prompts:
            # The batch still has to run, or its state would not be committed.
            batch.write.format("noop").mode("overwrite").save()
            return
        if max_batches is not None and batch_id >= max_batches:
            raise RuntimeError(f"only {earlier['rows']} of {prompts} prompts after {max_batches} batches")
        kept = batch.where(F.col("complete") & (spread(F.col("scores")) | (F.col("n") == 1)))
        kept.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/kept/batch={batch_id}")

    run_batches(groups, collect, folder)
    return survivors().orderBy("batch_id", "uid").limit(prompts)


def assemble_batch(batch: DataFrame, batch_id: int, row: str, length: str, k: int, current_version: int, version: str = "param_version"):
    """One training batch of a micro-batch: balanced parts, timing percentiles and version spread."""
    rows = batch.withColumn("batch_id", F.lit(batch_id)).withColumn("work", workload(F.col(length)))
    parts = balance_partitions(rows, "batch_id", row, "work", k, equal_size=False)
    report = percentile_report(rows, length).withColumn("batch_id", F.lit(batch_id))
    spans = partial_rollout_stats(rows.withColumn("now", F.lit(current_version)), version, "now", version).withColumn("batch_id", F.lit(batch_id))
    return keyed_join(rows, parts, ["batch_id", row]), report, spans
