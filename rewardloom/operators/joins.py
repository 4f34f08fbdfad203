"""Joins of rollouts with prompts, statistics, baselines and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.plans.scale import carry_forward, keyed_join


def with_prompts(rollouts: DataFrame, prompts: DataFrame, key: str = "uid") -> DataFrame:
    """Ground truth and source travel with each rollout (n to 1)."""
    return rollouts.join(prompts, key)


def positional(left: DataFrame, right: DataFrame, idx: str = "row_idx") -> DataFrame:
    """Row-by-row join of two tables with the same row order."""
    return left.join(right, idx)


def keep_groups(df: DataFrame, kept: DataFrame, key: str = "uid") -> DataFrame:
    return keyed_join(df, kept.select(key).distinct(), [key], "left_semi")


def unmatched(df: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keyed_join(df, matched, list(keys), "left_anti")


def paired_generations(forward: DataFrame, inverse: DataFrame, keys: Sequence[str] = ("uid", "rollout_n")) -> DataFrame:
    """Forward and time-reversed answers side by side."""
    rest = [c for c in inverse.columns if c not in keys]
    return forward.join(inverse.withColumnsRenamed({c: f"inverse_{c}" for c in rest}), list(keys))


def with_baseline(df: DataFrame, greedy: DataFrame, key: str = "uid", score: str = "score") -> DataFrame:
    """Greedy-decode score of the prompt; 0 where none was sampled."""
    base = greedy.groupBy(key).agg(F.avg(score).alias("baseline"))
    return keyed_join(df, base, [key], "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))


def as_of(samples: DataFrame, versions: DataFrame, ts: str, version: str, out: str = "current_version", by: Sequence[str] = ()) -> DataFrame:
    """Version in force at each sample's time: the last one at or before it (per ``by``), null before the first.

    Changes and samples are one series in the order of time; what holds is carried forward along it, inside key ranges and
    from the ranges before. Of changes at one time the largest version holds; changes without a time never do, and samples without
    one are kept with no version.
    """
    change = versions.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(F.max(version).alias("__v"))
    both = samples.withColumn("__kind", F.lit(1)).unionByName(change.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    known = carry_forward(both, by, [ts, "__kind"], F.col("__v"), out)
    return known.where(F.col("__kind") == 1).drop("__kind", "__v")


def query_corpus(queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    from rewardloom.operators.retrieve import dense_topk

    return dense_topk(queries, corpus, **options)

