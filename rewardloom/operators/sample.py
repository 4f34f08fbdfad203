"""Sorts, limits, sampling, mixing and splits. Random choices are seeded digests of the row key."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.plans.scale import first_rows, rank_within, seeded_key, top_k


def max_samples(df: DataFrame, n: int, key: str, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """First n rows, or n random rows without replacement; ``key`` must be unique."""
    if not shuffle:
        return first_rows(df, [key], n)
    return first_rows(df.withColumn("__key", seeded_key(seed, key)), ["__key", key], n).drop("__key")


def shuffle_rows(df: DataFrame, key: str, seed: int = 0, rows: int | None = None, out: str = "position") -> DataFrame:
    """Seeded order as a row number."""
    keyed = df.withColumn("__key", seeded_key(seed, key))
    return rank_within(keyed, [], ["__key", key], out, rows=rows).drop("__key")


def curriculum_order(df: DataFrame, feedback: DataFrame, key: str, priority: str, default: float = 0.0, out: str = "position"):
    """Order by the priority the last batch reported, highest first; unseen rows take the default."""
    scored = df.join(feedback.select(key, priority), key, "left")
    scored = scored.withColumn(priority, F.coalesce(F.col(priority).cast("double"), F.lit(default)))
    return rank_within(scored, [], [f"{priority} desc", key], out)


def append_generated(df: DataFrame, generated: DataFrame, length: Column, max_length: int) -> DataFrame:
    from rewardloom.operators.prep import filter_overlong

    return df.unionByName(filter_overlong(generated, length, max_length), allowMissingColumns=True)


def source_quotas(ratios: Mapping[str, float], cycle: int, batch: int = 1) -> dict[str, int]:
    """Rows per source and cycle: at least one, rounded half to even, reduced by the
    greatest common divisor while the cycle still covers a batch."""
    total = sum(ratios.values())
    quotas = {s: max(1, round(cycle * r / total)) for s, r in ratios.items()}
    divisor = math.gcd(*quotas.values())
    if divisor > 1 and sum(quotas.values()) // divisor >= batch:
        quotas = {s: q // divisor for s, q in quotas.items()}
    return quotas


def _with_quota(df: DataFrame, source: str, quotas: Mapping[str, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    return df.withColumn("__quota", F.try_element_at(table, F.col(source))).where(F.col("__quota").isNotNull())


def mix_sources(df: DataFrame, source: str, key: str, quotas: Mapping[str, int], seed: int = 0) -> DataFrame:
    """One cycle: each source's quota of rows in seeded order, fewer where a source is smaller."""
    keyed = _with_quota(df, source, quotas).withColumn("__key", seeded_key(seed, key))
    ranked = rank_within(keyed, [source], ["__key", key], "__i")
    return ranked.where(F.col("__i") < F.col("__quota")).drop("__i", "__quota", "__key")


def interleave_cycle(df: DataFrame, source: str, key: str, quotas: Mapping[str, int], cycle: int, seed: int = 0) -> DataFrame:
    """Rows of cycle number ``cycle`` when every source keeps drawing and restarts at its end.

    Draw d of a source takes its row d modulo its size; ``draw`` is the number inside the cycle.
    """
    keyed = _with_quota(df, source, quotas).withColumn("__key", seeded_key(seed, key))
    ranked = rank_within(keyed, [source], ["__key", key], "__i")
    sizes = ranked.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    first = F.col("__quota").cast("long") * cycle
    joined = ranked.join(F.broadcast(sizes) if len(quotas) < 10_000 else sizes, source)
    # Draws first .. first+quota-1 that land on this row: first hit, then every __n.
    offset = F.pmod(F.col("__i") - first, F.col("__n"))
    hits = F.when(offset < F.col("__quota"), F.sequence(offset, F.col("__quota").cast("long") - 1, F.col("__n")))
    return joined.withColumn("draw", F.explode(hits)).drop("__i", "__n", "__quota", "__key")


def shuffle_shards(shards: DataFrame, key: str, seed: int = 0, out: str = "position") -> DataFrame:
    return shuffle_rows(shards, key, seed, out=out)


def train_test_split(df: DataFrame, key: str, test: float, seed: int = 0) -> DataFrame:
    """``split`` by seeded bucket of the key: stable when rows are added."""
    from rewardloom.plans.scale import unit_draw

    return df.withColumn("split", F.when(unit_draw(seed, key) < test, "test").otherwise("train"))


def head_tail_split(df: DataFrame, idx: str, fraction: float, n: int | None = None) -> DataFrame:
    n = df.count() if n is None else n
    return df.withColumn("split", F.when(F.col(idx) < int(n * fraction), "train").otherwise("test"))


def holdout_group_split(
    df: DataFrame, group: str, key: str, train: int = 40, test: int = 10, held_out: int = 20, seed: int = 0
) -> DataFrame:
    """One seeded group is kept out (``ood``); every other gives train and in-distribution test rows."""
    out_group = df.select(group).distinct().orderBy(seeded_key(seed, group)).limit(1).select(F.col(group).alias("__g"))
    keyed = df.withColumn("__key", seeded_key(seed, key))
    ranked = top_k(keyed, [group], ["__key", key], max(train + test, held_out), "__i")
    marked = ranked.join(F.broadcast(out_group.withColumn("__held", F.lit(True))), F.col(group) == F.col("__g"), "left")
    held = F.coalesce("__held", F.lit(False))
    split = F.when(held & (F.col("__i") <= held_out), "ood").when(~held & (F.col("__i") <= train), "train").when(
        ~held & (F.col("__i") <= train + test), "test")
    return marked.withColumn("split", split).where(F.col("split").isNotNull()).drop("__g", "__held", "__i", "__key")


def top_k_rows(df: DataFrame, column: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k largest; ``ties`` must make the order unique."""
    return first_rows(df, [f"{column} desc", *ties], k)


def log_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    return max_samples(df, n, key, True, seed)


def first_per_source(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    return top_k(df, [source], [order], n, "place")


def best_second_per_group(df: DataFrame, group: str, score: str, order: str) -> DataFrame:
    return top_k(df, [group], [f"{score} desc", order], 2, "place")
