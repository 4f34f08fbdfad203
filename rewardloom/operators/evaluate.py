"""Evaluation of sampled responses: mean, best, worst and majority at k, per data source."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.plans.scale import keyed_join, rank_within, running_total, union_all, unit_draw, with_group_stats


def subset_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, then n itself; nothing for a lone row."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.pow(F.lit(2), i).cast("long"))
    below = F.filter(powers, lambda p: p < n)
    return F.when(n > 1, F.concat(below, F.array(n.cast("long")))).otherwise(F.array().cast("array<bigint>"))


def mean_std_at_n(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation of each group, with its size."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def majority_value(df: DataFrame, keys: Sequence[str], pred: str, value: str, order: str) -> DataFrame:
    """Value of the first row of the most frequent prediction; ties go to the first seen."""
    votes = df.groupBy(*keys, pred).agg(
        F.count(F.lit(1)).alias("__c"), F.min(order).alias("__f"), F.min_by(value, order).alias("__v")
    )
    return votes.groupBy(*keys).agg(F.max_by("__v", F.struct(F.col("__c"), -F.col("__f"))).alias("majority"))


def _value_steps(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values of a group with the counts below and up to them."""
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    steps = running_total(counts, keys, ["v"], F.col("c"), "upto")
    sized = with_group_stats(steps, keys, F.sum("c").alias("n"))
    return sized.withColumn("below", F.col("upto") - F.col("c"))


def best_worst_exact(df: DataFrame, keys: Sequence[str], value: str, k: Column | int | None = None) -> DataFrame:
    """Expected maximum and minimum of k draws with replacement, in closed form, with deviations.

    k is 2, 4, ... up to the group size unless one is given.
    """
    steps = _value_steps(df, keys, value)
    sizes = subset_sizes(F.col("n")) if k is None else F.array(F.lit(k) if isinstance(k, int) else k)
    steps = steps.withColumn("k", F.explode(sizes))
    share = lambda c: F.pow(F.col(c) / F.col("n"), F.col("k"))
    top = share("upto") - share("below")
    low = F.pow(1 - F.col("below") / F.col("n"), F.col("k")) - F.pow(1 - F.col("upto") / F.col("n"), F.col("k"))
    v = F.col("v")
    spread = lambda w: F.sqrt(F.greatest(F.sum(v * v * w) - F.pow(F.sum(v * w), F.lit(2)), F.lit(0.0)))
    return steps.groupBy(*keys, "k").agg(
        F.sum(v * top).alias("best_mean"), spread(top).alias("best_std"),
        F.sum(v * low).alias("worst_mean"), spread(low).alias("worst_std"),
    )


def best_worst_bootstrap(df: DataFrame, keys: Sequence[str], value: str, order: str, draws: int = 1000, seed: int = 42):
    """Mean and deviation of the maximum and minimum over ``draws`` resamples of size k.

    The maximum of k draws sits at rank ceil(n * u^(1/k)) for one uniform u, so a resample
    is one rank instead of k rows; all groups of one size share their resamples, which
    makes the bootstrap a weight per (size, k, rank).
    """
    ranked = rank_within(df, keys, [value, order], "rank")
    ranked = with_group_stats(ranked, keys, F.count(F.lit(1)).alias("n"))
    sizes = ranked.groupBy(*keys).agg(F.max("n").alias("n")).select("n").distinct()
    plan = sizes.withColumn("k", F.explode(subset_sizes(F.col("n"))))
    plan = plan.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u, inverse = unit_draw(seed, "k", "b"), F.lit(1.0) / F.col("k")
    last = F.col("n") - 1
    top = F.greatest(F.ceil(F.col("n") * F.pow(u, inverse)) - 1, F.lit(0))
    low = F.least(F.floor(F.col("n") * (1 - F.pow(1 - u, inverse))), last)
    picks = plan.select("n", "k", F.explode(F.array(
        F.struct(F.lit("best").alias("side"), F.least(top, last).alias("rank")),
        F.struct(F.lit("worst").alias("side"), low.alias("rank")),
    )).alias("p")).groupBy("n", "k", "p.side", "p.rank").agg(F.count(F.lit(1)).alias("w"))
    hit = ranked.join(picks, ["n", "rank"])
    v, w = F.col(value), F.col("w")
    per = lambda side, f: F.sum(F.when(F.col("side") == side, f))
    mean = lambda s: per(s, v * w) / draws
    std = lambda s: F.sqrt(F.greatest(per(s, v * v * w) / draws - mean(s) * mean(s), F.lit(0.0)))
    return hit.groupBy(*keys, "k").agg(
        mean("best").alias("best_mean"), std("best").alias("best_std"),
        mean("worst").alias("worst_mean"), std("worst").alias("worst_std"),
    )


def _resamples(n: int, k: int, draws: int, seed: int) -> np.ndarray:
    """Row indices of every resample of a group of n, shape (draws, k); those of short groups are few and kept together."""
    return (_short_draws if n <= SHORT_GROUP else _long_draws)(n, k, draws, seed)


def _drawn_rows(n: int, k: int, draws: int, seed: int) -> np.ndarray:
    cells = np.arange(draws * k)
    digits = [int(hashlib.md5(f"{seed}|{k}|{c}".encode()).hexdigest()[:13], 16) for c in cells]
    return (np.array(digits, dtype=np.float64) / 2.0**52 * n).astype(np.int64).reshape(draws, k)


_short_draws = lru_cache(maxsize=256)(_drawn_rows)
_long_draws = lru_cache(maxsize=8)(_drawn_rows)


def _wins(codes: np.ndarray, k: int, draws: int, seed: int) -> np.ndarray:
    """How many resamples the first-drawn row of the majority answer (ties to the first drawn) was each row of the group."""
    picked = _resamples(len(codes), k, draws, seed)
    drawn = codes[picked]
    counts = (drawn[:, :, None] == drawn[:, None, :]).sum(axis=2) if k <= 64 else np.stack(
        [np.bincount(row, minlength=codes.max() + 1)[row] for row in drawn]
    )
    first = counts.argmax(axis=1)
    return np.bincount(picked[np.arange(draws), first], minlength=len(codes))


@lru_cache(maxsize=16_384)
def _known_wins(codes: tuple[int, ...], k: int, draws: int, seed: int) -> np.ndarray:
    return _wins(np.array(codes), k, draws, seed)


SHORT_GROUP = 32  # groups up to this size often repeat a pattern of equal answers, and with it the outcome of all draws


def _majority_of_resamples(answers: np.ndarray, values: np.ndarray, k: int, draws: int, seed: int) -> tuple[float, float]:
    """Mean and deviation of the majority value over all resamples; which row wins depends on which answers are equal only."""
    seen: dict = {}
    codes = tuple([seen.setdefault(a, len(seen)) for a in answers.tolist()])
    wins = _known_wins(codes, k, draws, seed) if len(codes) <= SHORT_GROUP else _wins(np.array(codes), k, draws, seed)
    if not (values - values == 0).all():  # a value that is not finite counts only where it wins
        values, wins = values[wins > 0], wins[wins > 0]
    mean = float(wins @ values) / draws
    off = values - mean
    return mean, math.sqrt(float(wins @ (off * off)) / draws)


def majority_bootstrap(
    df: DataFrame, keys: Sequence[str], pred: str, value: str, order: str, draws: int = 1000, seed: int = 42,
    group_limit: int = 4096,
) -> DataFrame:
    """maj@k: the majority value of k resampled rows, averaged over ``draws`` resamples; null is an answer like any other.

    Groups up to ``group_limit`` rows travel as one array and are resampled inside a task;
    larger groups are resampled by a join on (group, row), so no group is ever gathered.
    """
    ranked = rank_within(df, keys, [order], "i")
    ranked = with_group_stats(ranked, keys, F.count(F.lit(1)).alias("n")).where("n > 1")
    item = F.struct("i", F.col(pred).cast("string").alias("p"), F.col(value).cast("double").alias("v"))
    small = ranked.where(F.col("n") <= group_limit).groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("__rows"), F.max("n").alias("__n")
    )
    small = small.select(
        *keys, F.col("__rows.p").alias("__p"), F.col("__rows.v").alias("__v"), F.explode(subset_sizes(F.col("__n"))).alias("k")
    )
    result = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])

    @F.pandas_udf(result)
    def resample(p: pd.Series, v: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = [
            _majority_of_resamples(np.asarray(a, dtype=object), np.asarray(b, dtype=float), int(c), draws, seed)
            for a, b, c in zip(p, v, k, strict=True)
        ]
        return pd.DataFrame(rows, columns=["mean", "std"])

    inside = small.select(*keys, "k", resample("__p", "__v", "k").alias("__r")).select(
        *keys, "k", F.col("__r.mean").alias("maj_mean"), F.col("__r.std").alias("maj_std")
    )
    large = ranked.where(F.col("n") > group_limit)
    sizes = large.groupBy(*keys).agg(F.max("n").alias("n")).withColumn("k", F.explode(subset_sizes(F.col("n"))))
    cells = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    cells = cells.withColumn("i", F.floor(unit_draw(seed, "k", F.col("b") * F.col("k") + F.col("j")) * F.col("n")))
    drawn = keyed_join(cells.drop("n"), large.select(*keys, "i", F.col(pred).alias("__p"), F.col(value).cast("double").alias("__v")), [*keys, "i"])
    won = majority_value(drawn, [*keys, "k", "b"], "__p", "__v", "j")
    outside = won.groupBy(*keys, "k").agg(F.avg("majority").alias("maj_mean"), F.stddev_pop("majority").alias("maj_std"))
    return inside.unionByName(outside)


def validation_metrics(
    df: DataFrame, source: str, uid: str, variables: Sequence[str], order: str, pred: str | None = None,
    draws: int = 1000, seed: int = 42, exact: bool = False,
) -> DataFrame:
    """(source, variable, metric, value): per-prompt metrics averaged over prompts.

    ``exact`` takes best and worst in closed form instead of by resampling.
    """
    kinds = dict(df.dtypes)
    numeric = [v for v in variables if kinds[v] != "string"]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in numeric
    ]))
    long = df.select(source, uid, F.col(order).alias("__o"), *([F.col(pred).alias("__pred")] if pred else []), pairs.alias("x"))
    long = long.select(source, uid, "__o", *(["__pred"] if pred else []), "x.variable", "x.value")
    keys = [source, uid, "variable"]
    base = mean_std_at_n(long, keys, "value")
    named = lambda d, items: d.select(*keys, F.explode(F.array(*[
        F.struct(n.alias("metric"), v.alias("value")) for n, v in items
    ])).alias("m")).select(*keys, "m.metric", "m.value")
    at = lambda head, tail="", col="k": F.concat(F.lit(head), F.col(col).cast("string"), F.lit(tail))
    parts = [named(base, [(at("mean@", col="n"), F.col("mean"))]),
             named(base.where("n > 1"), [(at("std@", col="n"), F.col("std"))])]
    tops = best_worst_exact(long, keys, "value") if exact else best_worst_bootstrap(long, keys, "value", "__o", draws, seed)
    parts.append(named(tops, [(at("best@", "/mean"), F.col("best_mean")), (at("best@", "/std"), F.col("best_std")),
                              (at("worst@", "/mean"), F.col("worst_mean")), (at("worst@", "/std"), F.col("worst_std"))]))
    if pred:
        maj = majority_bootstrap(long, keys, "__pred", "value", "__o", draws, seed)
        parts.append(named(maj, [(at("maj@", "/mean"), F.col("maj_mean")), (at("maj@", "/std"), F.col("maj_std"))]))
    return union_all(parts).groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def val_sections(metrics: DataFrame, source: str = "data_source") -> DataFrame:
    """Full metric names (a null source is ``unknown``): core for mean, majority and best at the largest n of the core variable."""
    at = F.regexp_extract("metric", "@([0-9]+)", 1).cast("int")
    top = metrics.groupBy(source, "variable").agg(F.max(at).alias("n_max"))
    has_acc = metrics.groupBy(source).agg(F.max((F.col("variable") == "acc").cast("int")).alias("has_acc"))
    joined = keyed_join(keyed_join(metrics, top, [source, "variable"]), has_acc, [source])
    core_var = F.when(F.col("has_acc") == 1, "acc").otherwise("reward")
    core = (F.col("variable") == core_var) & F.col("metric").rlike("^(mean|maj|best)") & (
        F.instr("metric", F.concat(F.lit("@"), F.col("n_max").cast("string"))) > 0
    )
    section = F.when(core, "val-core").otherwise("val-aux")
    return joined.select(F.concat_ws("/", section, F.coalesce(F.col(source).cast("string"), F.lit("unknown")), "variable", "metric").alias("key"), "value")


def attach_responses(
    prompts: DataFrame, outputs: DataFrame, key: str, response: str, order: str, list_limit: int = 10_000
) -> DataFrame:
    """Each prompt with the ordered list of its sampled responses.

    A prompt with more than ``list_limit`` responses gets several rows, numbered by ``segment``.
    """
    ranked = rank_within(outputs.select(key, response, order), [key], [order], "__i")
    ranked = ranked.withColumn("segment", F.floor(F.col("__i") / list_limit).cast("int"))
    lists = ranked.groupBy(key, "segment").agg(F.array_sort(F.collect_list(F.struct("__i", F.col(response).alias("r")))).alias("l"))
    lists = lists.select(key, "segment", F.col("l.r").alias("responses"))
    joined = keyed_join(prompts, lists, [key], "left")
    return joined.withColumn("segment", F.coalesce("segment", F.lit(0)))


def eval_responses(df: DataFrame, source: str, item: str, responses: str, scorer) -> DataFrame:
    """Mean score per source of rows that hold response lists; ``scorer`` maps a response column to a score."""
    from rewardloom.operators.reduce import source_score

    each = df.select("*", F.explode(responses).alias("__response"))
    return source_score(each.withColumn("__s", scorer(F.col("__response"))), source, item, "__s")


def answer_agreement(df: DataFrame, key: str, pred: str) -> DataFrame:
    """Per group: size, number of distinct answers and the share of the most frequent one."""
    votes = df.groupBy(key, pred).agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy(key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("answers"),
                                  (F.max("c") / F.sum("c")).alias("agreement"))
