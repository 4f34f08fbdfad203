"""Group-relative and sequential advantage estimators.

Rows hold ``rewards`` and ``mask`` arrays. Group statistics are taken from a narrow
aggregate and joined back, so token arrays never pass through a group operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import seq
from rewardloom.functions.kl import kl_penalty
from rewardloom.functions.scan import discounted_returns, generalized_advantages, suffix_sum
from rewardloom.operators.reduce import group_mean_std, masked_whiten
from rewardloom.operators.token_baseline import token_baseline
from rewardloom.plans.scale import first_rows, keyed_join, running_total, top_k, unit_draw, with_group_stats, with_scalars

CELLS_PER_BLOCK = 1024

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_advantage(name: str):
    """Add an estimator (DataFrame to DataFrame) under a name."""

    def add(fn):
        if ESTIMATORS.get(name, fn) is not fn:
            raise ValueError(f"advantage estimator {name} is already registered")
        ESTIMATORS[name] = fn
        return fn

    return add


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown advantage estimator: {name}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def _with_score(df: DataFrame, score: str | None) -> DataFrame:
    value = F.col(score) if score else F.aggregate("rewards", F.lit(0.0), lambda a, r: a + r)
    return df.withColumn("__score", value)


def _spread(df: DataFrame, scalar: Column, mask: str) -> DataFrame:
    """Outcome advantage: one scalar per row over its valid tokens; returns are the same."""
    df = df.withColumn("advantage", scalar).withColumn("advantages", seq.broadcast_on_mask(F.col("advantage"), mask))
    return df.withColumn("returns", F.col("advantages")).drop("__score", "__mean", "__std", "__n", "__extra")


@register_advantage("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0, mask: str = "mask") -> DataFrame:
    """Right-to-left temporal-difference scan; masked tokens pass value and trace through."""

    df = df.withColumn("advantages", generalized_advantages("rewards", "values", mask, gamma, lam))
    df = df.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return masked_whiten(df, "advantages", mask)


@register_advantage("grpo")
def grpo(df, key="uid", score=None, mask="mask", norm_by_std=True, eps=1e-6) -> DataFrame:
    """(score - group mean) / (group deviation + eps)."""
    df = group_mean_std(_with_score(df, score), key, "__score", "__mean", "__std", "__n")
    centred = F.col("__score") - F.col("__mean")
    return _spread(df, centred / (F.col("__std") + eps) if norm_by_std else centred, mask)


@register_advantage("grpo_vectorized")
def grpo_vectorized(df, key="uid", score=None, mask="mask", norm_by_std=True, eps=1e-6) -> DataFrame:
    """The same with the group variance clamped from below."""
    df = group_mean_std(_with_score(df, score), key, "__score", "__mean", "__std", "__n", eps=eps)
    centred = F.col("__score") - F.col("__mean")
    return _spread(df, centred / (F.col("__std") + eps) if norm_by_std else centred, mask)


@register_advantage("grpo_passk")
def grpo_passk(df, key="uid", order="row_idx", score=None, mask="mask", norm_by_std=True, eps=1e-6) -> DataFrame:
    """Only the best row of a group is credited, by its lead over the second best."""
    df = _with_score(df, score)
    best = top_k(df.select(key, order, "__score"), [key], ["__score desc", order], 2)
    best = best.groupBy(key).agg(
        F.max_by(order, -F.col("rank")).alias("__best"),
        (F.max("__score") - F.min("__score")).alias("__lead"),
    )
    sizes = df.groupBy(key).agg(F.stddev_samp("__score").alias("__std"), F.count(F.lit(1)).alias("__n"))
    df = keyed_join(df, keyed_join(best, sizes, [key]), [key])
    lead = F.when(F.col("__n") < 2, F.raise_error(F.lit("pass@k needs at least two rows per group")).cast("double"))
    lead = lead.otherwise(F.col("__lead") / (F.col("__std") + eps) if norm_by_std else F.col("__lead"))
    won = F.when(F.col(order) == F.col("__best"), lead).otherwise(F.when(F.col("__n") < 2, lead).otherwise(0.0))
    return _spread(df, won, mask).drop("__best", "__lead")


@register_advantage("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df, key="uid", score=None, mask="mask") -> DataFrame:
    """Score minus group mean (nothing subtracted from a lone row), whitened over the table."""
    df = group_mean_std(_with_score(df, score), key, "__score", "__mean", "__std", "__n")
    df = _spread(df, F.col("__score") - F.col("__mean"), mask)
    df = masked_whiten(df, "advantages", mask)
    df = df.withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m))
    return df.withColumn("returns", F.col("advantages"))


@register_advantage("rloo")
def rloo(df, key="uid", score=None, mask="mask") -> DataFrame:
    """Leave-one-out baseline; a lone row keeps its score."""
    df = with_group_stats(_with_score(df, score), [key], F.avg("__score").alias("__mean"), F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    value = F.when(n > 1, (F.col("__score") - F.col("__mean")) * n / (n - 1)).otherwise(F.col("__score"))
    return _spread(df, value, mask)


@register_advantage("rloo_vectorized")
def rloo_vectorized(df, key="uid", score=None, mask="mask") -> DataFrame:
    """Leave-one-out baseline; a lone row gets zero."""
    df = with_group_stats(_with_score(df, score), [key], F.sum("__score").alias("__mean"), F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    value = F.when(n > 1, (n * F.col("__score") - F.col("__mean")) / (n - 1)).otherwise(0.0)
    return _spread(df, value, mask)


@register_advantage("opo")
def opo(df, key="uid", score=None, mask="mask") -> DataFrame:
    """Length-weighted group mean as baseline; a lone row keeps its score."""
    df = _with_score(df, score).withColumn("__len", seq.mask_count(mask))
    df = with_group_stats(
        df, [key], F.sum(F.col("__len") * F.col("__score")).alias("__mean"), F.sum("__len").alias("__std"),
        F.count(F.lit(1)).alias("__n"),
    )
    base = F.when(F.col("__n") > 1, F.col("__mean") / F.col("__std")).otherwise(0.0)
    return _spread(df, F.col("__score") - base, mask).drop("__len")


@register_advantage("reinforce_plus_plus")
def reinforce_plus_plus(df, gamma: float = 1.0, mask: str = "mask") -> DataFrame:
    """Discounted return that restarts after a masked token, whitened and masked."""

    scan = discounted_returns("rewards", mask, gamma)
    df = masked_whiten(df.withColumn("returns", scan), "returns", mask, "advantages")
    return df.withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m))


@register_advantage("remax")
def remax(df, baseline: str = "baseline", mask: str = "mask") -> DataFrame:
    """Reward-to-go minus the greedy baseline of the prompt."""
    df = df.withColumn("returns", suffix_sum("rewards", mask))
    return df.withColumn("advantages", F.zip_with("returns", mask, lambda r, m: r - F.col(baseline) * m))


@register_advantage("gpg")
def gpg(df, key="uid", score=None, mask="mask", f_norm: float = 1.0) -> DataFrame:
    """Centred score times rows per non-zero score of the whole table."""
    df = _with_score(df, score)
    hits = F.sum((F.col("__score") != 0).cast("long"))
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(hits, F.lit(1))).alias("__extra"))
    df = with_scalars(group_mean_std(df, key, "__score", "__mean", "__std", "__n"), alpha)
    return _spread(df, F.col("__extra") * (F.col("__score") - F.col("__mean")) / f_norm, mask)


@register_advantage("optimal_token_baseline")
def optimal_token_baseline(df, key="uid", row="row_idx", mask="mask", weights=None, handle_zero_tail=False, eps=1e-8):
    return token_baseline(df, key, mask, weights, handle_zero_tail, eps, compact=False)


@register_advantage("tir_optimal_token_baseline")
def tir_optimal_token_baseline(df, key="uid", row="row_idx", mask="mask", weights=None, handle_zero_tail=True, eps=1e-8):
    """The same after squeezing out the masked (tool) tokens of multi-turn rows."""
    return token_baseline(df, key, mask, weights, handle_zero_tail, eps, compact=True)


# ---------------------------------------------------------------- rewards and penalties


def token_rewards(df: DataFrame, kl_ratio: float, scores: str = "scores", out: str = "rewards") -> DataFrame:
    """Score minus ratio times the log-probability gap to the reference policy."""
    value = F.transform(seq.zipped(scores, "old_logp", "ref_logp"), lambda e: e[scores] - (e["old_logp"] - e["ref_logp"]) * kl_ratio)
    return df.withColumn(out, value)


def apply_kl_penalty(df: DataFrame, kind: str = "kl", beta: float = 0.001, mask: str = "mask", scores: str = "scores"):
    """Rewards with the masked penalty subtracted; ``kl`` holds the masked divergence per token."""
    df = df.withColumn("kl", F.transform(seq.zipped("old_logp", "ref_logp", mask), lambda e: kl_penalty(e["old_logp"], e["ref_logp"], kind) * e[mask]))
    return df.withColumn("rewards", F.zip_with(scores, "kl", lambda s, k: s - beta * k))


def kl_report(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Mean over rows of the row's masked mean divergence (after ``apply_kl_penalty``)."""
    return df.agg(F.avg(seq.masked_mean("kl", mask)).alias("reward_kl_penalty"))


def adaptive_kl_series(
    df: DataFrame, init: float, target: float, horizon: float, run: str = "run", step: str = "step",
    kl: str = "kl", n: str = "n_steps",
) -> DataFrame:
    """Coefficient after each step. Each update is a factor that does not depend on the
    coefficient, so the series is a running product: a running sum of logarithms."""
    error = seq.clamp(F.col(kl) / target - 1.0, -0.2, 0.2)
    factor = F.lit(1.0) + error * F.col(n) / horizon
    safe = F.when(factor > 0, factor).otherwise(F.raise_error(F.lit("step size exceeds the horizon")).cast("double"))
    out = running_total(df, [run], [step], F.log(safe), "__log")
    return out.withColumn("beta", F.lit(init) * F.exp("__log")).drop("__log")


def fixed_kl_series(df: DataFrame, init: float) -> DataFrame:
    return df.withColumn("beta", F.lit(init))


def place_outcome_reward(df: DataFrame, score: str = "score", mask: str = "mask", out: str = "rewards") -> DataFrame:
    """The scalar score on the last valid token, zero elsewhere."""
    last = seq.last_valid(mask)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    some = F.concat(zeros(last - 1), F.array(F.col(score).cast("double")), zeros(F.size(mask) - last))
    return df.withColumn(out, F.when(last > 0, some).otherwise(zeros(F.size(mask))))


def _ones_then_zeros(ones: Column, size: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), ones.cast("int")), F.array_repeat(F.lit(0), (size - ones).cast("int")))


def mask_until_eos(tokens: str, eos: list[int]) -> Column:
    """1 up to and including the first end token."""
    found = F.array_position(F.transform(F.col(tokens), lambda t: t.isin(eos).cast("int")), 1)
    return _ones_then_zeros(F.when(found == 0, F.size(tokens)).otherwise(found), F.size(tokens))


def trajectory_mask(done: str) -> Column:
    """1 for steps up to the first completion; all steps when it never comes."""
    found = F.array_position(F.col(done), True)
    return _ones_then_zeros(F.when(found == 0, F.size(done)).otherwise(found), F.size(done))


# ---------------------------------------------------------------- dynamic sampling


def group_filter(df: DataFrame, key: str = "uid", metric: str = "score") -> DataFrame:
    """Rows of groups whose metric varies, and lone rows."""
    spread = F.stddev_pop(metric)
    kept = df.groupBy(key).agg(spread.alias("s"), F.count(F.lit(1)).alias("n")).where("s > 0 or n = 1").select(key)
    return keyed_join(df, kept, [key], "left_semi")


def take_prompt_batch(df: DataFrame, prompts: int, key: str = "uid", order: str = "row_idx") -> DataFrame:
    """All rows of the first ``prompts`` groups by first appearance."""
    first = first_rows(df.groupBy(key).agg(F.min(order).alias("__first")), ["__first"], prompts)
    return keyed_join(df, first.select(key), [key], "left_semi")


def pf_ppo_resample(
    df: DataFrame, order: str = "row_idx", score: str = "score", method: str = "pow", weight_pow: float = 2.0,
    seed: int = 0, rows: int | None = None,
) -> DataFrame:
    """As many draws with replacement as rows, with probability by score weight.

    Every draw is a point on the cumulative weight axis, and the axis is cut into as many cells as rows. A row meets the draws of
    the cells it touches by a join, blocks of ``CELLS_PER_BLOCK`` cells that lie wholly inside its interval as one: a row with half
    of all weight is few join rows, and its draws are spread over tasks by block.
    """
    n = df.count() if rows is None else rows
    top = df.agg(F.max(score).alias("__hi"), F.min(score).alias("__lo"))
    columns = df.columns
    df = with_scalars(df, top)
    s = F.col(score)
    weights = {
        "pow": F.pow(F.abs(s), F.lit(weight_pow)),
        "max_min": F.when((s == F.col("__hi")) | (s == F.col("__lo")), 1.0).otherwise(0.0),
        "max_random": F.when(s == F.col("__hi"), 0.4).otherwise(0.1),
    }
    if method not in weights:
        raise ValueError(f"unknown reweight method: {method}")
    weighted = df.withColumn("__w", weights[method] + 1e-8).drop("__hi", "__lo")
    weighted = running_total(weighted, [], [order], F.col("__w"), "__to", rows=n)
    total = weighted.agg(F.max("__to").alias("__total"))
    placed = with_scalars(weighted, total).withColumn("__from", F.col("__to") - F.col("__w"))
    cell = lambda x: F.least(F.floor(x / F.col("__total") * n), F.lit(n - 1)).cast("long")
    first, last = cell(F.col("__from")), cell(F.col("__to"))
    begin, end = F.floor(first / CELLS_PER_BLOCK) + 1, F.floor(last / CELLS_PER_BLOCK)  # of the blocks between the two end cells
    some = end > begin
    outer = F.concat(F.sequence(first, begin * CELLS_PER_BLOCK - 1), F.sequence(end * CELLS_PER_BLOCK, last))
    draws = with_scalars(df.sparkSession.range(n).toDF("draw"), total)
    draws = draws.withColumn("__u", unit_draw(seed, "draw") * F.col("__total")).withColumn("__cell", cell(F.col("__u"))).drop("__total")
    placed = placed.withColumns({"__some": some, "__begin": begin, "__end": end, "__cells": F.when(some, outer).otherwise(F.sequence(first, last))}).drop("__total")
    inside = (F.col("__u") >= F.col("__from")) & (F.col("__u") < F.col("__to"))
    edges = placed.withColumn("__cell", F.explode("__cells")).join(draws, "__cell").where(inside)
    blocks = placed.where("__some").withColumn("__block", F.explode(F.sequence(F.col("__begin"), F.col("__end") - 1)))
    whole = blocks.join(draws.withColumn("__block", F.floor(F.col("__cell") / CELLS_PER_BLOCK)), "__block")
    return edges.select(*columns, "draw").unionByName(whole.select(*columns, "draw"))


def trace_sample(df: DataFrame, k: int, index: str, seed: int = 0) -> DataFrame:
    """All rows of k sample indices chosen by a seeded digest."""
    from rewardloom.plans.scale import seeded_key

    chosen = first_rows(df.select(index).distinct().withColumn("__key", seeded_key(seed, index)), ["__key", index], k)
    return keyed_join(df, chosen.select(index), [index], "left_semi")
