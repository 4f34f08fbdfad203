"""Masked reductions, shared statistics and batch metrics.

Token columns are arrays of one length per row. Sums over tokens run on unnested
tokens in generated code; statistics per row group the tokens by the row key first,
which leaves one partial row per sequence to shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import seq
from rewardloom.functions.scan import prefix_sum
from rewardloom.functions.seq import EPS
from rewardloom.plans.scale import ROWS_PER_RANGE, keyed_join, running_total, with_group_stats, with_scalars

ROW = ("uid", "rollout_n")

# ---------------------------------------------------------------- masked reductions


def masked_totals(df: DataFrame, values: str, mask: str = "mask") -> DataFrame:
    """One row: sum, valid count and squared deviations from the mean over all valid tokens.

    The deviations are a central moment that partial aggregates merge, so a mean far from zero cancels nothing.
    """
    v = seq.masked(F.col(values), F.col(mask))
    tokens = seq.flat(df, [values], mask)
    valid = F.when(F.col(mask) != 0, v)
    spread = F.var_pop(valid) * F.count(valid)
    return tokens.agg(F.sum(v).alias("total"), spread.alias("spread"), F.sum(mask).cast("double").alias("tokens"))


def masked_sum(df: DataFrame, values: str, mask: str = "mask") -> DataFrame:
    return masked_totals(df, values, mask).select(F.col("total").alias("masked_sum"))


def masked_mean(df: DataFrame, values: str, mask: str = "mask") -> DataFrame:
    return masked_totals(df, values, mask).select((F.col("total") / (F.col("tokens") + EPS)).alias("masked_mean"))


def masked_var(df: DataFrame, values: str, mask: str = "mask", unbiased: bool = True) -> DataFrame:
    """Mean squared deviation over valid tokens, times n/(n-1) when unbiased; n of 0 or 1 is an error."""
    t = masked_totals(df, values, mask)
    n, mean = F.col("tokens"), F.col("total") / (F.col("tokens") + EPS)
    off = F.col("total") / n - mean  # the mean is guarded against no tokens at all
    biased = (F.col("spread") + n * off * off) / (n + EPS)
    if unbiased:
        short = F.raise_error(F.lit("variance needs at least two valid tokens")).cast("double")
        biased = F.when(F.coalesce(n, F.lit(0.0)) <= 1, short).otherwise(biased * n / (n - 1))
    return t.select(mean.alias("mean"), biased.alias("var"))


def masked_whiten(
    df: DataFrame, values: str, mask: str = "mask", out: str | None = None, shift_mean: bool = True
) -> DataFrame:
    """(v - mean) / sqrt(var + eps) with statistics of the whole table."""
    stats = masked_var(df, values, mask).select(F.col("mean").alias("__mean"), F.col("var").alias("__var"))
    scale = F.lit(1.0) / F.sqrt(F.col("__var") + EPS)
    back = F.lit(0.0) if shift_mean else F.col("__mean")
    white = F.transform(F.col(values), lambda v: (v - F.col("__mean")) * scale + back)
    return with_scalars(df, stats).withColumn(out or values, white).drop("__mean", "__var")


def group_mean_std(
    df: DataFrame, key: str | Sequence[str], score: str, mean: str = "group_mean", std: str = "group_std",
    count: str = "group_size", eps: float | None = None,
) -> DataFrame:
    """Mean, sample deviation and size of each group on every row; a lone row counts as (0, 1).

    With ``eps`` the variance is clamped from below before the root.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = with_group_stats(
        df, keys, F.avg(score).alias(mean), F.var_samp(score).alias(std), F.count(F.lit(1)).alias(count)
    )
    var = F.col(std) if eps is None else F.greatest(F.col(std), F.lit(eps))
    lone = F.col(count) == 1
    return out.withColumn(mean, F.when(lone, 0.0).otherwise(F.col(mean))).withColumn(
        std, F.when(lone, 1.0).otherwise(F.sqrt(var))
    )


def group_table(df: DataFrame, key: str, score: str) -> DataFrame:
    """The same statistics, one row per group."""
    agg = df.groupBy(key).agg(
        F.avg(score).alias("group_mean"), F.stddev_samp(score).alias("group_std"), F.count(F.lit(1)).alias("group_size")
    )
    lone = F.col("group_size") == 1
    return agg.withColumn("group_mean", F.when(lone, 0.0).otherwise(F.col("group_mean"))).withColumn(
        "group_std", F.when(lone, 1.0).otherwise(F.col("group_std"))
    )


def factorize(df: DataFrame, key: str, out: str = "group_id") -> DataFrame:
    """Dense id per distinct key, numbered over the distinct keys only; near-integers are rounded."""
    from rewardloom.plans.scale import rank_within

    kind = dict(df.dtypes)[key]
    name = "__key"
    value = F.col(key)
    if kind in ("double", "float"):
        value = F.when(F.abs(value - F.round(value)) < 1e-6, F.round(value)).otherwise(value)
    keyed = df.withColumn(name, value)
    ids = rank_within(keyed.select(name).distinct(), [], [name], out)
    return keyed_join(keyed, ids, [name]).drop(name)


def column_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, max, min and sample deviation over every partition of the table."""
    return df.agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.stddev_samp(value).alias("std"),
    )


def global_masked_mean(df: DataFrame, values: str, mask: str = "mask") -> DataFrame:
    """Sum of v*m over sum of m, without the guard term of ``masked_mean``."""
    return masked_totals(df, values, mask).select((F.col("total") / F.col("tokens")).alias("masked_mean"))


# ---------------------------------------------------------------- loss aggregation


def loss_aggregate(
    seq_sum: Column, seq_tokens: Column, width: Column, mode: str, dp_size: float = 1.0,
    batch_num_tokens: float | None = None, global_batch_size: float | None = None,
    loss_scale_factor: float | None = None,
) -> Column:
    """Aggregate expression over rows that carry their masked loss sum and token count."""
    has_tokens = (seq_tokens > 0).cast("double")
    tokens = F.lit(batch_num_tokens) if batch_num_tokens else F.sum(seq_tokens)
    rows = F.lit(global_batch_size) if global_batch_size else F.sum(has_tokens)
    if mode == "token-mean":
        return F.sum(seq_sum) / tokens * dp_size
    if mode == "seq-mean-token-sum":
        return F.sum(seq_sum * has_tokens) / rows * dp_size
    if mode == "seq-mean-token-mean":
        return F.sum(seq_sum / (seq_tokens + EPS) * has_tokens) / rows * dp_size
    if mode == "seq-mean-token-sum-norm":
        scale = F.lit(loss_scale_factor) if loss_scale_factor else F.max(width)
        return F.sum(seq_sum) / scale
    raise ValueError(f"unknown loss aggregation: {mode}")


def agg_loss(
    df: DataFrame, loss: str, mask: str = "mask", mode: str = "token-mean", row: Sequence[str] = ROW, **options
) -> DataFrame:
    token_level = mode == "token-mean"
    tokens = seq.flat(df, [loss], mask, keep=() if token_level else row)
    sums = [F.sum(seq.masked(F.col(loss), F.col(mask))).alias("s"), F.sum(mask).cast("double").alias("n"),
            F.count(F.lit(1)).alias("w")]
    rows = tokens.agg(*sums) if token_level else tokens.groupBy(*row).agg(*sums)
    return rows.agg(loss_aggregate(F.col("s"), F.col("n"), F.col("w"), mode, **options).alias("loss"))


# ---------------------------------------------------------------- metric tables


def reduce_metrics(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Per key: the maximum when its name contains max, else the minimum for min, else the mean."""
    name = F.col(key)
    picked = F.when(name.contains("max"), F.max(value)).when(name.contains("min"), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(key).agg(picked.alias("value"))


def metric_series(df: DataFrame) -> DataFrame:
    """METRICS rows reduced by their declared type; one key with two types is an error."""
    kind = F.when(F.min("agg") == F.max("agg"), F.min("agg")).otherwise(
        F.raise_error(F.concat(F.lit("mixed aggregation types for "), F.col("key")))
    )
    g = df.groupBy("key").agg(
        kind.alias("agg"), F.avg("value").alias("mean"), F.sum("value").alias("sum"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    chosen = F.when(F.col("agg") == "mean", F.col("mean")).when(F.col("agg") == "sum", F.col("sum"))
    chosen = chosen.when(F.col("agg") == "min", F.col("min")).when(F.col("agg") == "max", F.col("max"))
    return g.select("key", "agg", chosen.alias("value"))


# Metric names whose rule is not derived from their spelling.
STEP_RULES = {
    "time_sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}
# Spelling rules, first match wins.
STEP_SPELLING = [
    ("timing_s/", "time_sum"),
    ("mean|avg|average", "avg"),
    ("max|maximum", "max"),
    ("min|minimum", "min"),
    ("sum|total", "sum"),
    ("weighted_avg", "weighted_avg"),
]


def step_rule(key: Column) -> Column:
    rule = F.lit(None).cast("string")
    for pattern, kind in reversed(STEP_SPELLING):
        rule = F.when(F.lower(key).rlike(pattern), F.lit(kind)).otherwise(rule)
    for kind, names in STEP_RULES.items():
        rule = F.when(key.isin(names), F.lit(kind)).otherwise(rule)
    return F.coalesce(rule, F.lit("avg"))


def aggregate_steps(
    df: DataFrame, by: Sequence[str] = (), workers: float = 1.0, rules: Mapping[str, str] | None = None
) -> DataFrame:
    """METRICS rows (step, key, value, weight) of several steps to one value per key.

    ``rules`` overrides the rule of single keys. Derived keys are recomputed from their parts.
    """
    rule = step_rule(F.col("key"))
    for name, kind in (rules or {}).items():
        rule = F.when(F.col("key") == name, F.lit(kind)).otherwise(rule)
    g = df.groupBy(*by, "key").agg(
        F.max_by("value", "step").alias("last"), F.sum("value").alias("sum"), F.avg("value").alias("avg"),
        F.max("value").alias("max"), F.min("value").alias("min"),
        F.sum(F.col("value") * F.col("weight")).alias("ws"), F.sum("weight").alias("w"),
    ).withColumn("rule", rule)
    weighted = F.when(F.col("w") != 0, F.col("ws") / F.col("w")).otherwise(F.col("avg"))
    value = (
        F.when(F.col("rule") == "last", F.col("last"))
        .when(F.col("rule") == "weighted_avg", weighted)
        .when(F.col("rule").isin("sum", "time_sum"), F.col("sum"))
        .when(F.col("rule") == "max", F.col("max"))
        .when(F.col("rule") == "min", F.col("min"))
        .otherwise(F.col("avg"))
    )
    plain = g.select(*by, "key", "rule", value.alias("value"))
    derived = ["global_seqlen/minmax_diff", "perf/throughput", "trainer/idle_ratio"]
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    parts = plain.groupBy(*by).agg(
        pick("global_seqlen/minmax_diff").alias("has_diff"),
        (pick("global_seqlen/max") - pick("global_seqlen/min")).alias("diff"),
        pick("perf/throughput").alias("has_rate"),
        (pick("perf/total_num_tokens") / (pick("perf/time_per_step") * workers)).alias("rate"),
        (pick("timing_s/gen") / pick("timing_s/step")).alias("idle"),
    )
    rows = F.array(
        F.struct(F.lit(derived[0]).alias("key"), F.when(F.col("has_diff").isNotNull(), F.col("diff")).alias("value")),
        F.struct(F.lit(derived[1]).alias("key"), F.when(F.col("has_rate").isNotNull(), F.col("rate")).alias("value")),
        F.struct(F.lit(derived[2]).alias("key"), F.col("idle").alias("value")),
    )
    extra = parts.select(*by, F.explode(rows).alias("d")).select(*by, "d.key", F.lit("derived").alias("rule"), "d.value")
    extra = extra.where(F.col("value").isNotNull())
    return plain.join(extra, [*by, "key"], "left_anti").select(*by, "key", "rule", "value").unionByName(extra)


# ---------------------------------------------------------------- batch reports


def response_info(df: DataFrame, attention: str = "attention_mask", response_width: str | Column = "response_width"):
    """Prompt and response lengths from one attention mask whose tail is the response."""
    width = F.col(response_width) if isinstance(response_width, str) else response_width
    split = (F.size(attention) - width).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, m: a + m)
    return df.withColumn("prompt_length", total(F.slice(F.col(attention), F.lit(1), split))).withColumn(
        "response_length", total(F.slice(F.col(attention), split + 1, width.cast("int")))
    )


def corrected_score(score: Column, extra: Column) -> Column:
    """A padded zero is replaced by the score the job reported; a real zero stays."""
    clean = F.when(extra.isNull() | F.isnan(extra) | (F.abs(extra) == float("inf")), 0.0).otherwise(extra)
    return F.when((F.abs(score) < 1e-9) & (F.abs(clean) >= 1e-9), clean).otherwise(score)


def corrected_score_stats(df: DataFrame, score: str, extra: str) -> DataFrame:
    fixed = corrected_score(F.col(score), F.col(extra))
    return df.agg(
        F.avg(fixed).alias("score_mean"), F.max(fixed).alias("score_max"), F.min(fixed).alias("score_min"),
        F.avg(F.when(fixed != F.col(score), 1.0).otherwise(0.0)).alias("padding_ratio"),
    )


def data_metrics(
    df: DataFrame, use_critic: bool = True, max_response_length: int | None = None,
    max_prompt_length: int | None = None, row: Sequence[str] = ROW,
) -> DataFrame:
    """One row with score, reward, advantage, return, value and length statistics.

    Rows need ``scores, rewards, advantages, returns[, values], mask`` arrays and
    ``prompt_length``, ``response_length``.
    """
    tracked = ["advantages", "returns"] + (["values"] if use_critic else [])
    tokens = seq.flat(df, ["scores", "rewards", *tracked], "mask", [*row, "prompt_length", "response_length"], outer=True)
    on = lambda c: F.when(F.col("mask") != 0, c)
    parts = [F.sum("scores").alias("score"), F.sum("rewards").alias("reward"), F.sum((F.col("mask") != 0).cast("double")).alias("n")]
    for c in tracked:
        parts += [F.sum(on(F.col(c))).alias(f"{c}_sum"), F.max(on(F.col(c))).alias(f"{c}_max"), F.min(on(F.col(c))).alias(f"{c}_min")]
    if use_critic:
        gap = F.col("returns") - F.col("values")
        parts += [F.sum(on(F.col("returns") * F.col("returns"))).alias("ret_sq"), F.sum(on(gap)).alias("diff"),
                  F.sum(on(gap * gap)).alias("diff_sq")]
    rows = tokens.groupBy(*row, "prompt_length", "response_length").agg(*parts)
    alive = F.col("response_length") > 0
    cap_r = F.lit(max_response_length) if max_response_length else None
    cap_p = F.lit(max_prompt_length) if max_prompt_length else None
    stats = []
    for c, label in (("score", "score"), ("reward", "rewards")):
        v = F.when(alive, F.col(c))
        stats += [F.avg(v).alias(f"critic/{label}/mean"), F.max(v).alias(f"critic/{label}/max"),
                  F.min(v).alias(f"critic/{label}/min")]
    for c in tracked:
        stats += [(F.sum(f"{c}_sum") / F.sum("n")).alias(f"critic/{c}/mean"), F.max(f"{c}_max").alias(f"critic/{c}/max"),
                  F.min(f"{c}_min").alias(f"critic/{c}/min")]
    if use_critic:
        n = F.sum("n")
        var = lambda q, s: (F.sum(q) - F.sum(s) * F.sum(s) / n) / (n - 1)
        stats.append((1.0 - var("diff_sq", "diff") / (var("ret_sq", "returns_sum") + 1e-5)).alias("critic/vf_explained_var"))
    for col, label, cap in (("response_length", "response_length", cap_r), ("prompt_length", "prompt_length", cap_p)):
        top = cap if cap is not None else F.lit(None)
        stats += [F.avg(col).alias(f"{label}/mean"), F.max(col).cast("double").alias(f"{label}/max"),
                  F.min(col).cast("double").alias(f"{label}/min")]
        if cap is not None:
            stats.append(F.avg((F.col(col) == top).cast("double")).alias(f"{label}/clip_ratio"))
    alive_len = F.when(alive, F.col("response_length"))
    stats += [F.avg(alive_len).alias("response_length_non_aborted/mean"),
              F.max(alive_len).cast("double").alias("response_length_non_aborted/max"),
              F.min(alive_len).cast("double").alias("response_length_non_aborted/min"),
              F.avg((~alive).cast("double")).alias("response/aborted_ratio")]
    return rows.agg(*stats)


# Which data sources a sub-reward applies to (substring of the lower-cased source).
_3D = ("spatial_z", "spatial_3d", "3d", "scannet", "3rscan", "multi_view_3d")
_POINTS = ("spatial_xy", "correspondence", "point_correspondence", "multi_view_correspondence")
APPLICABLE = {
    "r_temporal_consistency": ("spatial_t", "temporal", "camera_motion", "cameramotion", "route_plan", "route",
                               "trajectory", "ego_motion"),
    "r_dynamic_camera": ("spatial_t", "temporal", "camera_motion", "cameramotion"),
    "r_depth_consistency": _3D,
    "r_proj": _3D,
    "r_3d_iou": _3D,
    "r_3d_iou_f1": _3D,
    "r_reprojection": _POINTS,
    "r_contrastive": _POINTS,
}


def sub_reward_stats(
    df: DataFrame, extras: str = "extras", source: str = "data_source", patterns: Mapping[str, Sequence[str]] = APPLICABLE
) -> DataFrame:
    """Mean, max and min of every numeric extra; listed keys only where their source applies.

    When no row of a listed key applies, all rows count, as if it were not listed.
    """
    long = df.select(F.lower(source).alias("src"), F.explode(extras).alias("key", "value"))
    applies = F.lit(True)
    for key, needles in patterns.items():
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.col("src").contains(needle)
        applies = F.when(F.col("key") == key, hit).otherwise(applies)
    v, on = F.col("value"), F.col("applies")
    only = lambda f: F.coalesce(f(F.when(on, v)), f(v))
    return long.withColumn("applies", applies).groupBy("key").agg(
        only(F.avg).alias("mean"), only(F.max).alias("max"), only(F.min).alias("min")
    )


def timing_metrics(timings: DataFrame, tokens: DataFrame, sections: Mapping[str, str]) -> DataFrame:
    """Seconds per section, and milliseconds per token where the section names a token column.

    ``tokens`` is one row per step holding token totals; ``timings`` has (step, section, seconds).
    """
    divisor = F.lit(None).cast("double")
    for section, column in sections.items():
        divisor = F.when(F.col("section") == section, F.col(column).cast("double")).otherwise(divisor)
    joined = timings.join(tokens, "step")
    return joined.select("step", "section", "seconds", (F.col("seconds") * 1000 / divisor).alias("ms_per_token"))


def throughput_metrics(df: DataFrame, tokens: str, seconds: str, workers: float) -> DataFrame:
    """One row: tokens, time per step, tokens per second and worker."""
    total, time = F.sum(tokens), F.max(seconds)
    return df.agg(total.cast("double").alias("total_num_tokens"), time.alias("time_per_step"),
                  (total / (time * workers)).alias("throughput"))


def variance_proxies(
    df: DataFrame, mask: str = "mask", weights: str | None = None, gradient_norm: float | None = None, row: Sequence[str] = ROW
) -> DataFrame:
    """Signal, power and noise proxies from squared advantages and the score-norm proxy."""
    names = ["old_logp", "sum_pi_squared", "advantages"] + ([weights] if weights else [])
    tokens = seq.flat(df, names, mask, row, outer=True)
    proxy = F.lit(1.0) - 2 * F.exp("old_logp") + F.col("sum_pi_squared")
    square = F.col(weights) * F.col(weights) if weights else F.lit(1.0)
    total = lambda x, name: F.sum(seq.masked(x, F.col(mask))).alias(name)
    parts = [total(F.col("advantages"), "adv"), total(proxy * square, "w"),
             total(proxy * square / F.greatest(square, F.lit(1e-10)), "orig"), F.sum(mask).cast("double").alias("n")]
    if weights:
        parts.append(total(F.col(weights), "rho"))
    rows = tokens.groupBy(*row).agg(*parts)
    a = F.col("adv") / (F.col("n") + EPS)
    rho = F.col("rho") / (F.col("n") + EPS) if weights else F.lit(1.0)
    base = F.greatest(F.col("orig") if weights else F.col("w"), F.lit(0.0))
    power = F.avg(rho * rho * a * a * base)
    signal = F.lit(float(gradient_norm**2) if gradient_norm is not None else 0.0)
    noise = F.lit(0.0)
    if gradient_norm is not None:
        rows_n = F.count(F.lit(1))
        noise = F.when(rows_n > 1, F.greatest(F.lit(0.0), (power - signal) / (rows_n - 1))).otherwise(0.0)
    return rows.agg(signal.alias("proxy1_signal_strength"), power.alias("proxy2_total_power"),
                    noise.alias("proxy3_pure_noise"), F.avg(a * a).alias("expected_a_squared"), F.avg("w").alias("expected_w"))


def logprob_diff_metrics(df: DataFrame, a: str, b: str, mask: str = "mask") -> DataFrame:
    """Absolute probability difference (max, mean, sample deviation) and correlation over valid tokens."""
    tokens = seq.flat(df, [a, b], mask).where(F.col(mask) != 0)
    p, q = F.exp(a), F.exp(b)
    diff = F.abs(p - q)
    return tokens.agg(F.lit(1).alias("valid"), F.max(diff).alias("diff_max"), F.avg(diff).alias("diff_mean"),
                      F.stddev_samp(diff).alias("diff_std"), F.corr(p, q).alias("pearson"))


def token_diff_count(a: str, b: str, mask: str = "mask") -> Column:
    """Number of valid positions of a row whose tokens differ."""
    differs = lambda e: ((e[a] != e[b]) & (e[mask] != 0)).cast("double")
    return seq.sum_over([a, b, mask], differs).cast("long")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(by..., q0, q1, ...): interpolated quantiles of each group's values that are not null, NaN last.

    A value's rank comes from its count: equal values are one row, ranks run on over key ranges, and a quantile needs the values at two
    ranks. So a group with most of the table is neither one buffer nor one sort.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    upto = running_total(counts, by, ["__x"], F.col("__c"), "__upto", rows_per_range=rows_per_range)
    placed = with_group_stats(upto, by, F.sum("__c").alias("__n")) if by else with_scalars(upto, upto.agg(F.sum("__c").alias("__n")))
    wanted = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("__n") - 1)
        holds = lambda rank: F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col("__x")))
        wanted.append(F.struct(holds(F.floor(at)).alias("lo"), holds(F.ceil(at)).alias("hi"), F.max(at - F.floor(at)).alias("f")).alias(f"q{i}"))
    found = placed.groupBy(*by).agg(*wanted)
    mix = lambda q: F.when(F.col(f"{q}.f") == 0, F.col(f"{q}.lo")).otherwise(F.col(f"{q}.lo") * (1 - F.col(f"{q}.f")) + F.col(f"{q}.hi") * F.col(f"{q}.f"))
    return found.select(*by, *[mix(f"q{i}").alias(f"q{i}") for i in range(len(shares))])


def percentile_report(df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """avg, max, min, tp50, tp95 and tp99; the approximate form keeps a bounded sketch per group, the exact one bounded ranges."""
    base = [F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min")]
    shares = {"tp50": 0.5, "tp95": 0.95, "tp99": 0.99}
    if not exact:
        return df.groupBy(*by).agg(*base, *[F.percentile_approx(value, F.lit(p), 10_000).alias(c) for c, p in shares.items()])
    found = exact_quantiles(df, value, list(shares.values()), by).withColumnsRenamed({f"q{i}": c for i, c in enumerate(shares)})
    report = df.groupBy(*by).agg(*base)
    return keyed_join(report, found, by, "left") if by else with_scalars(report, found)


def partial_rollout_stats(df: DataFrame, start: str, end: str, version: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of samples that span several versions, the widest span, and version diversity."""
    span = F.abs(F.col(end) - F.col(start))
    return df.groupBy(*by).agg(
        F.sum((span > 0).cast("long")).alias("partial"), (F.avg((span > 0).cast("double"))).alias("partial_ratio"),
        F.max(span).alias("max_span"), F.countDistinct(version).alias("versions"),
    )


def slowest_rollout(df: DataFrame, generation: str, tools: str, *carry: str, by: Sequence[str] = ()) -> DataFrame:
    """The row with the longest generation plus tool time, with the columns in ``carry``."""
    total = F.col(generation) + F.col(tools)
    best = F.max_by(F.struct(generation, tools, *carry), total)
    return df.groupBy(*by).agg(best.alias("s"), F.max(total).alias("slowest_total")).select(*by, "slowest_total", "s.*")


def length_unbalance(df: DataFrame, length: str, before: str, after: str) -> DataFrame:
    """Token totals per part under two assignments: min, max, difference, mean."""
    parts = F.explode(F.array(
        F.struct(F.lit("before").alias("stage"), F.col(before).cast("long").alias("part")),
        F.struct(F.lit("after").alias("stage"), F.col(after).cast("long").alias("part")),
    ))
    sums = df.select(length, parts.alias("a")).groupBy("a.stage", "a.part").agg(F.sum(length).alias("tokens"))
    return sums.groupBy("stage").agg(
        F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"),
        (F.max("tokens") - F.min("tokens")).alias("minmax_diff"), F.avg("tokens").alias("mean_tokens"),
    )


def flops_estimate(
    df: DataFrame, length: str, params: float, heads: int, head_dim: int, layers: int, seconds: float = 1.0
) -> DataFrame:
    """Dense-family training work in TFLOPs: 6 per parameter and token plus attention."""
    n, sq = F.sum(F.col(length).cast("double")), F.sum(F.col(length).cast("double") * F.col(length))
    dense = n * (6.0 * params)
    attention = sq * (12.0 * head_dim * heads * layers)
    return df.agg(n.alias("tokens"), (dense / 1e12).alias("dense_tflops"), (attention / 1e12).alias("attention_tflops"),
                  ((dense + attention) / seconds / 1e12).alias("tflops"))


def view_type_loss(
    df: DataFrame, loss: str, mask: str, view_type: str = "view_type", row: Sequence[str] = ROW
) -> DataFrame:
    """Loss sum, token count and sample count per view type; rows without valid tokens are left out."""
    tokens = seq.flat(df, [loss], mask, [view_type, *row]).where(F.col(mask) != 0)
    rows = tokens.groupBy(view_type, *row).agg(F.sum(loss).alias("s"), F.sum(mask).alias("n"))
    return rows.groupBy(view_type).agg(
        F.sum("s").alias("loss_sum"), F.sum("n").cast("long").alias("tokens"), F.count(F.lit(1)).alias("samples")
    )


def subsequence_loss(packs: DataFrame, loss: str = "loss", mask: str = "loss_mask", members: str = "members") -> DataFrame:
    """Mean over packed members of their token-mean loss; members without valid tokens are skipped."""
    ends = prefix_sum(F.transform(members, lambda m: m["len"].cast("double")))
    spans = F.arrays_zip(F.col(members).alias("m"), ends.alias("end"))
    each = packs.select(loss, mask, F.explode(spans).alias("x")).select(
        F.slice(loss, (F.col("x.end") - F.col("x.m.len") + 1).cast("int"), F.col("x.m.len").cast("int")).alias("l"),
        F.slice(mask, (F.col("x.end") - F.col("x.m.len") + 1).cast("int"), F.col("x.m.len").cast("int")).alias("k"),
    )
    per = each.select(seq.masked_sum("l", "k").alias("s"), seq.mask_count("k").alias("n")).where("n > 0")
    return per.agg(F.avg(F.col("s") / F.col("n")).alias("loss"), F.count(F.lit(1)).alias("members"))


def source_score(df: DataFrame, source: str = "data_source", item: str = "uid", score: str = "score") -> DataFrame:
    """Mean over items of the item's mean score, per source."""
    items = df.groupBy(source, item).agg(F.avg(score).alias("item_score"))
    return items.groupBy(source).agg(F.avg("item_score").alias("test_score"), F.count(F.lit(1)).alias("items"))


def workload(length: Column) -> Column:
    """Cost of one sequence: linear term plus attention."""
    return F.lit(24576) * length.cast("long") + length.cast("long") * length.cast("long")
