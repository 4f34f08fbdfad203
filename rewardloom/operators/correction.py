"""Off-policy correction: importance weights, rejection, veto and divergence reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rewardloom.functions import scan, seq
from rewardloom.functions.seq import EPS, TOKEN, clamp, masked
from rewardloom.operators.reduce import ROW
from rewardloom.plans.scale import with_scalars

BOUND = 20.0


def _ratio(e: Column) -> Column:
    return e["old_logp"] - e["rollout_logp"]


def _truncated(z: scan.Zipped, shared: bool, threshold: float) -> np.ndarray:
    """Truncated weight per token; as ``clamp`` skips nulls, a null ratio counts as the bound and a null weight as the threshold."""
    gap, null = z.values[0] - z.values[1], z.nulls[0] | z.nulls[1]
    if shared:
        total = scan.masked_sums(z, gap, null)
        gap, null = total.to_numpy(zero_copy_only=False)[z.row], total.is_null().to_numpy(zero_copy_only=False)[z.row]
    with np.errstate(invalid="ignore"):
        weight = np.exp(np.where(null, BOUND, np.clip(gap, -BOUND, BOUND)))
        return np.where(z.nulls[2], threshold, np.minimum(weight * z.values[2], threshold))


def _weight_lists(shared: bool, threshold: float):
    def run(old: pa.Array, rollout: pa.Array, mask: pa.Array, norm: pa.Array) -> pa.Array:
        z = scan.Zipped(old, rollout, mask)
        return z.lists(_truncated(z, shared, threshold) / norm.to_numpy(zero_copy_only=False)[z.row])

    # The number of arguments is read from the signature.
    return F.arrow_udf(lambda old, rollout, mask, norm: run(old, rollout, mask, norm), "array<double>")


def _weight_total(shared: bool, threshold: float):
    def run(old: pa.Array, rollout: pa.Array, mask: pa.Array) -> pa.Array:
        z = scan.Zipped(old, rollout, mask)
        return scan.masked_sums(z, _truncated(z, shared, threshold), np.zeros(len(z.row), bool))

    return F.arrow_udf(lambda old, rollout, mask: run(old, rollout, mask), "double")


def with_is_weights(
    df: DataFrame, level: str = "token", threshold: float = 2.0, batch_normalize: bool = False, mask: str = "mask",
    out: str = "is_weights",
) -> DataFrame:
    """Truncated importance weights per token; optionally divided by their batch mean."""
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown weight level: {level}")
    shared, names = level == "sequence", ["old_logp", "rollout_logp", mask]
    weights = _weight_lists(shared, float(threshold))
    if not batch_normalize:
        return df.withColumn(out, weights(*names, F.lit(1.0)))
    sums = df.select(_weight_total(shared, float(threshold))(*names).alias("s"), scan.total(mask).alias("n"))
    if level == "token":
        mean = sums.agg((F.sum("s") / (F.sum("n") + EPS)).alias("__norm"))
    else:
        mean = sums.agg(F.avg(F.when(F.col("n") > 0, F.col("s") / (F.col("n") + EPS))).alias("__norm"))
    norm = F.when(F.col("__norm") > EPS, F.col("__norm")).otherwise(1.0)
    return with_scalars(df, mean).withColumn(out, weights(*names, norm)).drop("__norm")


def _mask_kind(df: DataFrame, mask: str) -> tuple[T.DataType, pa.DataType]:
    """Type of a mask times a flag."""
    kind = df.select(F.transform(mask, lambda m: m * F.lit(1)).alias("m")).schema["m"].dataType
    return kind, to_arrow_type(kind.elementType)


def with_rejection_mask(
    df: DataFrame, level: str, upper: float, lower: float | None = None, mask: str = "mask", out: str = "mask"
) -> DataFrame:
    """Response mask with out-of-range tokens or whole rows removed; lower defaults to 1/upper.

    As ``clamp`` skips nulls, a null ratio counts as the upper bound; NaN is out of range.
    """
    lower = 1.0 / upper if lower is None else lower
    if level not in ("token", "sequence", "geometric"):
        raise ValueError(f"unknown correction level: {level}")
    kind, entry = _mask_kind(df, mask)

    def run(old: pa.Array, rollout: pa.Array, on: pa.Array) -> pa.Array:
        z = scan.Zipped(old, rollout, on)
        gap, null = z.values[0] - z.values[1], z.nulls[0] | z.nulls[1]
        if level != "token":
            total = scan.masked_sums(z, gap, null)
            gap, null = total.to_numpy(zero_copy_only=False), total.is_null().to_numpy(zero_copy_only=False)
            if level == "geometric":
                own = scan.Zipped(on)
                count = own.sums(own.values[0], own.nulls[0])
                gap, null = gap / (count.to_numpy(zero_copy_only=False) + EPS), null | count.is_null().to_numpy(zero_copy_only=False)
            gap, null = gap[z.row], null[z.row]
        with np.errstate(invalid="ignore"):
            weight = np.exp(np.where(null, BOUND, np.clip(gap, -BOUND, BOUND)))
            return z.lists(z.values[2] * ((weight >= lower) & (weight <= upper)), z.nulls[2], entry)

    # The number of arguments is read from the signature.
    return df.withColumn(out, F.arrow_udf(lambda old, rollout, on: run(old, rollout, on), kind)("old_logp", "rollout_logp", mask))


def with_veto(df: DataFrame, threshold: float, mask: str = "mask", out: str = "mask") -> DataFrame:
    """Whole row masked out when any valid token's ratio is below the threshold; null and NaN are not below it."""
    if threshold <= 0:
        raise ValueError("veto threshold must be positive")
    kind, entry = _mask_kind(df, out)
    edge = math.log(threshold)

    def run(old: pa.Array, rollout: pa.Array, on: pa.Array, taken: pa.Array) -> pa.Array:
        z, own = scan.Zipped(old, rollout, on), scan.Zipped(taken)
        with np.errstate(invalid="ignore"):
            bad = (z.values[0] - z.values[1] < edge) & (z.values[2] != 0) & ~(z.nulls[0] | z.nulls[1] | z.nulls[2])
        keep = np.bincount(z.row, bad, len(z.lengths)) == 0
        return own.lists(own.values[0] * keep[own.row], own.nulls[0], entry)

    return df.withColumn(out, F.arrow_udf(lambda old, rollout, on, taken: run(old, rollout, on, taken), kind)("old_logp", "rollout_logp", mask, out))


def veto_metrics(df: DataFrame, threshold: float, mask: str = "mask", row: Sequence[str] = ROW) -> DataFrame:
    tokens = seq.flat(df, ["old_logp", "rollout_logp"], mask, row, outer=True)
    bad = ((_ratio(TOKEN) < math.log(threshold)) & (F.col(mask) != 0)).cast("double")
    rows = tokens.groupBy(*row).agg(F.sum(F.coalesce(bad, F.lit(0.0))).alias("bad"), F.sum(mask).alias("n"))
    return rows.agg(
        F.avg((F.col("bad") > 0).cast("double")).alias("veto_fraction"),
        (F.sum("bad") / (F.sum("n") + EPS)).alias("catastrophic_token_fraction"),
    )


def _token_rows(df: DataFrame, upper: float, lower: float, mask: str, row: Sequence[str]) -> DataFrame:
    """Per row: sums of token weights and of their indicator and bounded forms."""
    tokens = seq.flat(df, ["old_logp", "rollout_logp"], mask, row, outer=True)
    w = F.exp(clamp(_ratio(TOKEN), -BOUND, BOUND))
    tokens = tokens.withColumn("__w", F.when(F.col(mask) != 0, w))
    w = F.col("__w")
    bounded = F.when(F.col(mask) != 0, clamp(w, lower, upper))
    count = lambda c: F.sum(F.coalesce(c.cast("double"), F.lit(0.0)))
    return tokens.groupBy(*row).agg(
        F.sum(mask).cast("double").alias("n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("w"),
        count(w > upper).alias("hi"), count(w < lower).alias("lo"), F.max(w).alias("max"), F.min(w).alias("min"),
        F.sum(bounded).alias("c"), F.sum(bounded * bounded).alias("c2"),
        count(~((w >= lower) & (w <= upper))).alias("out"),
    )


def _shared_rows(df: DataFrame, level: str, upper: float, lower: float, mask: str, row: Sequence[str]) -> DataFrame:
    """The same when all tokens of a row share one weight."""
    tokens = seq.flat(df, ["old_logp", "rollout_logp"], mask, row, outer=True)
    rows = tokens.groupBy(*row).agg(
        F.sum(mask).cast("double").alias("n"), F.sum(masked(_ratio(TOKEN), F.col(mask))).alias("d")
    )
    lr = F.col("d") if level == "sequence" else F.col("d") / (F.col("n") + EPS)
    rows = rows.withColumn("__lr", lr).withColumn("v", F.exp(clamp(F.col("__lr"), -BOUND, BOUND)))
    n, v, bounded = F.col("n"), F.col("v"), clamp(F.col("v"), lower, upper)
    return rows.select(
        "__lr", "v", "n", (v * n).alias("w"), (bounded * n).alias("c"), (bounded * bounded * n).alias("c2"),
        F.when((v >= lower) & (v <= upper), 0.0).otherwise(n).alias("out"),
    )


def _weight_report(df: DataFrame, level: str, upper: float, lower: float, mask: str, row: Sequence[str]) -> DataFrame:
    """Weight statistics: tokens to rows to one row."""
    if level == "token":
        rows = _token_rows(df, upper, lower, mask, row)
    elif level in ("sequence", "geometric"):
        rows = _shared_rows(df, level, upper, lower, mask, row)
    else:
        raise ValueError(f"unknown correction level: {level}")
    n = F.sum("n")
    mean_c = F.sum("c") / (n + EPS)
    second = F.sum("c2") / (n + EPS)
    seq_mean = F.col("w") / (F.col("n") + EPS)
    if level == "token":
        top, low = F.max("max"), F.min("min")
        high, small = F.sum("hi") / (n + EPS), F.sum("lo") / (n + EPS)
        seq_out = F.avg((F.col("out") > 0).cast("double"))
    else:
        top, low = F.exp(F.least(F.max("__lr"), F.lit(BOUND))), F.exp(F.min("__lr"))
        high = F.avg((F.col("__lr") > math.log(upper)).cast("double"))
        small = F.avg((F.col("__lr") < math.log(lower)).cast("double"))
        seq_out = F.avg((~((F.col("v") >= lower) & (F.col("v") <= upper))).cast("double"))
    return rows.agg(
        (F.sum("w") / (n + EPS)).alias("mean"), top.alias("max"), low.alias("min"),
        high.alias("ratio_fraction_high"), small.alias("ratio_fraction_low"),
        F.when(n > 1, F.sqrt(F.greatest(second - mean_c * mean_c, F.lit(0.0)))).otherwise(0.0).alias("std"),
        (F.lit(1.0) / (second / ((mean_c + EPS) * (mean_c + EPS)))).alias("eff_sample_size"),
        F.avg(seq_mean).alias("seq_mean"), F.coalesce(F.stddev_samp(seq_mean), F.lit(0.0)).alias("seq_std"),
        F.max(seq_mean).alias("seq_max"), F.min(seq_mean).alias("seq_min"),
        F.max(F.abs(seq_mean - 1.0)).alias("seq_max_deviation"),
        F.avg((seq_mean > upper).cast("double")).alias("seq_fraction_high"),
        F.avg((seq_mean < lower).cast("double")).alias("seq_fraction_low"),
        (F.sum("out") / (n + EPS)).alias("masked_fraction"), seq_out.alias("seq_masked_fraction"),
    )


def is_metrics(
    df: DataFrame, level: str = "token", threshold: float = 2.0, mask: str = "mask", row: Sequence[str] = ROW
) -> DataFrame:
    """Statistics of importance weights before truncation."""
    report = _weight_report(df, level, threshold, 1.0 / threshold, mask, row)
    return report.drop("masked_fraction", "seq_masked_fraction")


def rs_metrics(
    df: DataFrame, level: str, upper: float, lower: float | None = None, mask: str = "mask", row: Sequence[str] = ROW
) -> DataFrame:
    """The same for rejection, with the rejected share of tokens and rows."""
    return _weight_report(df, level, upper, 1.0 / upper if lower is None else lower, mask, row)


def offpolicy_metrics(df: DataFrame, mask: str = "mask", row: Sequence[str] = ROW) -> DataFrame:
    """Perplexities, divergence estimates and chi-squared between the two policies."""
    tokens = seq.flat(df, ["old_logp", "rollout_logp"], mask, row, outer=True)
    gap = _ratio(TOKEN)
    safe = F.exp(clamp(gap, -BOUND, BOUND))
    total = lambda c, name: F.sum(masked(c, F.col(mask))).alias(name)
    rows = tokens.groupBy(*row).agg(
        F.sum(mask).cast("double").alias("n"), total(F.col("old_logp"), "t"), total(F.col("rollout_logp"), "r"),
        total(F.exp(gap) - gap - 1.0, "k3"), total(safe * safe, "sq"),
    )
    mt, mr = F.col("t") / (F.col("n") + EPS), F.col("r") / (F.col("n") + EPS)
    diff = mr - mt
    n = F.sum("n") + EPS
    seq_ratio = clamp(F.col("t") - F.col("r"), -BOUND, BOUND)
    return rows.agg(
        F.avg(F.exp(-mt)).alias("training_ppl"), F.avg(-mt).alias("training_log_ppl"),
        ((F.sum("r") - F.sum("t")) / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"),
        F.avg(F.exp(-mr)).alias("rollout_ppl"), F.avg(-mr).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"), (F.sum("sq") / n - 1.0).alias("chi2_token"),
        (F.avg(F.exp(seq_ratio * 2.0)) - 1.0).alias("chi2_seq"),
    )


@dataclass(frozen=True)
class Correction:
    """Parameters of one correction run."""

    is_level: str | None = "sequence"
    is_threshold: float = 2.0
    rs_level: str | None = None
    rs_upper: float | None = None
    rs_lower: float | None = None
    veto: float | None = None
    batch_normalize: bool = False
    bypass: bool = False
    policy_gradient: bool = False


_NONE = Correction(is_level=None)
_GEO = replace(_NONE, rs_level="geometric", rs_upper=1.001, veto=1e-4)
PRESETS = {
    "decoupled_token_is": replace(_NONE, is_level="token"),
    "decoupled_seq_is": replace(_NONE, is_level="sequence"),
    "decoupled_seq_is_rs": replace(_NONE, is_level="sequence", rs_level="sequence", rs_upper=2.0),
    "decoupled_geo_rs": _GEO,
    "geo_rs_seq_tis": replace(_GEO, is_level="sequence"),
    "bypass_ppo_clip": replace(_NONE, bypass=True),
    "bypass_ppo_clip_geo_rs": replace(_GEO, bypass=True),
    "bypass_pg_is": replace(_NONE, is_level="sequence", bypass=True, policy_gradient=True),
    "bypass_pg_rs": replace(_GEO, bypass=True, policy_gradient=True),
    "bypass_pg_geo_rs_seq_tis": replace(_GEO, is_level="sequence", bypass=True, policy_gradient=True),
    "disabled": _NONE,
}


def preset(name: str, **changes) -> Correction:
    if name not in PRESETS:
        raise ValueError(f"unknown correction preset: {name}")
    return replace(PRESETS[name], **changes)


def rollout_correction(df: DataFrame, config: Correction, mask: str = "mask") -> tuple[DataFrame, DataFrame]:
    """Rows with ``is_weights`` and the reduced mask, and the prefixed one-row report."""
    out = df.withColumn("__mask", F.col(mask))
    reports = [(offpolicy_metrics(df, mask), "")]
    if config.is_level:
        out = with_is_weights(out, config.is_level, config.is_threshold, config.batch_normalize, mask)
        reports.append((is_metrics(df, config.is_level, config.is_threshold, mask), "rollout_is_"))
    if config.rs_level:
        if config.rs_upper is None:
            raise ValueError("rejection needs an upper threshold")
        out = with_rejection_mask(out, config.rs_level, config.rs_upper, config.rs_lower, mask, "__mask")
        reports.append((rs_metrics(df, config.rs_level, config.rs_upper, config.rs_lower, mask), "rollout_rs_"))
    if config.veto:
        out = with_veto(out, config.veto, mask, "__mask")
        reports.append((veto_metrics(df, config.veto, mask), "rollout_is_"))
    row = df.sparkSession.range(1).select()
    for table, prefix in reports:
        named = table.toDF(*[f"rollout_corr/{prefix}{c}" for c in table.columns])
        row = with_scalars(row, named)
    return out.drop(mask).withColumnRenamed("__mask", mask), row


def bypass_old_logp(df: DataFrame) -> DataFrame:
    """Take the rollout policy's log-probabilities as the old ones."""
    return df.withColumn("old_logp", F.col("rollout_logp"))
