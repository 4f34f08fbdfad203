"""Forward values of policy, value and supervised objectives with their metrics.

Each objective is one aggregate over unnested tokens, by row first where its mode averages rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rewardloom.functions import scan, seq
from rewardloom.functions.kl import kl_penalty
from rewardloom.functions.seq import EPS, TOKEN, clamp, masked
from rewardloom.operators.reduce import ROW, agg_loss, loss_aggregate
from rewardloom.plans.scale import ROWS_PER_RANGE, nth_row, seeded_key, with_scalars

OBJECTIVES: dict[str, Callable[..., DataFrame]] = {}


def register_objective(name: str):
    def add(fn):
        if OBJECTIVES.get(name, fn) is not fn:
            raise ValueError(f"objective {name} is already registered")
        OBJECTIVES[name] = fn
        return fn

    return add


def objective(name: str) -> Callable[..., DataFrame]:
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective: {name}; known: {sorted(OBJECTIVES)}")
    return OBJECTIVES[name]


def _gap(e: Column) -> Column:
    return e["logp"] - e["old_logp"]


def _safe_gap(e: Column) -> Column:
    return clamp(_gap(e), -20.0, 20.0)


def _report(
    df: DataFrame, loss, metrics: dict, mask: str, mode: str, weights: str | None, names=(), keep=(), row=ROW, **options
) -> DataFrame:
    """Aggregate a token loss and masked-mean metrics into one row."""
    columns = list(dict.fromkeys(["logp", "old_logp", "advantages", *names] + ([weights] if weights else [])))
    token_level = mode == "token-mean"
    tokens = seq.flat(df, columns, mask, keep=keep if token_level else [*row, *keep])
    value = loss(TOKEN) * F.col(weights) if weights else loss(TOKEN)
    total = lambda c, name: F.sum(masked(c.cast("double"), F.col(mask))).alias(name)
    sums = [total(value, "loss"), F.sum(mask).cast("double").alias("n"), F.count(F.lit(1)).alias("width")]
    sums += [total(f(TOKEN), f"m_{name}") for name, f in metrics.items()]
    rows = tokens.agg(*sums) if token_level else tokens.groupBy(*row).agg(*sums)
    out = [loss_aggregate(F.col("loss"), F.col("n"), F.col("width"), mode, **options).alias("pg_loss")]
    out += [(F.sum(f"m_{m}") / (F.sum("n") + EPS)).alias(m) for m in metrics]
    return rows.agg(*out)


def _clip(x: Column, low: float, high: float) -> Column:
    return clamp(x, 1 - low, 1 + high)


@register_objective("vanilla")
def loss_vanilla(
    df, low=0.2, high=0.2, dual_clip=3.0, mask="mask", mode="token-mean", weights=None, **options
) -> DataFrame:
    """Clipped surrogate with a lower bound for negative advantages."""
    ratio = lambda e: F.exp(_safe_gap(e))
    plain = lambda e: -e["advantages"] * ratio(e)
    clipped = lambda e: -e["advantages"] * _clip(ratio(e), low, high)
    worst = lambda e: F.greatest(plain(e), clipped(e))
    bound = lambda e: -e["advantages"] * dual_clip
    loss = lambda e: F.when(e["advantages"] < 0, F.least(bound(e), worst(e))).otherwise(worst(e))
    return _report(df, loss, {
        "pg_clipfrac": lambda e: clipped(e) > plain(e),
        "ppo_kl": lambda e: -_safe_gap(e),
        "pg_clipfrac_lower": lambda e: (worst(e) > bound(e)) & (e["advantages"] < 0),
    }, mask, mode, weights, **options)


def _with_row_gap(df: DataFrame, mask: str) -> DataFrame:
    total = seq.sum_over(["logp", "old_logp", mask], lambda e: _gap(e) * e[mask])
    return df.withColumn("__gap", total / F.greatest(seq.mask_count(mask), F.lit(1.0)))


@register_objective("gspo")
def loss_gspo(df, low=0.2, high=0.2, mask="mask", weights=None, mode=None, **options) -> DataFrame:
    """One ratio per sequence; always averaged sequence by sequence."""
    df = _with_row_gap(df, mask)
    ratio = F.exp(clamp(F.col("__gap"), hi=10.0))
    plain = lambda e: -e["advantages"] * ratio
    clipped = lambda e: -e["advantages"] * _clip(ratio, low, high)
    return _report(df, lambda e: F.greatest(plain(e), clipped(e)), {
        "pg_clipfrac": lambda e: clipped(e) > plain(e), "ppo_kl": lambda e: -F.col("__gap"),
    }, mask, "seq-mean-token-mean", weights, keep=["__gap"], **options)


@register_objective("sapo")
def loss_sapo(df, tau_pos=1.0, tau_neg=1.05, mask="mask", weights=None, mode=None, **options) -> DataFrame:
    """Sigmoid gate on the ratio with a temperature per advantage sign."""

    def loss(e):
        tau = F.when(e["advantages"] > 0, F.lit(float(tau_pos))).otherwise(F.lit(float(tau_neg)))
        x = tau * (F.exp(_safe_gap(e)) - 1.0)
        return -(F.lit(1.0) / (F.lit(1.0) + F.exp(-x))) * (F.lit(4.0) / tau) * e["advantages"]

    return _report(df, loss, {"ppo_kl": lambda e: -_safe_gap(e)}, mask, "seq-mean-token-mean", weights, **options)


@register_objective("gpg")
def loss_gpg(df, mask="mask", mode="token-mean", weights=None, **options) -> DataFrame:
    return _report(df, lambda e: -e["logp"] * e["advantages"], {}, mask, mode, weights, **options)


def _some(values: np.ndarray, null: np.ndarray) -> float | None:
    """Sum of what is not null; null where nothing is."""
    return None if null.all() else float(values[~null].sum())


def _whole_means(df: DataFrame, lists: list[str], mask: str) -> Row:
    """Masked means of ``advantages`` and ``logp`` over the tokens of ``lists`` side by side, and ``valid``, the sum of all masks.

    A row with a null list has no tokens, yet its mask counts.
    """

    def run(batches):
        for batch in batches:
            z = scan.Zipped(*[batch.column(c) for c in [*lists, mask]])
            m, gone = z.values[-1], z.nulls[-1]
            sums = [_some(z.values[lists.index(c)] * m, z.nulls[lists.index(c)] | gone) for c in ("advantages", "logp")]
            yield pa.record_batch([pa.array([v], pa.float64()) for v in (*sums, _some(m, gone), pc.sum(batch.column(mask).flatten()).as_py())], names=["a", "l", "n", "valid"])

    parts = df.select(*lists, mask).mapInArrow(run, "a double, l double, n double, valid double")
    n = F.sum("n") + EPS
    return parts.agg((F.sum("a") / n).alias("advantages"), (F.sum("l") / n).alias("logp"), F.sum("valid").alias("valid")).first()


def _token_rows(df: DataFrame, row: list[str], mask: str, weights: str | None) -> DataFrame:
    names = ["logp", "old_logp", "advantages", mask] + ([weights] if weights else [])
    long = df.select(*row, F.posexplode(seq.zipped(*names)).alias("pos", "e"))
    cols = [F.col(f"e.{n}").alias(n if n != mask else "m") for n in names]
    return long.select(*row, "pos", *cols).withColumn("gap", F.col("logp") - F.col("old_logp"))


def _long_loss(tokens: DataFrame, row: list[str], mode: str, **options) -> DataFrame:
    if mode == "token-mean" and not options:
        return tokens.agg((F.sum(F.col("loss") * F.col("m")) / F.sum("m")).alias("pg_loss"))
    per = tokens.groupBy(*row).agg(F.sum(F.col("loss") * F.col("m")).alias("s"), F.sum("m").cast("double").alias("n"),
                                   F.count(F.lit(1)).alias("w"))
    return per.agg(loss_aggregate(F.col("s"), F.col("n"), F.col("w"), mode, **options).alias("pg_loss"))


@register_objective("clip_cov")
def loss_clip_cov(
    df, ratio=0.0002, low=0.2, high=0.2, lower=1.0, upper=5.0, row=("uid", "rollout_n"), seed=0, mask="mask",
    mode="token-mean", weights=None, **options,
) -> DataFrame:
    """Drops the loss of a seeded sample of tokens whose covariance lies in (lower, upper).

    The sample is the candidates with the smallest seeded keys. Sums by a key's first digits tell which digits the last of them
    has; only candidates with these are put in order. A mean over tokens takes three passes, other modes four; only candidates are rows.
    """
    row = list(row)
    lists = ["logp", "old_logp", "advantages"] + ([weights] if weights else [])
    whole = _whole_means(df, lists, mask)
    by_token = mode == "token-mean" and not options
    candidates = _candidates(df, row, lists, mask, whole, (1 - low, 1 + high), (lower, upper), not by_token)
    keyed = candidates.withColumn("key", F.when(F.col("pos").isNotNull(), seeded_key(seed, *row, "pos")))
    valid = int(whole.valid or 0)
    groups, edge = _smallest_keys(keyed, max(int(ratio * valid), 1), valid)
    known = lambda values: F.lit(sum(v) if (v := [x for x in values if x is not None]) else None).cast("double")
    n = known(g.m for g in groups)
    result = df.sparkSession.range(1).select(
        (known(g.gone for g in groups) / (n + EPS)).alias("pg_clipfrac"), (known(g.kl for g in groups) / (n + EPS)).alias("ppo_kl"))
    if by_token:
        return result.select((known(g.loss for g in groups) / n).alias("pg_loss"), "*")
    off = F.coalesce(F.col("key") <= F.lit(edge).cast("string"), F.lit(False))
    per = keyed.groupBy(*row).agg(F.sum(F.when(off, F.col("off")).otherwise(F.col("on"))).alias("s"), F.sum("m").alias("n"), F.sum("w").alias("w"))
    loss = loss_aggregate(F.col("s"), F.col("n"), F.col("w"), mode, **options).alias("pg_loss")
    return with_scalars(per.agg(loss), result)


def _candidates(
    df: DataFrame, row: list[str], lists: list[str], mask: str, whole: Row, clip: tuple[float, float], cov: tuple[float, float], by_row: bool
) -> DataFrame:
    """(row, pos, on, off, m, kl, w) for each token that may lose its loss, and for all others together: one row of sums without ``pos``.

    ``on`` and ``off`` are the masked loss of a token that keeps or loses it, ``w`` counts tokens; the others come together by row or
    by batch. Nulls and NaN count as in expressions: a null ratio is clipped to the upper bound, NaN is the largest number.
    """

    def run(batches):
        for batch in batches:
            z = scan.Zipped(*[batch.column(c) for c in [*lists, mask]])
            if not len(z.row):
                continue
            (logp, old, adv, m), (no_l, no_o, no_a, no_m) = ([x[0], x[1], x[2], x[-1]] for x in (z.values, z.nulls))
            no_gap = no_l | no_o
            with np.errstate(all="ignore"):
                gap = logp - old
                r = np.exp(gap)
                plain, clipped = -adv * r, -adv * np.where(no_gap, clip[1], np.clip(r, *clip))
                value = np.where(no_gap, clipped, np.maximum(plain, clipped))
                zero, empty = np.zeros(len(adv)), no_a
                if len(lists) > 3:
                    value, zero, empty = value * z.values[3], zero * z.values[3], no_a | z.nulls[3]
                spread = (adv - (whole.advantages or 0.0)) * (logp - (whole.logp or 0.0))
                kept = (m > 0) | np.isnan(m)
                may = kept & ((clipped <= plain) | np.isnan(plain)) & (spread < cov[1]) & (spread > cov[0]) & ~(no_gap | no_a | no_m)
                if whole.advantages is None or whole.logp is None:
                    may[:] = False
                sums = [(value * m, empty | no_m), (zero * m, empty | no_m), (m, no_m), (-gap * m, no_gap | no_m), (np.ones(len(m)), np.zeros(len(m), bool))]
            at, rest = np.flatnonzero(may), np.flatnonzero(~may)
            yield pa.record_batch([*(batch.column(c).take(pa.array(z.row[at])) for c in row), pa.array(z.place()[at], pa.int32()),
                                   *(pa.array(v[at], pa.float64(), mask=g[at]) for v, g in sums)], names=names)
            if by_row:
                own, code = np.unique(z.row[rest], return_inverse=True)
                add = lambda v, g, code=code, own=own: pa.array(np.bincount(code, np.where(g, 0.0, v), len(own)), mask=np.bincount(code, ~g, len(own)) == 0)
                keys = [batch.column(c).take(pa.array(own)) for c in row]
            else:
                own = np.zeros(1)
                add = lambda v, g: pa.array([_some(v, g)], pa.float64())
                keys = [pa.nulls(1, batch.column(c).type) for c in row]
            yield pa.record_batch([*keys, pa.nulls(len(own), pa.int32()), *(add(v[rest], g[rest]) for v, g in sums)], names=names)

    kinds = dict(df.dtypes)
    names = [*row, "pos", "on", "off", "m", "kl", "w"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in row), "pos int, on double, off double, m double, kl double, w double"])
    return df.select(*row, *lists, mask).mapInArrow(run, schema)


def _smallest_keys(keyed: DataFrame, count: int, rows: int) -> tuple[list[Row], str | None]:
    """Sums (loss, m, gone, kl) of all tokens in parts, where the ``count`` tokens with the smallest keys have the loss ``off``, and the last such key.

    Keys are digests, so candidates spread evenly over the first digits; of about ``rows`` tokens at most ``ROWS_PER_RANGE`` share them.
    Tokens with equal keys are dropped together.
    """
    sums = [F.count("key").alias("c"), *[F.sum(c).alias(c) for c in ("on", "off", "m", "kl")], F.max("key").alias("last")]
    digits = max(0, math.ceil(math.log(max(rows, 1) / ROWS_PER_RANGE, 16)))
    head = F.when(F.col("key").isNotNull(), F.substring("key", 1, digits))
    parts, edge = [], None
    for g in sorted(keyed.groupBy(head.alias("head")).agg(*sums).collect(), key=lambda g: (g.head is None, g.head)):
        if g.head is not None and 0 < count < g.c:
            before = F.sum("c").over(Window.orderBy("key")) - F.col("c")
            inside = keyed.where(head == g.head).groupBy("key").agg(*sums).withColumn("gone", before < count)
            pick = lambda yes, no: F.sum(F.when(F.col("gone"), yes).otherwise(no))
            part = inside.agg(pick(F.col("off"), F.col("on")).alias("loss"), F.sum("m").alias("m"), pick(F.col("m"), F.lit(0.0)).alias("gone"),
                              F.sum("kl").alias("kl"), F.max(F.when(F.col("gone"), F.col("key"))).alias("last")).first()
            count, edge = 0, part.last
        elif g.head is not None and count > 0:
            part, edge = Row(loss=g.off, m=g.m, gone=g.m, kl=g.kl), g.last
            count -= g.c
        else:
            part = Row(loss=g.on, m=g.m, gone=0.0, kl=g.kl)
        parts.append(part)
    return parts, edge


@register_objective("kl_cov")
def loss_kl_cov(
    df, ratio=0.0002, kl_coef=1.0, row=("uid", "rollout_n"), mask="mask", mode="token-mean", weights=None, **options
) -> DataFrame:
    """Adds the absolute divergence to the loss of the tokens with the largest covariance."""
    row = list(row)
    tokens = _token_rows(df, row, mask, weights)
    # One pass for every figure of the whole table; the rest takes them as constants.
    on = lambda c: F.when(F.col("m") > 0, c)
    whole = tokens.agg(F.avg(on(F.col("advantages"))).alias("ma"), F.avg(on(F.col("logp"))).alias("ml"), F.sum("m").alias("n"),
                       (F.sum(on(F.abs("gap"))) / (F.sum(on(F.col("m"))) + EPS)).alias("kl")).first()
    known = lambda v: F.lit(v).cast("double")
    covered = tokens.where("m > 0").withColumn("cov", (F.col("advantages") - known(whole.ma)) * (F.col("logp") - known(whole.ml)))
    count = max(1, int((whole.n or 0) * ratio))
    edge = nth_row(covered, ["cov desc", *row, "pos"], count, max(1, int(whole.n or 0)))
    edge = edge.select(F.struct((-F.col("cov")).alias("c0"), *[F.col(c) for c in row], "pos").alias("__edge"))
    marked = with_scalars(covered, edge)
    own = F.struct((-F.col("cov")).alias("c0"), *[F.col(c) for c in row], F.col("pos"))
    plain = -F.col("advantages") * F.exp("gap")
    loss = plain + F.when(own <= F.col("__edge"), kl_coef * F.abs("gap")).otherwise(0.0)
    final = marked.withColumn("loss", loss * F.col(weights) if weights else loss)
    return _long_loss(final, row, mode, **options).withColumn("ppo_kl", known(whole.kl))


@register_objective("geo_mean")
def loss_geo_mean(df, low=0.2, high=0.2, mask="mask", weights=None, mode=None, row=ROW, **options) -> DataFrame:
    """Geometric-mean ratio per sequence with a sign-aware clamp of the log ratio."""
    tokens = seq.flat(df, ["logp", "old_logp", "advantages"] + ([weights] if weights else []), mask, row, outer=True)
    gap, adv, m = _gap(TOKEN), F.col("advantages"), F.col(mask)
    cut, sign = clamp(gap, -low, high), F.signum("advantages")
    total = lambda c, name: F.sum(masked(c.cast("double"), m)).alias(name)
    parts = [F.sum(mask).cast("double").alias("n"), total(sign * F.least(sign * gap, sign * cut), "g"), total(adv, "a"),
             total(-gap, "kl"), total((gap != cut) & (adv > 0), "up"), total((gap != cut) & (adv < 0), "down")]
    if weights:
        parts.append(total(F.log(F.col(weights) + 1e-10), "w"))
    rows = tokens.groupBy(*row).agg(*parts)
    n = F.col("n") + EPS
    loss = -(F.col("a") / n) * F.exp(F.col("g") / n)
    if weights:
        loss = loss * F.exp(F.col("w") / n)
    total = F.sum("n") + EPS
    return rows.agg(F.avg(loss).alias("pg_loss"), (F.sum("up") / total).alias("pg_clipfrac"),
                    (F.sum("kl") / total).alias("ppo_kl"), (F.sum("down") / total).alias("pg_clipfrac_lower"))


@register_objective("cispo")
def loss_cispo(df, low=0.2, high=0.2, mask="mask", mode="token-mean", weights=None, **options) -> DataFrame:
    """Clipped ratio as a constant weight on the log-probability."""
    ratio = lambda e: F.exp(_safe_gap(e))
    return _report(df, lambda e: -_clip(ratio(e), low, high) * e["advantages"] * e["logp"], {
        "pg_clipfrac": lambda e: ratio(e) != _clip(ratio(e), low, high), "ppo_kl": lambda e: -_safe_gap(e),
    }, mask, mode, weights, **options)


@register_objective("reinforce")
def loss_reinforce(df, mask="mask", mode="token-mean", weights=None, **options) -> DataFrame:
    """Log-probability times advantage, optionally importance weighted."""
    return _report(df, lambda e: -e["advantages"] * e["logp"], {
        "ppo_kl": lambda e: e["rollout_logp"] - e["logp"],
    }, mask, mode, weights, names=["rollout_logp"], **options)


def value_loss(df, clip: float, mask="mask", predicted="vpreds", mode="token-mean", row=ROW, **options) -> DataFrame:
    """Half the worse of the clipped and unclipped squared errors."""
    cut = lambda e: clamp(e[predicted], e["values"] - clip, e["values"] + clip)
    square = lambda x: x * x
    plain = lambda e: square(e[predicted] - e["returns"])
    clipped = lambda e: square(cut(e) - e["returns"])
    token_level = mode == "token-mean"
    tokens = seq.flat(df, [predicted, "values", "returns"], mask, keep=() if token_level else row)
    total = lambda c, name: F.sum(masked(c.cast("double"), F.col(mask))).alias(name)
    sums = [total(F.greatest(plain(TOKEN), clipped(TOKEN)), "loss"), F.sum(mask).cast("double").alias("n"),
            F.count(F.lit(1)).alias("width"), total(clipped(TOKEN) > plain(TOKEN), "c")]
    rows = tokens.agg(*sums) if token_level else tokens.groupBy(*row).agg(*sums)
    loss = loss_aggregate(F.col("loss"), F.col("n"), F.col("width"), mode, **options) * 0.5
    return rows.agg(loss.alias("vf_loss"), (F.sum("c") / (F.sum("n") + EPS)).alias("vf_clipfrac"))


def entropy_loss(df: DataFrame, entropy: str = "entropy", mask: str = "mask", mode: str = "token-mean", **options):
    return agg_loss(df, entropy, mask, mode, **options)


def sft_nll(df: DataFrame, mask: str = "loss_mask", batch_num_tokens: float | None = None, dp_size: float = 1.0):
    """Negative log-likelihood under the mask shifted left by one inside each row."""
    shifted = F.concat(F.slice(mask, F.lit(2), F.size(mask) - 1), F.array(F.lit(0)))
    df = df.where(F.size(mask) > 0).withColumn("__m", shifted)
    tokens = seq.flat(df, ["logp"], "__m")
    rows = tokens.agg(F.sum(masked(F.col("logp"), F.col("__m"))).alias("s"), F.sum("__m").alias("n"))
    total = F.lit(batch_num_tokens) if batch_num_tokens else F.sum("n")
    return rows.agg((-F.sum("s") / total * dp_size).alias("loss"), F.sum("n").cast("long").alias("tokens"))


def total_objective(
    df: DataFrame, policy: str = "vanilla", entropy_coeff: float = 0.0, kl_coef: float = 0.0, kl_kind: str = "low_var_kl",
    mask: str = "mask", mode: str = "token-mean", **policy_options,
) -> DataFrame:
    """Policy objective minus the entropy bonus plus the reference penalty, with each part."""
    out = objective(policy)(df, mask=mask, mode=mode, **policy_options)
    total = F.col("pg_loss")
    if entropy_coeff:
        out = with_scalars(out, entropy_loss(df, mask=mask, mode=mode).toDF("entropy"))
        total = total - entropy_coeff * F.col("entropy")
    if kl_coef:
        kl = df.withColumn("__kl", F.zip_with("logp", "ref_logp", lambda a, b: kl_penalty(a, b, kl_kind)))
        out = with_scalars(out, agg_loss(kl, "__kl", mask, mode).toDF("kl_loss"))
        total = total + kl_coef * F.col("kl_loss")
    return out.withColumn("loss", total)
