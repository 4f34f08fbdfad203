"""Literal fixtures, equivalences and invariances of estimators, corrections and objectives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.operators import advantage as A
from rewardloom.operators import correction as C
from rewardloom.operators import objective as L
from rewardloom.operators import reduce as M


def scored(spark, rows):
    df = spark.createDataFrame([(i, u, float(s)) for i, (u, s) in enumerate(rows)], "row_idx long, uid string, score double")
    return df.withColumn("mask", F.array(F.lit(1), F.lit(1), F.lit(0)))


def values(df, column="advantage"):
    return {r.row_idx: r[column] for r in df.collect()}


def test_group_table_singletons(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0)], "score double, idx int")
    got = {r.idx: (r.group_mean, round(r.group_std, 6), r.group_size) for r in M.group_table(df, "idx", "score").collect()}
    assert got == {0: (2.0, round(math.sqrt(2), 6), 2), 1: (0.0, 1.0, 1)}
    assert M.group_table(df.where("false"), "idx", "score").count() == 0


def test_singletons_differ_between_rloo_forms(spark):
    df = scored(spark, [("a", 3), ("b", 1), ("b", 2)])
    assert values(A.rloo(df, score="score")) == {0: 3.0, 1: -1.0, 2: 1.0}
    assert values(A.rloo_vectorized(df, score="score")) == {0: 0.0, 1: -1.0, 2: 1.0}


def test_plain_and_vectorised_grpo_agree(spark):
    rng = np.random.default_rng(0)
    df = scored(spark, [(str(i % 5), s) for i, s in enumerate(rng.normal(size=64))])
    a, b = values(A.grpo(df, score="score")), values(A.grpo_vectorized(df, score="score"))
    assert all(abs(a[i] - b[i]) < 1e-5 for i in a)


def test_passk_credits_only_the_best_and_rejects_lone_rows(spark):
    df = scored(spark, [("a", 1), ("a", 5), ("a", 5), ("b", 2), ("b", 0)])
    got = values(A.grpo_passk(df, score="score", norm_by_std=False))
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 2.0, 4: 0.0}
    with pytest.raises(Exception, match="at least two"):
        A.grpo_passk(scored(spark, [("a", 1)]), score="score").collect()


def gae_rows(spark, noise):
    rewards = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1.0, 0, 0]
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rng = np.random.default_rng(1)
    base = rng.normal(size=11)
    vals = [float(b if m else b + noise) for b, m in zip(base, mask)]
    rows = [(0, [float(r) for r in rewards], vals, mask), (1, [float(r) for r in rewards], [float(b) for b in base * 2], mask)]
    return spark.createDataFrame(rows, "row_idx long, rewards array<double>, values array<double>, mask array<int>")


def test_gae_ignores_values_under_the_mask(spark):
    def valid(noise):
        out = A.gae(gae_rows(spark, noise), 0.9, 0.95).orderBy("row_idx").collect()
        return [a for r in out for a, m in zip(r.advantages, r.mask) if m]

    assert np.allclose(valid(0.0), valid(50.0))


def test_gae_last_token_by_hand(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 1.0], [1.0, 2.0, 9.0], [1, 1, 1])], "row_idx long, rewards array<double>, values array<double>, mask array<int>")
    r = A.gae(df, 1.0, 1.0).first()
    assert r.returns[-1] == 1.0 and r.returns[0] == 1.0


def test_scans_equal_plain_loops_for_ragged_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        n = int(rng.integers(0, 90))
        rows.append((i, [float(x) for x in rng.normal(size=n)], [int(x) for x in rng.integers(0, 2, n)]))
    df = spark.createDataFrame(rows, "row_idx long, rewards array<double>, mask array<int>")
    from rewardloom.functions import scan

    out = df.select("rewards", "mask", scan.discounted_returns("rewards", "mask", 0.9).alias("d"), scan.suffix_sum("rewards", "mask").alias("s")).collect()
    for r in out:
        carry, expected = 0.0, []
        for x, m in zip(reversed(r.rewards), reversed(r.mask)):
            value = x + 0.9 * carry
            expected.append(value)
            carry = value * m
        assert np.allclose(r.d, expected[::-1])
        assert np.allclose(r.s, np.cumsum((np.array(r.rewards) * np.array(r.mask))[::-1])[::-1])


def test_nan_under_the_mask_does_not_leak(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0], [1, 0, 1])], "v array<double>, mask array<int>")
    assert M.masked_sum(df, "v").first()[0] == 4.0
    assert abs(M.masked_mean(df, "v").first()[0] - 2.0) < 1e-7


def test_masked_var_needs_two_tokens(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1, 0])], "v array<double>, mask array<int>")
    with pytest.raises(Exception, match="two valid tokens"):
        M.masked_var(df, "v").collect()


def logps(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4):
        old = rng.normal(-1, 0.3, 10)
        rows.append((f"u{i}", 0, [float(x) for x in old], [float(x) for x in old + rng.normal(0, 0.1, 10)], [1] * 10))
    return spark.createDataFrame(rows, "uid string, rollout_n int, old_logp array<double>, rollout_logp array<double>, mask array<int>")


NAN = float("nan")


@pytest.mark.parametrize("normalize", [False, True])
@pytest.mark.parametrize("level", ["token", "sequence"])
def test_weights_of_odd_tokens_follow_the_rule_and_no_token_is_interpreted(spark, level, normalize):
    odd = [
        ("a", [-1.0, -0.5, None], [-1.1, -0.2, -1.0], [1, 0, 1]), ("b", [-1.0, -0.5], [-1.1], [1, 1]), ("c", [-1.0], [-1.1], [None]), ("d", None, [-1.1], [1]),
        ("e", [], [], []), ("f", [-1.0, 2.0], [-50.0, 2.5], [1, 1]), ("g", [-1.0], [-0.9], [0]), *([] if normalize else [("h", [NAN, -1.0], [-1.0, -1.0], [0, 1])]),
    ]
    out = C.with_is_weights(spark.createDataFrame(odd, "uid string, old_logp array<double>, rollout_logp array<double>, mask array<int>"), level, 1.05, normalize)
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    plain, sums = {}, []
    for uid, old, rollout, mask in odd:
        if old is None:
            plain[uid] = None
            sums.append((None, sum(mask)))
            continue
        gaps = [None if i >= min(len(old), len(rollout)) or old[i] is None else old[i] - rollout[i] for i in range(len(old))]
        if level == "sequence":
            valid = [g for g, m in zip(gaps, mask, strict=True) if m]
            whole = None if None in valid else sum(valid)
            gaps = [whole] * len(gaps)
        raw = [math.exp(20.0 if g is None else g if g != g else max(min(g, 20.0), -20.0)) for g in gaps]
        plain[uid] = [1.05 if m is None else w * m if w != w else min(w * m, 1.05) for w, m in zip(raw, mask, strict=True)]
        sums.append((sum(w * m for w, m in zip(plain[uid], mask, strict=True) if m), None if None in mask else sum(mask)))
    if level == "token":
        mean = sum(s for s, _ in sums if s is not None) / sum(n for _, n in sums if n is not None)
    else:
        mean = np.mean([s / n for s, n in sums if n and s is not None])
    norm = mean if normalize else 1.0
    for r in out.collect():
        assert r.is_weights == (None if plain[r.uid] is None else pytest.approx([w / norm for w in plain[r.uid]], nan_ok=True)), r.uid


@pytest.mark.parametrize("level", ["token", "sequence"])
def test_weights_are_capped_and_reports_complete(spark, level):
    out, report = C.rollout_correction(logps(spark), C.Correction(is_level=level, rs_level="token", rs_upper=2.0, veto=1e-4))
    assert max(w for r in out.collect() for w in r.is_weights) <= 2.0
    names = report.columns
    assert all(n.startswith("rollout_corr/") for n in names)
    assert {"rollout_corr/rollout_is_mean", "rollout_corr/kl", "rollout_corr/chi2_seq", "rollout_corr/rollout_is_veto_fraction"} <= set(names)
    assert report.count() == 1


def test_unknown_names_fail():
    with pytest.raises(ValueError):
        C.preset("nope")
    with pytest.raises(ValueError):
        A.estimator("nope")
    with pytest.raises(ValueError):
        L.objective("nope")


def test_metric_types_must_not_mix(spark):
    df = spark.createDataFrame([("a", "sum", 1.0), ("a", "mean", 2.0)], "key string, agg string, value double")
    with pytest.raises(Exception, match="mixed aggregation"):
        M.metric_series(df).collect()


def test_pf_ppo_draws_as_many_rows_by_weight(spark):
    df = spark.range(500).select(F.col("id").alias("row_idx"), (F.col("id") % 5).cast("double").alias("score"))
    out = A.pf_ppo_resample(df, seed=1).groupBy("score").count().toPandas().set_index("score")["count"]
    assert out.sum() == 500 and out.get(0.0, 0) <= 2 and out[4.0] > out[2.0] > out[1.0]


def test_group_filter_keeps_varied_and_lone(spark):
    df = scored(spark, [("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 7)])
    assert sorted(r.row_idx for r in A.group_filter(df).collect()) == [2, 3, 4]


def test_clip_cov_and_kl_cov_long_thresholds(spark, monkeypatch):
    """A prefix found by ranking ranges gives what a short top-n gives."""
    from rewardloom.plans import scale

    rng = np.random.default_rng(2)
    rows = [(f"u{i}", i, *[[float(x) for x in rng.normal(size=20)] for _ in range(3)], [1] * 20) for i in range(20)]
    df = spark.createDataFrame(rows, "uid string, rollout_n int, logp array<double>, old_logp array<double>, advantages array<double>, mask array<int>")
    short = L.loss_kl_cov(df, ratio=0.1).first()
    monkeypatch.setattr(scale, "DIRECT_LIMIT", 1)
    long = L.loss_kl_cov(df, ratio=0.1).first()
    assert abs(short.pg_loss - long.pg_loss) < 1e-12


@pytest.mark.parametrize("records", [3, 10_000])
@pytest.mark.parametrize("compact", [False, True])
def test_token_baseline_by_hand(spark, records, compact):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        n = int(rng.integers(0, 6)) if i % 9 else 9
        rows.append(([1, 2, None][i % 3], i, rng.standard_normal(n).tolist(), (-rng.random(n)).tolist(), rng.random(n).tolist(), rng.integers(0, 2, n).tolist()))
    df = spark.createDataFrame(rows, "uid int, row_idx int, rewards array<double>, old_logp array<double>, sum_pi_squared array<double>, mask array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        make = A.tir_optimal_token_baseline if compact else A.optimal_token_baseline
        got = {r.row_idx: r for r in make(df, handle_zero_tail=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40
    for key in (1, 2, None):
        own, sums = [], {}
        for k, i, r, lp, sq, m in rows:
            if k != key:
                continue
            go = [sum(x * y for x, y in zip(r[t:], m[t:], strict=True)) for t in range(len(r))]
            w = [sum((1 - 2 * math.exp(a) + b) * c for a, b, c in zip(lp[: t + 1], sq[: t + 1], m[: t + 1], strict=True)) for t in range(len(r))]
            at = [sum(m[: t + 1]) - 1 if compact else t for t in range(len(r))]
            own.append((i, go, at, m, sum(m)))
            for t, p in enumerate(at):
                if p >= 0:
                    s = sums.setdefault(p, [0.0, 0.0])
                    s[0] += go[t] * w[t] * m[t]
                    s[1] += w[t] * m[t]
        lengths = sorted((x[4] for x in own if x[4] > 0 or not compact), reverse=True)
        lone = len(set(lengths)) > 1 and lengths.count(lengths[0]) == 1
        for i, go, at, m, size in own:
            for t, p in enumerate(at):
                base = sums[p][0] / (sums[p][1] + 1e-8) if p >= 0 else 0.0
                if len(lengths) < 2 or (lone and size == lengths[0] and p >= lengths[1]):
                    base = 0.0
                assert abs(got[i].advantages[t] - (go[t] - base) * m[t]) < 1e-6 and abs(got[i].returns[t] - go[t]) < 1e-9


@pytest.mark.parametrize("level", ["token", "sequence", "geometric"])
def test_rejection_and_veto_of_odd_tokens_follow_the_rule_and_no_token_is_interpreted(spark, level):
    odd = [
        ("a", [-1.0, -0.5, None], [-1.1, -0.2, -1.0], [1, 0, 1]), ("b", [-1.0, -0.5], [-1.1], [1, 1]), ("c", [-1.0], [-1.1], [None]), ("d", None, [-1.1], [1]),
        ("e", [], [], []), ("f", [-1.0, 2.0], [-50.0, 2.5], [1, 1]), ("g", [-1.0], [-0.9], [0]), ("h", [NAN, -1.0], [-1.0, -1.0], [1, 1]), ("i", [-1.01, -1.0], [-1.0, -1.0], [1, 1]),
    ]
    df = spark.createDataFrame(odd, "uid string, old_logp array<double>, rollout_logp array<double>, mask array<int>")
    kept = C.with_rejection_mask(df, level, 2.0, out="kept")
    out = C.with_veto(kept.withColumn("left", F.col("mask")), 0.905, out="left")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"{name}(" in plan for name in ("transform", "exists", "aggregate", "arrays_zip"))
    rows = {r.uid: r for r in out.collect()}
    for uid, old, rollout, mask in odd:
        if old is None:
            assert rows[uid].kept is None and rows[uid].left == mask
            continue
        gaps = [None if i >= min(len(old), len(rollout)) or old[i] is None else old[i] - rollout[i] for i in range(len(mask))]
        bad = any(g is not None and m and g < math.log(0.905) for g, m in zip(gaps, mask, strict=True))
        if level != "token":
            valid = [g for g, m in zip(gaps, mask, strict=True) if m]
            whole = None if None in valid else sum(valid)
            if level == "geometric" and whole is not None:
                whole = None if None in mask else whole / (sum(mask) + 1e-8)
            gaps = [whole] * len(gaps)
        fits = [0.5 <= math.exp(20.0 if g is None else max(min(g, 20.0), -20.0)) <= 2.0 if g is None or g == g else False for g in gaps]
        assert rows[uid].kept == [None if m is None else m * f for m, f in zip(mask, fits, strict=True)], uid
        assert rows[uid].left == [None if m is None else m * (not bad) for m in mask], uid
