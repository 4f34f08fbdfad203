"""Advantage estimators and group operators against window SQL."""

from pyspark.sql import functions as F

from checks.base import R, T, query, r6, rollouts, rounded, tokens
from rewardloom.functions import seq
from rewardloom.operators import advantage as A
from rewardloom.plans.scale import with_group_stats

# Per-row digest of an advantage array: plain and position-weighted sums over valid tokens.
ROW = ["uid", "rollout_n"]


def _digest(df, *arrays):
    tokens_ = df.select(*ROW, F.posexplode(seq.zipped(*arrays, "mask")).alias("p", "e")).where("e.mask != 0")
    out = []
    for a in arrays:
        v = F.col("e")[a]
        out += [F.sum(v).alias(f"{a}_sum"), F.sum(v * (F.col("p") + 1)).alias(f"{a}_pos")]
    sums = tokens_.groupBy(*ROW).agg(*out)
    return sums.select(*ROW, *[r6(F.col(c), 4).alias(c) for c in sums.columns if c not in ROW])


def _digest_sql(source, *arrays):
    parts = ", ".join(
        f'round(sum(case when mask<>0 then "{a}" else 0 end),4)+0.0 as {a}_sum, '
        f'round(sum(case when mask<>0 then "{a}"*t else 0 end),4)+0.0 as {a}_pos' for a in arrays
    )
    return f"select uid, rollout_n, {parts} from {source} group by uid, rollout_n"


ST = """
tok as (select uid, rollout_n, sum(mask) as n_tok from t group by 1,2),
st as (select uid, avg(score) m, stddev_samp(score) s, count(*) n, sum(score) total from r group by uid),
g as (select r.uid, r.rollout_n, r.score, m, s, n, total, n_tok from r join st using (uid) join tok using (uid, rollout_n))"""


def _outcome(name, formula, fn, **options):
    sql = f"""with {T}, {ST}
      select uid, rollout_n, round({formula},6)+0.0 as advantage, round(({formula})*n_tok,6)+0.0 as advantages_sum from g"""

    @query(name, sql)
    def run(spark, sf_dir):
        df = fn(tokens(spark, sf_dir, "rewards", "mask"), **options)
        return df.select(*ROW, r6(F.col("advantage")).alias("advantage"), r6(seq.masked_sum("advantages", "mask")).alias("advantages_sum"))

    return run


_outcome("w02_grpo", "(score - case when n=1 then 0 else m end)/((case when n=1 then 1 else s end)+1e-6)", A.grpo)
_outcome("w02_grpo_unnormalised", "score - case when n=1 then 0 else m end", A.grpo, norm_by_std=False)
_outcome("w03_grpo_vectorized",
         "(score - case when n=1 then 0 else m end)/((case when n=1 then 1 else sqrt(greatest(s*s,1e-6)) end)+1e-6)",
         A.grpo_vectorized)
_outcome("w06_rloo", "case when n>1 then (score-m)*n/(n-1) else score end", A.rloo)
_outcome("w07_rloo_vectorized", "case when n>1 then (n*score-total)/(n-1) else 0 end", A.rloo_vectorized)
_outcome("w11_gpg", "(select count(*)::double/greatest(count(*) filter (where score<>0),1) from r) * (score - case when n=1 then 0 else m end)", A.gpg)


@query("w08_opo", f"""with {T}, {ST},
  b as (select uid, case when count(*)>1 then sum(n_tok*score)/sum(n_tok) else 0 end as base from g group by uid)
  select uid, rollout_n, round(score-base,6)+0.0 as advantage from g join b using (uid)""")
def opo(spark, sf_dir):
    return A.opo(tokens(spark, sf_dir, "rewards", "mask")).select(*ROW, r6(F.col("advantage")).alias("advantage"))


@query("w04_grpo_passk", f"""with {R}, x as (select *, count(*) over w n, stddev_samp(score) over w s,
    row_number() over (partition by uid order by score desc, rollout_n) k,
    nth_value(score, 2) over (partition by uid order by score desc, rollout_n rows between unbounded preceding and unbounded following) sec
    from r window w as (partition by uid))
  select uid, rollout_n, round(case when k=1 then (score-sec)/(s+1e-6) else 0 end,6)+0.0 as advantage from x where n>1""")
def grpo_passk(spark, sf_dir):
    df = with_group_stats(tokens(spark, sf_dir, "rewards", "mask"), ["uid"], F.count(F.lit(1)).alias("size")).where("size > 1")
    out = A.grpo_passk(df, order="rollout_n")
    return out.select(*ROW, r6(F.col("advantage")).alias("advantage"))


@query("w05_reinforce_plus_plus_baseline", f"""with {T}, {ST},
  b as (select uid, rollout_n, n_tok, score - case when n=1 then 0 else m end as a from g),
  mu as (select sum(a*n_tok)/(sum(n_tok)+1e-8) m, sum(n_tok) n from b),
  v as (select sum((a-m)*(a-m)*n_tok)/(any_value(n)+1e-8)*any_value(n)/(any_value(n)-1) v, any_value(m) m from b, mu)
  select uid, rollout_n, round((a-m)/sqrt(v+1e-8)*n_tok,6)+0.0 as advantages_sum from b, v""")
def rpp_baseline(spark, sf_dir):
    out = A.reinforce_plus_plus_baseline(tokens(spark, sf_dir, "rewards", "mask"))
    return out.select(*ROW, r6(seq.masked_sum("advantages", "mask")).alias("advantages_sum"))


_WHITE = """mu as (select sum(a)/(count(*)+1e-8) m, count(*) n from adv where mask<>0),
  vr as (select sum((a-m)*(a-m))/(any_value(n)+1e-8)*any_value(n)/(any_value(n)-1) v, any_value(m) m from adv, mu where mask<>0),
  fin as (select adv.* exclude (advantages), (a-m)/sqrt(v+1e-8) as advantages from adv, vr)"""


@query("w01_gae", f"""with {T},
  va as (select *, row_number() over (partition by uid, rollout_n order by t) k,
    coalesce(lead("values") over (partition by uid, rollout_n order by t),0) nv from t where mask<>0),
  d as (select *, rewards + 0.9*nv - "values" as delta from va),
  adv as (select *, sum(delta*pow(0.72,k)) over (partition by uid, rollout_n order by t desc)/pow(0.72,k) as a from d),
  {_WHITE},
  fin2 as (select *, a + "values" as returns from fin)
  {_digest_sql("fin2", "advantages", "returns")}""")
def gae(spark, sf_dir):
    return _digest(A.gae(tokens(spark, sf_dir, "rewards", "values", "mask"), 0.9, 0.8), "advantages", "returns")


@query("w09_reinforce_plus_plus", f"""with {T},
  p as (select uid, rollout_n, max(case when mask=0 then t else 0 end) p from t group by 1,2),
  adv as (select t.*, case when t.t >= p.p then score*pow(0.9375, response_len - t.t) else 0 end as a from t join p using (uid, rollout_n)),
  {_WHITE}, fin2 as (select *, a as returns from fin)
  {_digest_sql("fin2", "advantages", "returns")}""")
def reinforce_plus_plus(spark, sf_dir):
    return _digest(A.reinforce_plus_plus(tokens(spark, sf_dir, "rewards", "mask"), 0.9375), "advantages", "returns")


@query("w10_remax", f"""with {T}, b as (select uid, min_by(score, rollout_n) baseline from r group by uid),
  fin as (select t.* exclude (advantages), score as returns, score - baseline*mask as advantages from t join b using (uid))
  {_digest_sql("fin", "advantages", "returns")}""")
def remax(spark, sf_dir):
    df = tokens(spark, sf_dir, "rewards", "mask")
    base = rollouts(spark, sf_dir).groupBy("uid").agg(F.min_by("score", "rollout_n").alias("baseline"))
    return _digest(A.remax(df.join(base, "uid", "left")), "advantages", "returns")


def _otb_sql(position, tail):
    return f"""with {T},
  w as (select *, sum((1 - 2*exp(old_logp) + sum_pi_squared)*mask) over (partition by uid, rollout_n order by t) as wc,
     {position} as pp, sum(mask) over (partition by uid, rollout_n) as len from t),
  base as (select uid, pp, sum(score*wc)/(sum(wc)+1e-8) b from w where mask<>0 group by 1,2),
  lens as (select uid, len, count(distinct rollout_n) c from w group by 1,2),
  tops as (select uid, arg_max(c, len) c, max(len) l1, sum(c) n, count(*) d from lens group by uid),
  sec as (select lens.uid, max(len) l2 from lens join tops using (uid) where len < l1 group by 1),
  fin as (select w.* exclude (advantages), score - case when n<2 or ({tail} and c=1 and d>1 and len=l1 and pp >= l2) then 0 else b end as advantages
     from w join base using (uid, pp) join tops using (uid) left join sec using (uid) where mask<>0)
  {_digest_sql("fin", "advantages")}"""


@query("w12_optimal_token_baseline", _otb_sql("t-1", "false"))
def otb(spark, sf_dir):
    return _digest(A.optimal_token_baseline(tokens(spark, sf_dir, "rewards", "old_logp", "sum_pi_squared", "mask")), "advantages")


@query("w13_tir_optimal_token_baseline", _otb_sql("sum(mask) over (partition by uid, rollout_n order by t) - 1", "true"))
def tir_otb(spark, sf_dir):
    return _digest(A.tir_optimal_token_baseline(tokens(spark, sf_dir, "rewards", "old_logp", "sum_pi_squared", "mask")), "advantages")


@query("w14_token_rewards", f"with {T}, fin as (select *, rewards - 0.05*(old_logp - ref_logp) as shaped from t) {_digest_sql('fin', 'shaped')}")
def token_rewards(spark, sf_dir):
    return _digest(A.token_rewards(tokens(spark, sf_dir, "rewards", "old_logp", "ref_logp", "mask"), 0.05, "rewards", "shaped"), "shaped")


@query("w15_apply_kl_penalty", f"""with {T},
  fin as (select *, rewards - 0.01*mask*(exp(ref_logp-old_logp) - (ref_logp-old_logp) - 1) as shaped from t)
  {_digest_sql("fin", "shaped")}""")
def apply_kl(spark, sf_dir):
    df = A.apply_kl_penalty(tokens(spark, sf_dir, "rewards", "old_logp", "ref_logp", "mask"), "low_var_kl", 0.01, scores="rewards")
    return _digest(df.withColumn("shaped", F.col("rewards")), "shaped")


@query("w15_kl_report", f"""with {T},
  s as (select sum(mask*(old_logp-ref_logp))/(sum(mask)+1e-8) k from t group by uid, rollout_n)
  select round(avg(k),6)+0.0 as reward_kl_penalty from s""")
def kl_report(spark, sf_dir):
    df = A.apply_kl_penalty(tokens(spark, sf_dir, "rewards", "old_logp", "ref_logp", "mask"), "kl", 0.01, scores="rewards")
    return rounded(A.kl_report(df))


@query("w16_kl_kinds", f"""with {T},
  d as (select mask, logp - ref_logp as x from t)
  select round(sum(x*mask),6)+0.0 as k1, round(sum(abs(x)*mask),6)+0.0 as abs, round(sum(0.5*x*x*mask),6)+0.0 as k2,
    round(sum(least(greatest(exp(-x)+x-1,-10),10)*mask),6)+0.0 as k3 from d""")
def kl_kinds(spark, sf_dir):
    from rewardloom.functions.kl import kl_penalty

    df = tokens(spark, sf_dir, "logp", "ref_logp", "mask")
    kinds = {"k1": "k1", "abs": "abs", "k2": "mse+", "k3": "k3"}
    rows = seq.flat(df, ["logp", "ref_logp"])
    return rows.agg(*[r6(F.sum(kl_penalty(F.col("logp"), F.col("ref_logp"), k) * F.col("mask"))).alias(n) for n, k in kinds.items()])


@query("w17_adaptive_kl_series", f"""with {R},
  s as (select data_source as run, param_version as step, avg(score)/50 as kl, count(*) as n_steps from r group by 1,2)
  select run, step, round(0.2*exp(sum(ln(1+greatest(least(kl/0.1-1,0.2),-0.2)*n_steps/10000.0)) over (partition by run order by step)),6) as beta from s""")
def adaptive_kl(spark, sf_dir):
    steps = rollouts(spark, sf_dir).groupBy(F.col("data_source").alias("run"), F.col("param_version").alias("step")).agg(
        (F.avg("score") / 50).alias("kl"), F.count(F.lit(1)).alias("n_steps"))
    return A.adaptive_kl_series(steps, 0.2, 0.1, 10000.0).select("run", "step", r6(F.col("beta")).alias("beta"))


@query("w18_place_outcome_reward", f"with {T}, fin as (select *, rewards as placed from t) {_digest_sql('fin', 'placed')}")
def place(spark, sf_dir):
    return _digest(A.place_outcome_reward(tokens(spark, sf_dir, "mask"), "score", "mask", "placed"), "placed")


@query("w19_response_mask_from_eos", f"""with {T}, x as (select uid, rollout_n, t, response_len, (l_partkey*7 + t*3) % 23 as tok from t),
  f as (select uid, rollout_n, min(case when tok in (0,5) then t end) e, max(response_len) n from x group by 1,2)
  select uid, rollout_n, cast(coalesce(e, n) as bigint) as kept from f""")
def eos_mask(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("ids", F.expr("transform(sequence(1, response_len), t -> (l_partkey*7 + t*3) % 23)"))
    return df.select(*ROW, F.aggregate(A.mask_until_eos("ids", [0, 5]), F.lit(0).cast("long"), lambda a, m: a + m).alias("kept"))


@query("w20_trajectory_mask", f"""with {T}, f as (select uid, rollout_n, max(response_len) n, min(case when (l_suppkey + t*5) % 19 = 0 then t end) e from t group by 1,2)
  select uid, rollout_n, cast(coalesce(e, n) as bigint) as steps from f""")
def trajectory(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("done", F.expr("transform(sequence(1, response_len), t -> (l_suppkey + t*5) % 19 = 0)"))
    return df.select(*ROW, F.aggregate(A.trajectory_mask("done"), F.lit(0).cast("long"), lambda a, m: a + m).alias("steps"))


@query("w21_group_filter", f"""with {R} select uid, rollout_n, score from r where uid in
  (select uid from r group by uid having stddev_pop(score) > 0 or count(*) = 1)""")
def group_filter(spark, sf_dir):
    return A.group_filter(rollouts(spark, sf_dir)).select(*ROW, "score")


@query("w22_take_prompt_batch", f"""with {R},
  k as (select * from r where uid in (select uid from r group by uid having stddev_pop(score) > 0 or count(*) = 1)),
  f as (select uid from k group by uid order by min(row_idx) limit 512)
  select uid, rollout_n, row_idx from k where uid in (select uid from f)""")
def take_batch(spark, sf_dir):
    kept = A.group_filter(rollouts(spark, sf_dir, indexed=True))
    return A.take_prompt_batch(kept, 512).select(*ROW, "row_idx")


def _pf_sql(weight):
    return f"""with {R}, w as (select row_idx, {weight} + 1e-8 as w from r),
  c as (select row_idx, w, sum(w) over (order by row_idx) as hi from w),
  tot as (select max(hi) as total, count(*) n from c),
  d as (select i as draw, ('0x' || substr(md5('7|' || i::varchar),1,13))::bigint::double / pow(2,52) * total as u from tot, unnest(range(0, n)) as x(i)),
  j as (select d.draw, c.row_idx from d asof join c on d.u < c.hi)
  select row_idx, count(*) as copies from j group by row_idx"""


@query("w23_pf_ppo_resample_pow", _pf_sql("pow(abs(score), 2.0)"))
def pf_pow(spark, sf_dir):
    df = A.pf_ppo_resample(rollouts(spark, sf_dir, indexed=True), method="pow", seed=7)
    return df.groupBy("row_idx").agg(F.count(F.lit(1)).alias("copies"))


@query("w23_pf_ppo_resample_max_random", _pf_sql("case when score = (select max(score) from r) then 0.4::double else 0.1::double end"))
def pf_random(spark, sf_dir):
    df = A.pf_ppo_resample(rollouts(spark, sf_dir, indexed=True), method="max_random", seed=7)
    return df.groupBy("row_idx").agg(F.count(F.lit(1)).alias("copies"))


@query("w24_trace_sample", f"""with {R}, k as (select uid from (select distinct uid from r) order by md5('3|' || uid::varchar) limit 100)
  select uid, rollout_n from r where uid in (select uid from k)""")
def trace(spark, sf_dir):
    return A.trace_sample(rollouts(spark, sf_dir), 100, "uid", 3).select(*ROW)
