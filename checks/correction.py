"""Importance correction and objective values against SQL."""

from pyspark.sql import functions as F

from checks.base import T, query, r6, rounded, tokens
from rewardloom.functions import scan
from rewardloom.operators import correction as C
from rewardloom.operators import objective as L

LOGPS = ["old_logp", "rollout_logp", "mask"]
X = "x as (select *, old_logp - rollout_logp as d from t)"
Q = "q as (select uid, rollout_n, sum(mask)::double n, sum(d*mask) ds, sum(old_logp*mask) t_, sum(rollout_logp*mask) r_ from x group by 1,2)"


@query("a20_offpolicy_metrics", f"""with {T}, {X}, {Q},
  tk as (select sum((exp(d)-d-1)*mask) k3, sum(exp(2*d)*mask) sq, sum(mask) n from x),
  s as (select -t_/(n+1e-8) lt, -r_/(n+1e-8) lr, t_/(n+1e-8)-r_/(n+1e-8) as nd, ds, t_, r_ from q)
  select round(avg(exp(lt)),6) training_ppl, round(avg(lt),6) training_log_ppl, round((sum(r_)-sum(t_))/(any_value(tk.n)+1e-8),6)+0.0 kl, round(any_value(k3)/(any_value(tk.n)+1e-8),6) k3_kl,
    round(avg(exp(lr)),6) rollout_ppl, round(avg(lr),6) rollout_log_ppl, round(avg(-nd),6)+0.0 log_ppl_diff, round(avg(abs(nd)),6) log_ppl_abs_diff,
    round(max(-nd),6)+0.0 log_ppl_diff_max, round(min(-nd),6)+0.0 log_ppl_diff_min, round(avg(exp(-nd)),6) ppl_ratio,
    round(any_value(sq)/(any_value(tk.n)+1e-8)-1,6)+0.0 chi2_token, round(avg(exp(2*greatest(least(ds,20),-20)))-1,6)+0.0 chi2_seq from s, tk""")
def offpolicy(spark, sf_dir):
    return rounded(C.offpolicy_metrics(tokens(spark, sf_dir, *LOGPS)))


_SEQ = """count(*) filter (where {sm}>{hi})::double/count(*) as a"""


def _report_sql(level, hi, lo, rs):
    if level == "token":
        head = f"""y as (select *, exp(d) w from x), z as (select uid, rollout_n, sum(mask)::double n, sum(w*mask) w, sum(greatest(least(w,{hi}),{lo})*mask) c,
           sum(pow(greatest(least(w,{hi}),{lo}),2)*mask) c2, count(*) filter (where mask<>0 and w>{hi}) h, count(*) filter (where mask<>0 and w<{lo}) l,
           max(case when mask<>0 then w end) mx, min(case when mask<>0 then w end) mn, count(*) filter (where mask<>0 and not (w>={lo} and w<={hi})) o from y group by 1,2)"""
        top = "max(mx)", "min(mn)", "sum(h)/(sum(n)+1e-8)", "sum(l)/(sum(n)+1e-8)", "avg((o>0)::int)"
    else:
        lr = "ds" if level == "sequence" else "ds/(n+1e-8)"
        head = f"""{Q}, z0 as (select *, {lr} lr, exp(greatest(least({lr},20),-20)) v from q),
          z as (select n, lr, v, v*n w, greatest(least(v,{hi}),{lo})*n c, pow(greatest(least(v,{hi}),{lo}),2)*n c2, case when v>={lo} and v<={hi} then 0 else n end o from z0)"""
        top = "exp(least(max(lr),20))", "exp(min(lr))", f"avg((lr>ln({hi}))::int)", f"avg((lr<ln({lo}))::int)", f"avg((not (v>={lo} and v<={hi}))::int)"
    extra = f", round(sum(o)/(sum(n)+1e-8),6)+0.0 masked_fraction, round({top[4]},6)+0.0 seq_masked_fraction" if rs else ""
    sm = "(w/(n+1e-8))"
    return f"""with {T}, {X}, {head}
      select round(sum(w)/(sum(n)+1e-8),6) mean, round({top[0]},6) max, round({top[1]},6) min, round({top[2]},6)+0.0 ratio_fraction_high, round({top[3]},6)+0.0 ratio_fraction_low,
      round(sqrt(greatest(sum(c2)/(sum(n)+1e-8)-pow(sum(c)/(sum(n)+1e-8),2),0)),6)+0.0 std,
      round(1/((sum(c2)/(sum(n)+1e-8))/pow(sum(c)/(sum(n)+1e-8)+1e-8,2)),6) eff_sample_size,
      round(avg({sm}),6) seq_mean, round(stddev_samp({sm}),6) seq_std, round(max({sm}),6) seq_max, round(min({sm}),6) seq_min, round(max(abs({sm}-1)),6) seq_max_deviation,
      round(avg(({sm}>{hi})::int),6)+0.0 seq_fraction_high, round(avg(({sm}<{lo})::int),6)+0.0 seq_fraction_low {extra} from z"""


for _level, _hi in (("token", 1.05), ("sequence", 2.0)):
    query(f"a21_is_metrics_{_level}", _report_sql(_level, _hi, f"(1/{_hi})", False))(
        lambda spark, sf_dir, level=_level, hi=_hi: rounded(C.is_metrics(tokens(spark, sf_dir, *LOGPS), level, hi)))
for _level, _hi in (("token", 1.05), ("sequence", 2.0), ("geometric", 1.005)):
    query(f"a22_rs_metrics_{_level}", _report_sql(_level, _hi, f"(1/{_hi})", True))(
        lambda spark, sf_dir, level=_level, hi=_hi: rounded(C.rs_metrics(tokens(spark, sf_dir, *LOGPS), level, hi)))


def _sums(df, array):
    rows = df.where(F.size("mask") > 0).select("uid", "rollout_n", scan.total(array).alias("s"))
    return rows.groupBy("uid", "rollout_n").agg(r6(F.sum("s"), 5).alias(f"{array}_sum"))


@query("c01_is_weights_token", f"""with {T}, {X}, w as (select *, least(exp(d)*mask, 1.05) w from x), m as (select sum(w*mask)/(sum(mask)+1e-8) m from w)
  select uid, rollout_n, round(sum(w/m),5)+0.0 as is_weights_sum from w, m group by 1,2""")
def is_token(spark, sf_dir):
    return _sums(C.with_is_weights(tokens(spark, sf_dir, *LOGPS), "token", 1.05, True), "is_weights")


@query("c01_is_weights_sequence", f"""with {T}, {X}, {Q}, w as (select uid, rollout_n, n, least(exp(greatest(least(ds,20),-20)),2.0) w from q), m as (select avg(w*n/(n+1e-8)) m from w)
  select uid, rollout_n, round(w*n/m,5)+0.0 as is_weights_sum from w, m""")
def is_sequence(spark, sf_dir):
    return _sums(C.with_is_weights(tokens(spark, sf_dir, *LOGPS), "sequence", 2.0, True), "is_weights")


for _level, _hi, _keep in (
    ("token", 1.05, "exp(d)"), ("sequence", 2.0, "exp(greatest(least(ds,20),-20))"), ("geometric", 1.005, "exp(ds/(n+1e-8))"),
):
    query(f"c02_rejection_mask_{_level}", f"""with {T}, {X}, {Q}
      select uid, rollout_n, cast(sum(mask * case when {_keep} between 1/{_hi} and {_hi} then 1 else 0 end) as bigint) as kept from x join q using (uid, rollout_n) group by 1,2""")(
        lambda spark, sf_dir, level=_level, hi=_hi: C.with_rejection_mask(tokens(spark, sf_dir, *LOGPS), level, hi).select(
            "uid", "rollout_n", F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("kept")))


@query("c03_token_veto", f"""with {T}, {X}, v as (select uid, rollout_n, max((d < ln(0.905) and mask<>0)::int) bad, sum(mask) n from x group by 1,2)
  select uid, rollout_n, cast(case when bad=1 then 0 else n end as bigint) as kept from v""")
def veto(spark, sf_dir):
    out = C.with_veto(tokens(spark, sf_dir, *LOGPS), 0.905)
    return out.select("uid", "rollout_n", scan.total("mask").cast("long").alias("kept"))


@query("c03_veto_metrics", f"""with {T}, {X}, v as (select uid, rollout_n, sum((d < ln(0.905) and mask<>0)::int) bad, sum(mask) n from x group by 1,2)
  select round(avg((bad>0)::int),6) as veto_fraction, round(sum(bad)/(sum(n)+1e-8),6) as catastrophic_token_fraction from v""")
def veto_metrics(spark, sf_dir):
    return rounded(C.veto_metrics(tokens(spark, sf_dir, *LOGPS), 0.905))


@query("c04_rollout_correction", f"""with {T}, {X}, {Q}, z as (select *, exp(greatest(least(ds,20),-20)) v from q),
   b as (select uid, rollout_n, max((d < ln(0.905) and mask<>0)::int) bad from x group by 1,2)
  select uid, rollout_n, round(least(v,2.0)*n,5)+0.0 as weight_sum, cast(case when v between 0.5 and 2.0 and bad=0 then n else 0 end as bigint) as kept from z join b using (uid, rollout_n)""")
def correction(spark, sf_dir):
    config = C.preset("decoupled_seq_is_rs", veto=0.905)
    out, _ = C.rollout_correction(tokens(spark, sf_dir, *LOGPS), config)
    return out.select("uid", "rollout_n", r6(scan.total("is_weights"), 5).alias("weight_sum"), scan.total("mask").cast("long").alias("kept"))


@query("c05_correction_preset_report", f"""with {T}, {X}, {Q}, z as (select *, exp(greatest(least(ds,20),-20)) v from q)
  select round(sum(v*n)/(sum(n)+1e-8),6) is_mean, round(avg((v<0.5 or v>2)::int),6) rs_seq_masked, round(avg(exp(-t_/(n+1e-8))),6) training_ppl from z""")
def preset_report(spark, sf_dir):
    _, report = C.rollout_correction(tokens(spark, sf_dir, *LOGPS), C.preset("decoupled_seq_is_rs"))
    pick = lambda k: F.col(f"`rollout_corr/{k}`")
    return rounded(report.select(pick("rollout_is_mean").alias("is_mean"), pick("rollout_rs_seq_masked_fraction").alias("rs_seq_masked"),
                                 pick("training_ppl").alias("training_ppl")))


# ---------------------------------------------------------------- objectives

COLS = ["logp", "old_logp", "advantages", "mask"]
G = "g as (select *, logp - old_logp as gap, exp(logp - old_logp) as ratio, advantages as a from t)"
CLIP = "greatest(least(ratio,1.2),0.8)"
MM = "round(sum(({0})*mask)/(sum(mask)+1e-8),6)+0.0"


def _tok(loss, metrics, tail="from g"):
    parts = ", ".join(f"{MM.format(v)} as {k}" for k, v in metrics.items())
    return f"select round(sum(({loss})*mask)/sum(mask),6)+0.0 as pg_loss{', ' + parts if parts else ''} {tail}"


_W = f"greatest(-a*ratio, -a*{CLIP})"
_VANILLA = f"case when a<0 then least(-a*3.0, {_W}) else {_W} end"


@query("l01_loss_vanilla", f"with {T}, {G} " + _tok(_VANILLA, {
    "pg_clipfrac": f"(-a*{CLIP} > -a*ratio)::int", "ppo_kl": "-gap", "pg_clipfrac_lower": f"({_W} > -a*3.0 and a<0)::int"}))
def vanilla(spark, sf_dir):
    return rounded(L.loss_vanilla(tokens(spark, sf_dir, *COLS)))


@query("l02_loss_gspo", f"""with {T}, {G}, s as (select uid, rollout_n, sum(gap*mask)/greatest(sum(mask),1) sg from g group by 1,2),
  h as (select g.*, exp(least(sg,10)) sr, sg from g join s using (uid, rollout_n)),
  k as (select *, -a*sr p, -a*greatest(least(sr,1.2),0.8) c from h),
  rws as (select uid, rollout_n, sum(greatest(p,c)*mask) l, sum(mask) n, sum((c>p)::int*mask) cf, sum(-sg*mask) kl from k group by 1,2)
  select round(sum(l/(n+1e-8))/count(*) filter (where n>0),6)+0.0 as pg_loss, round(sum(cf)/(sum(n)+1e-8),6)+0.0 as pg_clipfrac, round(sum(kl)/(sum(n)+1e-8),6)+0.0 as ppo_kl from rws""")
def gspo(spark, sf_dir):
    return rounded(L.loss_gspo(tokens(spark, sf_dir, *COLS)))


@query("l03_loss_sapo", f"""with {T}, {G}, h as (select *, case when a>0 then 1.0::double else 1.05::double end tau from g),
  k as (select *, -(1/(1+exp(-tau*(ratio-1))))*(4/tau)*a as l from h),
  rws as (select uid, rollout_n, sum(l*mask) l, sum(mask) n, sum(-gap*mask) kl from k group by 1,2)
  select round(sum(l/(n+1e-8))/count(*) filter (where n>0),6)+0.0 as pg_loss, round(sum(kl)/(sum(n)+1e-8),6)+0.0 as ppo_kl from rws""")
def sapo(spark, sf_dir):
    return rounded(L.loss_sapo(tokens(spark, sf_dir, *COLS)))


query("l04_loss_gpg", f"with {T}, {G} " + _tok("-logp*a", {}))(
    lambda spark, sf_dir: rounded(L.loss_gpg(tokens(spark, sf_dir, *COLS))))

_COV = "mm as (select sum(a*mask)/(sum(mask)+1e-8) ma, sum(logp*mask)/(sum(mask)+1e-8) ml, sum(mask) nn from g)"


@query("l05_loss_clip_cov", f"""with {T}, {G}, {_COV},
  c as (select g.*, (a-ma)*(logp-ml) cov, nn, -a*ratio p, -a*{CLIP} cl from g, mm),
  k as (select *, case when mask>0 and not (cl>p) and cov<5 and cov>1 then md5('11|'||uid||'|'||rollout_n||'|'||(t-1)) end key from c),
  rk as (select *, case when key is not null then row_number() over (order by key nulls last) end rn from k),
  z as (select *, (rn is not null and rn <= greatest(floor(0.002*nn),1)) as off from rk)
  select round(sum(case when off then 0 else greatest(p,cl) end*mask)/sum(mask),6)+0.0 as pg_loss, round(sum(off::int*mask)/(sum(mask)+1e-8),6)+0.0 as pg_clipfrac,
    round(sum(-gap*mask)/(sum(mask)+1e-8),6)+0.0 as ppo_kl from z""")
def clip_cov(spark, sf_dir):
    return rounded(L.loss_clip_cov(tokens(spark, sf_dir, *COLS), ratio=0.002, seed=11))


@query("l06_loss_kl_cov", f"""with {T}, {G}, v as (select * from g where mask>0), m as (select avg(a) ma, avg(logp) ml, count(*) n from v),
  c as (select v.*, row_number() over (order by (a-ma)*(logp-ml) desc, uid, rollout_n, t) rn, n from v, m)
  select round(sum(-a*ratio + case when rn <= greatest(1, floor(n*0.002)) then abs(gap) else 0 end)/count(*),6)+0.0 as pg_loss, round(avg(abs(gap)),6)+0.0 as ppo_kl from c""")
def kl_cov(spark, sf_dir):
    return rounded(L.loss_kl_cov(tokens(spark, sf_dir, *COLS), ratio=0.002))


@query("l07_loss_geo_mean", f"""with {T}, {G}, h as (select *, greatest(least(gap,0.2),-0.2) c, sign(a) s from g),
  k as (select uid, rollout_n, sum(mask)+1e-8 n, sum(s*least(s*gap,s*c)*mask) gm, sum(a*mask) a from h group by 1,2),
  m as (select round(sum((gap<>c and a>0)::int*mask)/(sum(mask)+1e-8),6)+0.0 up, round(sum(-gap*mask)/(sum(mask)+1e-8),6)+0.0 kl, round(sum((gap<>c and a<0)::int*mask)/(sum(mask)+1e-8),6)+0.0 dn from h)
  select round(avg(-(a/n)*exp(gm/n)),6)+0.0 as pg_loss, any_value(up) as pg_clipfrac, any_value(kl) as ppo_kl, any_value(dn) as pg_clipfrac_lower from k, m""")
def geo_mean(spark, sf_dir):
    return rounded(L.loss_geo_mean(tokens(spark, sf_dir, *COLS)))


query("l08_loss_cispo", f"with {T}, {G} " + _tok(f"-{CLIP}*a*logp", {"pg_clipfrac": f"(ratio<>{CLIP})::int", "ppo_kl": "-gap"}))(
    lambda spark, sf_dir: rounded(L.loss_cispo(tokens(spark, sf_dir, *COLS))))
query("l09_loss_reinforce", f"with {T}, {G} " + _tok("-a*logp", {"ppo_kl": "rollout_logp-logp"}))(
    lambda spark, sf_dir: rounded(L.loss_reinforce(tokens(spark, sf_dir, *COLS, "rollout_logp"))))


@query("l10_value_loss", f"""with {T}, h as (select mask, vpreds p, "values" v, score/10 as rt, greatest(least(vpreds,"values"+0.2),"values"-0.2) c from t)
  select round(0.5*sum(greatest((p-rt)*(p-rt),(c-rt)*(c-rt))*mask)/sum(mask),6)+0.0 as vf_loss,
    round(sum(((c-rt)*(c-rt)>(p-rt)*(p-rt))::int*mask)/(sum(mask)+1e-8),6)+0.0 as vf_clipfrac from h""")
def value_loss(spark, sf_dir):
    df = tokens(spark, sf_dir, "vpreds", "values", "mask").withColumn("returns", F.transform("mask", lambda m: F.col("score") / 10))
    return rounded(L.value_loss(df, 0.2))


query("l11_entropy_agg", f"""with {T}, x as (select uid, rollout_n, sum(entropy*mask) s, sum(mask) n from t group by 1,2)
  select round(sum(s/(n+1e-8))/count(*) filter (where n>0),6)+0.0 as loss from x""")(
    lambda spark, sf_dir: rounded(L.entropy_loss(tokens(spark, sf_dir, "entropy", "mask"), mode="seq-mean-token-mean")))


@query("l12_sft_nll", f"""with {T}, x as (select logp, coalesce(lead(mask) over (partition by uid, rollout_n order by t),0) m from t)
  select round(-sum(logp*m)/sum(m),6)+0.0 as loss, cast(sum(m) as bigint) as tokens from x""")
def sft_nll(spark, sf_dir):
    return rounded(L.sft_nll(tokens(spark, sf_dir, "logp", "mask").withColumnRenamed("mask", "loss_mask")))


@query("l13_total_objective", f"""with {T}, {G}, p as ({_tok(_VANILLA, {})}),
  e as (select sum(entropy*mask)/sum(mask) e, sum(least(greatest(exp(ref_logp-logp)-(ref_logp-logp)-1,-10),10)*mask)/sum(mask) k,
     sum(({_VANILLA})*mask)/sum(mask) pg from g)
  select round(pg,6)+0.0 as pg_loss, round(e,6)+0.0 as entropy, round(k,6)+0.0 as kl_loss, round(pg-0.01*e+0.05*k,6)+0.0 as loss from e""")
def total(spark, sf_dir):
    df = tokens(spark, sf_dir, *COLS, "entropy", "ref_logp")
    out = L.total_objective(df, "vanilla", 0.01, 0.05)
    return rounded(out.select("pg_loss", "entropy", "kl_loss", "loss"))


@query("c06_bypass_mode", f"""with {T}, b as (select *, logp - rollout_logp as gap, exp(logp-rollout_logp) ratio, advantages a from t)
  {_tok(_VANILLA, {"ppo_kl": "-gap"}, "from b")}""")
def bypass(spark, sf_dir):
    df = C.bypass_old_logp(tokens(spark, sf_dir, *COLS, "rollout_logp"))
    return rounded(L.loss_vanilla(df).select("pg_loss", "ppo_kl"))
