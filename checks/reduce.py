"""Masked reductions, metric tables and batch reports against SQL."""

from pyspark.sql import functions as F

from checks.base import R, T, query, r6, rollouts, rounded, table, tokens
from rewardloom.operators import reduce as M

MV = """mv as (select sum(logp*mask)/(sum(mask)+1e-8) m, sum(mask) n from t),
  vv as (select sum((logp-m)*(logp-m)*mask)/(any_value(n)+1e-8)*any_value(n)/(any_value(n)-1) v, any_value(m) m from t, mv)"""


@query("a01_masked_sum", f"with {T} select round(sum(logp*mask),4)+0.0 as masked_sum from t")
def masked_sum(spark, sf_dir):
    return rounded(M.masked_sum(tokens(spark, sf_dir, "logp", "mask"), "logp"), digits=4)


@query("a02_masked_mean", f"with {T} select round(sum(logp*mask)/(sum(mask)+1e-8),6)+0.0 as masked_mean from t")
def masked_mean(spark, sf_dir):
    return rounded(M.masked_mean(tokens(spark, sf_dir, "logp", "mask"), "logp"))


@query("a03_masked_var", f"with {T}, {MV} select round(m,6)+0.0 as mean, round(v,6)+0.0 as var from vv")
def masked_var(spark, sf_dir):
    return rounded(M.masked_var(tokens(spark, sf_dir, "logp", "mask"), "logp"))


@query("a04_masked_whiten", f"""with {T}, {MV}
  select uid, rollout_n, round(sum((logp-m)/sqrt(v+1e-8)*mask),6)+0.0 as white from t, vv group by 1,2""")
def whiten(spark, sf_dir):
    from rewardloom.functions import seq

    df = M.masked_whiten(tokens(spark, sf_dir, "logp", "mask"), "logp", out="w")
    return df.select("uid", "rollout_n", r6(seq.masked_sum("w", "mask")).alias("white"))


@query("a05_group_mean_std", f"""with {R} select uid, count(*) as group_size,
  round(case when count(*)=1 then 0 else avg(score) end,6)+0.0 as group_mean,
  round(case when count(*)=1 then 1 else stddev_samp(score) end,6)+0.0 as group_std from r group by uid""")
def group_stats(spark, sf_dir):
    return rounded(M.group_table(rollouts(spark, sf_dir), "uid", "score"))


@query("a06_factorize", f"with {R} select uid, rollout_n, dense_rank() over (order by uid)-1 as group_id from r")
def factorize(spark, sf_dir):
    return M.factorize(rollouts(spark, sf_dir), "uid").select("uid", "rollout_n", "group_id")


@query("a07_column_stats", f"with {R} select round(avg(score),6) as mean, max(score) as max, min(score) as min, round(stddev_samp(score),6) as std from r")
def column_stats(spark, sf_dir):
    return rounded(M.column_stats(rollouts(spark, sf_dir), "score"))


@query("a08_global_masked_mean", f"with {T} select round(sum(values*mask)/sum(mask),6)+0.0 as masked_mean from t".replace("values*", '"values"*'))
def global_masked_mean(spark, sf_dir):
    return rounded(M.global_masked_mean(tokens(spark, sf_dir, "values", "mask"), "values"))


_ROWS = "x as (select uid, rollout_n, sum(entropy*mask) s, sum(mask) n, count(*) w from t group by 1,2)"
for _mode, _sql in {
    "token_mean": "sum(s)/sum(n)",
    "seq_mean_token_sum": "sum(case when n>0 then s else 0 end)/count(*) filter (where n>0)",
    "seq_mean_token_mean": "sum(s/(n+1e-8))/count(*) filter (where n>0)",
    "seq_mean_token_sum_norm": "sum(s)/max(w)",
}.items():
    def _run(spark, sf_dir, mode=_mode.replace("_", "-")):
        return rounded(M.agg_loss(tokens(spark, sf_dir, "entropy", "mask"), "entropy", mode=mode))

    query(f"a09_agg_loss_{_mode}", f"with {T}, {_ROWS} select round({_sql},6)+0.0 as loss from x")(_run)


# Metric rows: one step per parameter version, several keys derived from the rollouts of the step.
M_SQL = """
base as (select param_version as step, count(*)::double as rows, avg(score) as s_mean, max(score) as s_max, min(score) as s_min,
   sum(response_len)::double as tokens, avg(response_len)/10.0 as seconds from r group by 1),
metrics as (select step, rows as weight, unnest([
  {'key': 'critic/score/mean', 'value': s_mean}, {'key': 'critic/score/max', 'value': s_max}, {'key': 'critic/score/min', 'value': s_min},
  {'key': 'perf/total_num_tokens', 'value': tokens}, {'key': 'perf/time_per_step', 'value': seconds}, {'key': 'perf/throughput', 'value': tokens/seconds},
  {'key': 'timing_s/gen', 'value': seconds*0.6}, {'key': 'timing_s/step', 'value': seconds}, {'key': 'global_seqlen/max', 'value': tokens},
  {'key': 'global_seqlen/min', 'value': rows}, {'key': 'global_seqlen/minmax_diff', 'value': tokens-rows}, {'key': 'training/global_step', 'value': step::double},
  {'key': 'actor/lr', 'value': rows/1000}]) as k from base)"""


def metric_rows(spark, sf_dir):
    g = rollouts(spark, sf_dir).groupBy(F.col("param_version").alias("step")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg("score").alias("s_mean"), F.max("score").alias("s_max"),
        F.min("score").alias("s_min"), F.sum("response_len").cast("double").alias("tokens"), (F.avg("response_len") / 10.0).alias("seconds"))
    keys = {
        "critic/score/mean": F.col("s_mean"), "critic/score/max": F.col("s_max"), "critic/score/min": F.col("s_min"),
        "perf/total_num_tokens": F.col("tokens"), "perf/time_per_step": F.col("seconds"), "perf/throughput": F.col("tokens") / F.col("seconds"),
        "timing_s/gen": F.col("seconds") * 0.6, "timing_s/step": F.col("seconds"), "global_seqlen/max": F.col("tokens"),
        "global_seqlen/min": F.col("rows"), "global_seqlen/minmax_diff": F.col("tokens") - F.col("rows"),
        "training/global_step": F.col("step").cast("double"), "actor/lr": F.col("rows") / 1000}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in keys.items()]))
    return g.select("step", F.col("rows").alias("weight"), pairs.alias("k")).select("step", "weight", "k.key", "k.value")


@query("a10_reduce_metrics", f"""with {R}, {M_SQL}
  select k.key as key, round(case when contains(k.key,'max') then max(k.value) when contains(k.key,'min') then min(k.value) else avg(k.value) end,6)+0.0 as value
  from metrics group by k.key""")
def reduce_metrics(spark, sf_dir):
    return rounded(M.reduce_metrics(metric_rows(spark, sf_dir)))


_AGG = {"critic/score/mean": "mean", "critic/score/max": "max", "critic/score/min": "min", "perf/total_num_tokens": "sum"}


@query("a11_metric_series", f"""with {R}, {M_SQL}
  select k.key as key, split_part(k.key,'/',3) as agg, round(case split_part(k.key,'/',3) when 'mean' then avg(k.value) when 'max' then max(k.value) else min(k.value) end,6)+0.0 as value
  from metrics where k.key like 'critic/%' group by 1,2
  union all select k.key, 'sum', round(sum(k.value),6) from metrics where k.key = 'perf/total_num_tokens' group by 1""")
def metric_series(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for kv in _AGG.items() for x in kv])[F.col("key")]
    return rounded(M.metric_series(metric_rows(spark, sf_dir).withColumn("agg", kind).where("agg is not null")))


@query("a12_aggregate_steps", f"""with {R}, {M_SQL},
  a as (select k.key as key, sum(k.value) s, avg(k.value) a, max(k.value) hi, min(k.value) lo, arg_max(k.value, step) l from metrics group by 1),
  b as (select key, case when key='training/global_step' then 'last' when key='perf/time_per_step' or key like 'timing_s/%' then 'time_sum'
     when key like '%mean%' then 'avg' when key like '%max%' then 'max' when key like '%min%' then 'min' when key like '%total%' then 'sum' else 'avg' end as rule, * exclude (key) from a),
  c as (select key, case rule when 'last' then l when 'time_sum' then s when 'sum' then s when 'max' then hi when 'min' then lo else a end as value, rule from b)
  select key, case when key in ('global_seqlen/minmax_diff','perf/throughput') then 'derived' else rule end as rule,
   round(case key when 'global_seqlen/minmax_diff' then (select value from c where key='global_seqlen/max')-(select value from c where key='global_seqlen/min')
     when 'perf/throughput' then (select value from c where key='perf/total_num_tokens')/((select value from c where key='perf/time_per_step')*8)
     else value end,6)+0.0 as value from c
  union all select 'trainer/idle_ratio','derived', round((select value from c where key='timing_s/gen')/(select value from c where key='timing_s/step'),6)""")
def aggregate_steps(spark, sf_dir):
    return rounded(M.aggregate_steps(metric_rows(spark, sf_dir), workers=8.0))


@query("a13_response_info", f"""with {R} select uid, rollout_n, cast(1 + l_linenumber - case when l_linenumber > 3 then 1 else 0 end as bigint) as prompt_length,
  cast(response_len as bigint) as response_length from r""")
def response_info(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("attention_mask", F.expr(
        "concat(transform(sequence(0, l_linenumber), i -> if(i = 0 and l_linenumber > 3, 0, 1)), array_repeat(1, response_len), array_repeat(0, 60 - response_len))"))
    out = M.response_info(df, "attention_mask", F.lit(60))
    return out.select("uid", "rollout_n", "prompt_length", "response_length")


_DM = {"critic/score/mean": "avg(sc)", "critic/score/max": "max(sc)", "critic/score/min": "min(sc)",
       "critic/rewards/mean": "avg(rw)", "critic/rewards/max": "max(rw)", "critic/rewards/min": "min(rw)"}


@query("a14_data_metrics", f"""with {T}, p as (select p_partkey, p_size from part),
  x as (select uid, rollout_n, sum(rewards) sc, sum(rewards) - 0.01*sum(entropy) rw, any_value(response_len) rl, any_value(p_size) pl
        from t join p on l_partkey = p_partkey group by 1,2),
  y as (select avg(advantages) am, max(advantages) ax, min(advantages) an, avg(vpreds) rm, max(vpreds) rx, min(vpreds) rn, avg("values") vm, max("values") vx, min("values") vn,
     1 - var_samp(vpreds - "values")/(var_samp(vpreds)+1e-5) ev from t join p on l_partkey = p_partkey where mask<>0)
  select round(avg(sc),6)+0.0 as score_mean, max(sc)+0.0 as score_max, min(sc)+0.0 as score_min, round(avg(rw),6)+0.0 as rewards_mean,
   round(max(rw),6)+0.0 as rewards_max, round(min(rw),6)+0.0 as rewards_min,
   round(any_value(am),6)+0.0 as advantages_mean, any_value(ax)+0.0 as advantages_max, any_value(an)+0.0 as advantages_min,
   round(any_value(rm),6)+0.0 as returns_mean, round(any_value(rx),6)+0.0 as returns_max, round(any_value(rn),6)+0.0 as returns_min,
   round(any_value(vm),6)+0.0 as values_mean, round(any_value(vx),6)+0.0 as values_max, any_value(vn)+0.0 as values_min, round(any_value(ev),6)+0.0 as explained_var,
   round(avg(rl),6) as response_mean, max(rl)::double as response_max, min(rl)::double as response_min, round(avg((rl=50)::int),6) as response_clip,
   round(avg(pl),6) as prompt_mean, max(pl)::double as prompt_max, round(avg((pl=50)::int),6) as prompt_clip from x, y""")
def data_metrics(spark, sf_dir):
    df = tokens(spark, sf_dir, "rewards", "entropy", "advantages", "vpreds", "values", "mask")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    df = df.join(part, df.l_partkey == part.p_partkey).withColumn("scores", F.col("rewards"))
    df = df.withColumn("rewards", F.zip_with("rewards", "entropy", lambda r, e: r - e * 0.01)).withColumn("returns", F.col("vpreds"))
    df = df.withColumn("prompt_length", F.col("p_size")).withColumn("response_length", F.col("response_len"))
    out = rounded(M.data_metrics(df, True, 50, 50))
    names = {"critic/score": "score", "critic/rewards": "rewards", "critic/advantages": "advantages", "critic/returns": "returns",
             "critic/values": "values"}
    picked = [F.col(f"`{a}/{s}`").alias(f"{b}_{s}") for a, b in names.items() for s in ("mean", "max", "min")]
    picked += [F.col("`critic/vf_explained_var`").alias("explained_var")]
    picked += [F.col(f"`response_length/{s}`").alias(f"response_{n}") for s, n in (("mean", "mean"), ("max", "max"), ("min", "min"), ("clip_ratio", "clip"))]
    picked += [F.col(f"`prompt_length/{s}`").alias(f"prompt_{n}") for s, n in (("mean", "mean"), ("max", "max"), ("clip_ratio", "clip"))]
    return out.select(*picked)


@query("a15_corrected_score_stats", f"""with {R}, x as (select case when pred % 3 = 0 then 0.0::double else score end as s, score as e from r),
  y as (select case when abs(s)<1e-9 and abs(e)>=1e-9 then e else s end as f, s from x)
  select round(avg(f),6) as score_mean, max(f) as score_max, min(f) as score_min, round(avg((f<>s)::int),6) as padding_ratio from y""")
def corrected(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("s", F.expr("if(pred % 3 = 0, 0.0D, score)"))
    return rounded(M.corrected_score_stats(df, "s", "score"))


@query("a16_sub_reward_stats", f"""with {R}, x as (select lower(data_source) s, score/10 as a, pred/8.0 as b from r)
  select 'r_depth_consistency' as key, round(avg(a),6) as mean, max(a) as max, min(a) as min from x where contains(s,'1-') or contains(s,'spec')
  union all select 'r_other', round(avg(b),6), max(b), min(b) from x
  union all select 'r_proj', round(avg(a),6), max(a), min(a) from x""")
def sub_reward(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("extras", F.create_map(
        F.lit("r_depth_consistency"), F.col("score") / 10, F.lit("r_other"), F.col("pred") / F.lit(8.0), F.lit("r_proj"), F.col("score") / 10))
    return rounded(M.sub_reward_stats(df, "extras", "data_source", {"r_depth_consistency": ["1-", "spec"], "r_proj": ["no-such-source"]}))


_TIMES = """tm as (select param_version as step, sum(response_len)::double tok, sum(response_len + l_linenumber)::double allt, avg(response_len)/10 g, avg(l_linenumber) u from r group by 1)"""


@query("a17_timing_metrics", f"""with {R}, {_TIMES}
  select step, 'gen' as section, round(g,6) as seconds, round(g*1000/tok,6) as ms_per_token from tm
  union all select step, 'update', round(u,6), round(u*1000/allt,6) from tm""")
def timing(spark, sf_dir):
    t = rollouts(spark, sf_dir).groupBy(F.col("param_version").alias("step")).agg(
        F.sum("response_len").alias("tok"), F.sum(F.col("response_len") + F.col("l_linenumber")).alias("allt"),
        (F.avg("response_len") / 10).alias("g"), F.avg("l_linenumber").alias("u"))
    times = t.select("step", F.expr("stack(2, 'gen', g, 'update', u) as (section, seconds)"))
    return rounded(M.timing_metrics(times, t.select("step", "tok", "allt"), {"gen": "tok", "update": "allt"}))


@query("a18_throughput_metrics", f"""with {R} select sum(response_len)::double as total_num_tokens, max(score) as time_per_step,
  round(sum(response_len)/(max(score)*8),6) as throughput from r""")
def throughput(spark, sf_dir):
    return rounded(M.throughput_metrics(rollouts(spark, sf_dir), "response_len", "score", 8.0))


@query("a19_variance_proxy_metrics", f"""with {T}, x as (select uid, rollout_n, sum(advantages*mask)/(sum(mask)+1e-8) a, sum((1-2*exp(old_logp)+sum_pi_squared)*mask) w from t group by 1,2),
  y as (select avg(a*a*greatest(w,0)) p, avg(a*a) a2, avg(w) ew, count(*) n from x)
  select 0.25::double as proxy1_signal_strength, round(p,6)+0.0 as proxy2_total_power, round(greatest(0,(p-0.25)/(n-1)),6)+0.0 as proxy3_pure_noise,
   round(a2,6)+0.0 as expected_a_squared, round(ew,6)+0.0 as expected_w from y""")
def variance_proxy(spark, sf_dir):
    return rounded(M.variance_proxies(tokens(spark, sf_dir, "old_logp", "sum_pi_squared", "advantages", "mask"), gradient_norm=0.5))


@query("a23_logprob_diff_metrics", f"""with {T} select 1 as valid, round(max(abs(exp(logp)-exp(old_logp))),6) as diff_max, round(avg(abs(exp(logp)-exp(old_logp))),6) as diff_mean,
  round(stddev_samp(abs(exp(logp)-exp(old_logp))),6) as diff_std, round(corr(exp(logp),exp(old_logp)),6) as pearson from t where mask<>0""")
def logprob_diff(spark, sf_dir):
    return rounded(M.logprob_diff_metrics(tokens(spark, sf_dir, "logp", "old_logp", "mask"), "logp", "old_logp"))


@query("a24_token_diff_count", f"with {T} select uid, rollout_n, count(*) filter (where logp<>old_logp and mask<>0) as differing from t group by 1,2")
def token_diff(spark, sf_dir):
    df = tokens(spark, sf_dir, "logp", "old_logp", "mask")
    return df.select("uid", "rollout_n", M.token_diff_count("logp", "old_logp").alias("differing"))


@query("a25_percentile_report", """select event_type, round(avg(value),6)+0.0 as avg, max(value)+0.0 as max, min(value)+0.0 as min, round(quantile_cont(value,0.5),6)+0.0 as tp50,
  round(quantile_cont(value,0.95),6)+0.0 as tp95, round(quantile_cont(value,0.99),6)+0.0 as tp99 from events group by 1""")
def percentiles(spark, sf_dir):
    return rounded(M.percentile_report(table(spark, sf_dir, "events"), "value", ["event_type"]))


@query("a25_partial_rollout_stats", f"""with {R}, x as (select data_source, param_version e, param_version - pred as s from r)
  select data_source, cast(sum((e<>s)::int) as bigint) as partial, round(avg((e<>s)::int),6) as partial_ratio, max(abs(e-s)) as max_span, count(distinct e) as versions from x group by 1""")
def partial_stats(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("start", F.col("param_version") - F.col("pred"))
    return rounded(M.partial_rollout_stats(df, "start", "param_version", "param_version", ["data_source"]))


@query("a26_slowest_rollout", f"""with {R}, x as (select *, response_len*1.0::double g, (l_suppkey % 17)::double + row_idx/1e9 w from r)
  select data_source, g as gen_s, w as tool_s, round(g+w,6) as slowest_total, uid, rollout_n from x qualify row_number() over (partition by data_source order by g+w desc)=1""")
def slowest(spark, sf_dir):
    df = rollouts(spark, sf_dir, indexed=True).withColumn("gen_s", F.col("response_len").cast("double"))
    df = df.withColumn("tool_s", (F.col("l_suppkey") % 17).cast("double") + F.col("row_idx") / 1e9)
    out = M.slowest_rollout(df, "gen_s", "tool_s", "uid", "rollout_n", by=["data_source"])
    return out.withColumn("slowest_total", r6(F.col("slowest_total")))


@query("a27_length_unbalance", f"""with {R}, x as (select row_idx % 8 as b, l_partkey % 8 as a, response_len from r),
  s as (select 'before' as stage, b as p, sum(response_len) t from x group by b union all select 'after', a, sum(response_len) from x group by a)
  select stage, min(t)::bigint as min_tokens, max(t)::bigint as max_tokens, (max(t)-min(t))::bigint as minmax_diff, round(avg(t),6) as mean_tokens from s group by stage""")
def unbalance(spark, sf_dir):
    df = rollouts(spark, sf_dir, indexed=True).withColumn("b", F.col("row_idx") % 8).withColumn("a", F.col("l_partkey") % 8)
    return rounded(M.length_unbalance(df, "response_len", "b", "a"))


@query("a28_flops_estimate", f"""with {R} select sum(response_len)::double as tokens, round(sum(response_len)*6*7e9/1e12,6) as dense_tflops,
  round(sum(response_len*response_len)*12.0*128*32*32/1e12,6) as attention_tflops,
  round((sum(response_len)*6*7e9 + sum(response_len*response_len)*12.0*128*32*32)/2.0/1e12,6) as tflops from r""")
def flops(spark, sf_dir):
    return rounded(M.flops_estimate(rollouts(spark, sf_dir), "response_len", 7e9, 32, 128, 32, 2.0))


@query("a29_view_type_loss", f"""with {T}, x as (select view_type, uid, rollout_n, sum(entropy*mask) s, sum(mask) n from t group by 1,2,3)
  select view_type, round(sum(s),4)+0.0 as loss_sum, cast(sum(n) as bigint) as tokens, count(*) as samples from x where n>0 group by 1""")
def view_loss(spark, sf_dir):
    return rounded(M.view_type_loss(tokens(spark, sf_dir, "entropy", "mask"), "entropy", "mask"), digits=4)


@query("a31_source_score", f"""with {R}, i as (select data_source, uid, avg(score) s from r group by 1,2)
  select data_source, round(avg(s),6) as test_score, count(*) as items from i group by 1""")
def source_score(spark, sf_dir):
    return rounded(M.source_score(rollouts(spark, sf_dir)))


@query("a32_workload", f"with {R} select data_source, sum(24576::bigint*response_len + response_len::bigint*response_len)::bigint as work from r group by 1")
def workload(spark, sf_dir):
    return rollouts(spark, sf_dir).groupBy("data_source").agg(F.sum(M.workload(F.col("response_len"))).alias("work"))
