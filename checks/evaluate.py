"""Evaluation and retrieval against SQL."""

from pyspark.sql import functions as F

from checks.base import R, query, r6, rollouts, rounded, table
from rewardloom.operators import evaluate as E
from rewardloom.operators import retrieve as X

KS = "ks as (select n, unnest(list_distinct(list_append(list_filter([2,4,8,16,32,64], lambda x: x < n), n))) as k from (select distinct count(*) n from r group by uid) where n > 1)"


@query("e02_mean_std_at_n", f"with {R} select data_source, uid, count(*) as n, round(avg(score),6) as mean, round(stddev_pop(score),6)+0.0 as std from r group by 1,2")
def mean_std(spark, sf_dir):
    return rounded(E.mean_std_at_n(rollouts(spark, sf_dir), ["data_source", "uid"], "score"))


EXACT = f"""with {R}, {KS}, g as (select uid, count(*) n from r group by 1), o as (select uid, score, row_number() over (partition by uid order by score)::double i from r),
  x as (select o.uid, k, score v, pow(i/n,k)-pow((i-1)/n,k) a, pow(1-(i-1)/n,k)-pow(1-i/n,k) b from o join g using (uid) join ks using (n))"""


@query("e04_best_worst_exact", EXACT + """ select uid, cast(k as bigint) as k, round(sum(v*a),6)+0.0 as best_mean, round(sum(v*b),6)+0.0 as worst_mean from x group by 1,2""")
def exact(spark, sf_dir):
    return rounded(E.best_worst_exact(rollouts(spark, sf_dir), ["uid"], "score").select("uid", "k", "best_mean", "worst_mean"))


BOOT = f"""with {R}, {KS}, u as (select n, k, b, ('0x' || substr(md5('42|' || k || '|' || b),1,13))::bigint::double/pow(2,52) as u from ks, range(1, 1001) as z(b)),
  p as (select n, k, 'best' as side, least(greatest(ceil(n*pow(u, 1.0::double/k))-1, 0), n-1)::bigint as rank, count(*) w from u group by 1,2,3,4
    union all select n, k, 'worst', least(floor(n*(1-pow(1-u, 1.0::double/k))), n-1)::bigint, count(*) from u group by 1,2,3,4),
  g as (select uid, count(*) n from r group by 1), o as (select uid, score, row_number() over (partition by uid order by score, rollout_n)-1 as rank from r)"""


@query("e03_best_worst_bootstrap", BOOT + """ select uid, cast(k as bigint) as k, round(sum(case when side='best' then score*w end)/1000.0,6)+0.0 as best_mean, round(sum(case when side='worst' then score*w end)/1000.0,6)+0.0 as worst_mean
  from o join g using (uid) join p using (n, rank) group by 1,2""")
def bootstrap(spark, sf_dir):
    return rounded(E.best_worst_bootstrap(rollouts(spark, sf_dir), ["uid"], "score", "rollout_n").select("uid", "k", "best_mean", "worst_mean"))


@query("e05_majority_value", f"""with {R}, v as (select uid, pred, count(*) c, min(rollout_n) f from r group by 1,2), w as (select *, row_number() over (partition by uid order by c desc, f) k from v)
  select w.uid, r.score as majority from w join r on r.uid = w.uid and r.rollout_n = w.f where k = 1""")
def majority(spark, sf_dir):
    return E.majority_value(rollouts(spark, sf_dir), ["uid"], "pred", "score", "rollout_n")


MAJ = f"""with {R}, {KS}, cells as (select n, k, j // k as b, j % k as j, floor(('0x' || substr(md5('42|' || k || '|' || j),1,13))::bigint::double/pow(2,52)*n)::bigint as i from ks, unnest(range(0, 1000*k)) as z(j)),
  g as (select uid, count(*) n from r group by 1),
  d as (select g.uid, k, b, j, pred, score from g join cells using (n) join r on r.uid = g.uid and r.rollout_n = cells.i),
  v as (select uid, k, b, pred, count(*) c, min(j) f, arg_min(score, j) s from d group by 1,2,3,4),
  w as (select uid, k, b, s, row_number() over (partition by uid, k, b order by c desc, f) q from v)"""


@query("e06_maj_at_k_bootstrap", MAJ + " select uid, cast(k as bigint) as k, round(avg(s),6)+0.0 as maj_mean from w where q = 1 group by 1,2")
def maj_boot(spark, sf_dir):
    return rounded(E.majority_bootstrap(rollouts(spark, sf_dir), ["uid"], "pred", "score", "rollout_n").select("uid", "k", "maj_mean"))


VAL = EXACT + """,
  m as (select data_source, 'mean@' || n as metric, avg(s) as value from (select data_source, uid, count(*) n, avg(score) s from r group by 1,2) group by 1,2
   union all select data_source, 'std@' || n, avg(s) from (select data_source, uid, count(*) n, stddev_pop(score) s from r group by 1,2) where n > 1 group by 1,2
   union all select data_source, 'best@' || k || '/mean', avg(s) from (select uid, k, sum(v*a) s from x group by 1,2) join (select distinct uid, data_source from r) using (uid) group by 1,2
   union all select data_source, 'worst@' || k || '/mean', avg(s) from (select uid, k, sum(v*b) s from x group by 1,2) join (select distinct uid, data_source from r) using (uid) group by 1,2)"""


def validation(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("acc", F.col("score"))
    out = E.validation_metrics(df, "data_source", "uid", ["acc", "view_type"], "rollout_n", exact=True)
    return out.where(~F.col("metric").rlike("^(best|worst).*/std$"))


@query("e01_validation_metrics", VAL + " select data_source, 'acc' as variable, metric, round(value,6)+0.0 as value from m")
def validation_metrics(spark, sf_dir):
    return rounded(validation(spark, sf_dir))


@query("e07_val_sections", VAL + """, t as (select data_source, max(regexp_extract(metric, '@([0-9]+)', 1)::int) n from m group by 1)
  select case when regexp_matches(metric, '^(mean|maj|best)') and contains(metric, '@' || n) then 'val-core' else 'val-aux' end || '/' || data_source || '/acc/' || metric as key, round(value,6)+0.0 as value from m join t using (data_source)""")
def sections(spark, sf_dir):
    return rounded(E.val_sections(validation(spark, sf_dir)))


SPREAD = "sqrt(greatest(sum(case when side='{0}' then score*score*w end)/1000.0 - pow(sum(case when side='{0}' then score*w end)/1000.0, 2), 0))"
BOTH = f"""bw as (select uid, k, sum(case when side='best' then score*w end)/1000.0 as bm, {SPREAD.format('best')} as bs, sum(case when side='worst' then score*w end)/1000.0 as wm,
    {SPREAD.format('worst')} as ws from o join g using (uid) join p using (n, rank) group by 1,2)"""


@query("e03_best_worst_bootstrap_spread", BOOT + f", {BOTH} select uid, cast(k as bigint) as k, round(bs,6)+0.0 as best_std, round(ws,6)+0.0 as worst_std from bw")
def bootstrap_spread(spark, sf_dir):
    return rounded(E.best_worst_bootstrap(rollouts(spark, sf_dir), ["uid"], "score", "rollout_n").select("uid", "k", "best_std", "worst_std"))


@query("e04_best_worst_exact_spread", EXACT + """ select uid, cast(k as bigint) as k, round(sqrt(greatest(sum(v*v*a)-pow(sum(v*a),2),0)),6)+0.0 as best_std,
  round(sqrt(greatest(sum(v*v*b)-pow(sum(v*b),2),0)),6)+0.0 as worst_std from x group by 1,2""")
def exact_spread(spark, sf_dir):
    return rounded(E.best_worst_exact(rollouts(spark, sf_dir), ["uid"], "score").select("uid", "k", "best_std", "worst_std"))


@query("e06_maj_at_k_spread", MAJ + " select uid, cast(k as bigint) as k, round(stddev_pop(s),6)+0.0 as maj_std from w where q = 1 group by 1,2")
def maj_spread(spark, sf_dir):
    return rounded(E.majority_bootstrap(rollouts(spark, sf_dir), ["uid"], "pred", "score", "rollout_n").select("uid", "k", "maj_std"))


RESAMPLED = BOOT + MAJ[MAJ.index(", cells as"):].replace(""",
  g as (select uid, count(*) n from r group by 1)""", "") + f""", {BOTH}, mj as (select uid, k, avg(s) as m, stddev_pop(s) as d from w where q = 1 group by 1,2),
  src as (select uid, any_value(data_source) as data_source, count(*) as n, avg(score) as a, stddev_pop(score) as s from r group by 1),
  named as (select data_source, 'mean@' || n as metric, a as value from src union all select data_source, 'std@' || n, s from src where n > 1
    union all select data_source, 'best@' || k || '/mean', bm from bw join src using (uid) union all select data_source, 'best@' || k || '/std', bs from bw join src using (uid)
    union all select data_source, 'worst@' || k || '/mean', wm from bw join src using (uid) union all select data_source, 'worst@' || k || '/std', ws from bw join src using (uid)
    union all select data_source, 'maj@' || k || '/mean', m from mj join src using (uid) union all select data_source, 'maj@' || k || '/std', d from mj join src using (uid)),
  m as (select data_source, metric, avg(value) as value from named group by 1,2)"""


def resampled(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("acc", F.col("score"))
    return E.validation_metrics(df, "data_source", "uid", ["acc"], "rollout_n", pred="pred")


@query("e01_validation_with_predictions", RESAMPLED + " select data_source, 'acc' as variable, metric, round(value + 1e-9,6)+0.0 as value from m")
def validation_with_predictions(spark, sf_dir):
    """As users run it: resampled best, worst and majority, with deviations. Means of few digits may end in a 5, so both sides round beside it."""
    return rounded(resampled(spark, sf_dir).withColumn("value", F.col("value") + 1e-9))


@query("e07_val_sections_with_predictions", RESAMPLED + """, t as (select data_source, max(regexp_extract(metric, '@([0-9]+)', 1)::int) n from m group by 1)
  select case when regexp_matches(metric, '^(mean|maj|best)') and contains(metric, '@' || n) then 'val-core' else 'val-aux' end || '/' || data_source || '/acc/' || metric as key, round(value + 1e-9,6)+0.0 as value from m join t using (data_source)""")
def sections_with_predictions(spark, sf_dir):
    return rounded(E.val_sections(resampled(spark, sf_dir)).withColumn("value", F.col("value") + 1e-9))


@query("e08_pass_at_k_rewards", EXACT + " select round(avg(b),6) as mean_best from (select uid, k, sum(v*a) b from x group by 1,2)")
def pass_at_k(spark, sf_dir):
    out = E.best_worst_exact(rollouts(spark, sf_dir), ["uid"], "score")
    return out.agg(r6(F.avg("best_mean")).alias("mean_best"))


@query("e09_eval_responses", f"""with {R}, x as (select data_source, uid, avg((pred = 3)::int) s from r group by 1,2) select data_source, round(avg(s),6) as test_score, count(*) as items from x group by 1""")
def eval_responses(spark, sf_dir):
    from rewardloom.operators.score import hash_prediction

    df = rollouts(spark, sf_dir)
    prompts = df.select("uid", "data_source").distinct()
    lists = E.attach_responses(prompts, df.withColumn("text", F.concat(F.lit("#### "), F.col("pred"))), "uid", "text", "rollout_n")
    return rounded(E.eval_responses(lists, "data_source", "uid", "responses", lambda t: (hash_prediction(t) == "3").cast("double")))


@query("e10_attach_responses", f"with {R} select o_orderkey as uid, o_orderpriority, 0 as segment, string_agg(pred::varchar, ',' order by rollout_n) as responses from orders left join r on r.uid = o_orderkey group by 1,2")
def attach(spark, sf_dir):
    prompts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), "o_orderpriority")
    out = E.attach_responses(prompts, rollouts(spark, sf_dir).withColumn("text", F.col("pred").cast("string")), "uid", "text", "rollout_n")
    return out.select("uid", "o_orderpriority", "segment", F.array_join("responses", ",").alias("responses"))


# ---------------------------------------------------------------- retrieval


@query("x01_dense_topk", """with e as (select vec_id, [x::double for x in embedding] as v from embeddings),
  n as (select vec_id, v, sqrt(list_sum([x*x for x in v])) as l from e),
  s as (select q.vec_id as query_id, c.vec_id as doc_id, list_dot_product(q.v, c.v)/(q.l*c.l) as score from n q, n c where q.vec_id % 100 = 0),
  k as (select *, row_number() over (partition by query_id order by score desc, doc_id) r from s)
  select query_id, doc_id, cast(r as integer) as rank, round(score,6)+0.0 as score from k where r <= 5""")
def dense(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(X.dense_topk(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), 5))


_TERMS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query("j08_query_corpus_best", """with e as (select vec_id, label, [x::double for x in embedding] as v from embeddings), n as (select vec_id, label, v, sqrt(list_sum([x*x for x in v])) as l from e),
  s as (select q.vec_id as query_id, c.vec_id as doc_id, c.label, list_dot_product(q.v, c.v)/(q.l*c.l) as score from n q, n c),
  k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) r from s)
  select query_id, count(*) as hits, round(max(score),6) as best, round(min(score),6)+0.0 as worst from k where r <= 3 group by 1""")
def best_of_corpus(spark, sf_dir):
    """Every vector as a query, in small blocks, so several blocks meet the corpus."""
    e = table(spark, sf_dir, "embeddings")
    hits = X.dense_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 3, block=200)
    return rounded(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"), F.min("score").alias("worst")))


@query("x02_bm25_topk", f"""with d as (select doc_id, unnest({_TERMS}) as term from documents), tf as (select doc_id, term, count(*)::double tf from d group by 1,2),
  len as (select doc_id, sum(tf) dl from tf group by 1), st as (select count(*)::double n, sum(dl)/(select count(*) from documents) avg_dl from (select doc_id, coalesce(dl,0) dl from documents left join len using (doc_id))),
  df as (select term, count(*)::double df from tf group by 1), q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
  s as (select item_id as query_id, doc_id, sum(ln(1 + (n - df + 0.5)/(df + 0.5)) * tf*(1.9::double)/(tf + 0.9::double*(1 - 0.4::double + 0.4::double*dl/avg_dl))) as score
    from q join tf using (term) join df using (term) join len using (doc_id), st group by 1,2),
  k as (select *, row_number() over (partition by query_id order by round(score,6) desc, doc_id) r from s)
  select query_id, doc_id, cast(r as integer) as rank, round(score,6) as score from k where r <= 3""")
def bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return X.bm25_topk(queries, docs, 3)


@query("x03_split_title_text", "select doc_id, split_part(text, chr(10), 1) as title, case when contains(text, chr(10)) then substr(text, length(split_part(text, chr(10), 1)) + 2) else '' end as body from documents")
def split_title(spark, sf_dir):
    parts = X.split_title_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", parts["title"].alias("title"), parts["text"].alias("body"))


@query("x04_attach_passages", """with l as (select doc_id, row_number() over (partition by source order by doc_id) r, source, text from documents)
  select source, string_agg('Doc ' || r || ' (Title: ' || split_part(text, chr(10), 1) || ')' || chr(10) || case when contains(text, chr(10)) then substr(text, length(split_part(text, chr(10), 1)) + 2) else '' end || chr(10) || chr(10), '' order by r) as block from l where r <= 3 group by 1""")
def attach_passages(spark, sf_dir):
    from rewardloom.plans.scale import top_k

    d = table(spark, sf_dir, "documents")
    hits = top_k(d.select(F.col("source").alias("query_id"), "doc_id"), ["query_id"], ["doc_id"], 3)
    q = d.select(F.col("source").alias("query_id")).distinct()
    return X.attach_passages(q, hits, d.select("doc_id", "text")).select(F.col("query_id").alias("source"), F.col("passages").alias("block"))
