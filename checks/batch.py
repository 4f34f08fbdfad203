"""Batch algebra, joins, sampling and set operators against SQL."""

from pyspark.sql import functions as F

from checks.base import R, T, query, r6, rollouts, rounded, table, tokens
from rewardloom.operators import batch as B
from rewardloom.operators import joins as J
from rewardloom.operators import sample as S
from rewardloom.operators import setops as U
from rewardloom.plans.scale import rank_within, with_group_stats

KEEP = ["row_idx", "uid", "rollout_n", "score"]


def rows(spark, sf_dir):
    return rollouts(spark, sf_dir, indexed=True)


@query("b01_check_consistency", f"with {T} select row_idx, count(*) as width from t group by 1")
def consistency(spark, sf_dir):
    df = B.check_consistency(tokens(spark, sf_dir, "mask", "rewards", indexed=True), ["mask", "rewards"])
    return df.select("row_idx", F.size("rewards").cast("long").alias("width"))


query("b02_select", f"with {R} select row_idx, score, pred from r")(lambda s, d: B.select(rows(s, d), ["score", "pred"]))


@query("b03_pop", f"with {R} select row_idx, score, uid, l_partkey from r")
def pop(spark, sf_dir):
    popped, rest = B.pop(rows(spark, sf_dir), ["score"])
    return J.positional(popped, rest).select("row_idx", "score", "uid", "l_partkey")


query("b04_rename", f"with {R} select row_idx, score as reward, pred as answer from r")(
    lambda s, d: B.rename(rows(s, d).select("row_idx", "score", "pred"), ["score", "pred"], ["reward", "answer"]))
query("b05_select_mask", f"with {R} select row_number() over (order by row_idx)-1 as row_idx, uid, rollout_n from r where score > 4")(
    lambda s, d: B.select_mask(rows(s, d), F.col("score") > 4).select("row_idx", "uid", "rollout_n"))


@query("b05_select_idxs", f"with {R}, p as (select row_idx as pos, (row_idx*7919) % (select count(*) from r) as idx from r) select p.pos as row_idx, r.uid, r.rollout_n from p join r on r.row_idx = p.idx")
def select_idxs(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid", "rollout_n")
    n = B.size(df)
    picks = df.select(F.col("row_idx").alias("pos"), ((F.col("row_idx") * 7919) % n).alias("idx"))
    return B.select_idxs(df, picks)


@query("b06_slice", f"""with {R}, n as (select count(*) n from r) select cast((row_idx-10)/3 as bigint) as row_idx, uid, rollout_n from r, n where row_idx >= 10 and row_idx < n-5 and (row_idx-10) % 3 = 0""")
def slicing(spark, sf_dir):
    return B.slice_rows(rows(spark, sf_dir), 10, -5, 3).select("row_idx", "uid", "rollout_n")


@query("b07_concat", f"""with {R}, n as (select count(*) n from r) select row_idx, uid, pred, case when view_type is null then null else view_type end as view_type from r
  union all select row_idx + n, uid, 0, null from r, n""")
def concat(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid", "pred", "view_type")
    return B.concat([df, df.select("row_idx", "uid")])


@query("b08_union", f"with {R} select row_idx, uid, score, score*2 as doubled from r")
def union(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid", "score")
    return B.union(df, df.select("row_idx", "score", (F.col("score") * 2).alias("doubled")))


@query("b09_union_meta", f"with {R} select data_source, count(*) as n, 'run-1' as run, 7 as step from r group by 1")
def union_meta(spark, sf_dir):
    meta = B.union_meta({"run": "run-1"}, {"step": 7, "run": "run-1"})
    df = rollouts(spark, sf_dir).groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumns({k: F.lit(v) for k, v in meta.items()})


@query("b10_chunk", f"with {R}, n as (select ceil(count(*)/7.0) p from r) select cast(floor(row_idx/p) as integer) as chunk_id, count(*) as n, min(row_idx) as first from r, n group by 1")
def chunk(spark, sf_dir):
    return B.chunk(rows(spark, sf_dir), 7, auto_pad=True).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))


query("b11_split", f"with {R} select cast(floor(row_idx/1000) as bigint) as split_id, count(*) as n, max(row_idx) as last from r group by 1")(
    lambda s, d: B.split(rows(s, d), 1000).groupBy("split_id").agg(F.count(F.lit(1)).alias("n"), F.max("row_idx").alias("last")))


@query("b12_split_dataset", f"with {R}, n as (select count(*)//2 as h from r) select cast(row_idx//h as integer) as part, row_idx % h as row_idx, uid from r, n")
def split_dataset(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid")
    parts = B.split_dataset(df, 2)
    return parts[0].select(F.lit(0).alias("part"), "row_idx", "uid").unionByName(parts[1].select(F.lit(1).alias("part"), "row_idx", "uid"))


def _reversal(df):
    n = B.size(df)
    return df.select(F.col("row_idx").alias("pos"), (F.lit(n - 1) - F.col("row_idx")).alias("idx"))


query("b13_reorder", f"with {R} select (select count(*) from r)-1-row_idx as row_idx, uid, rollout_n from r")(
    lambda s, d: B.reorder(rows(s, d).select("row_idx", "uid", "rollout_n"), _reversal(rows(s, d))))


@query("b14_restore_order", f"with {R} select row_idx, uid, rollout_n from r")
def restore(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid", "rollout_n")
    n = B.size(df)
    perm = df.select(F.col("row_idx").alias("pos"), ((F.col("row_idx") + 12345) % n).alias("idx"))
    return B.restore_order(B.reorder(df, perm), perm)


query("b15_repeat_interleaved", f"with {R} select row_idx*3+k as row_idx, uid from r, range(3) as x(k)")(
    lambda s, d: B.repeat(rows(s, d).select("row_idx", "uid"), 3))
query("b15_repeat_blocks", f"with {R} select k*(select count(*) from r)+row_idx as row_idx, uid from r, range(2) as x(k)")(
    lambda s, d: B.repeat(rows(s, d).select("row_idx", "uid"), 2, interleave=False))


@query("b16_sample_level_repeat", f"""with {R}, c as (select r.row_idx as o, uid, k from r, unnest(range(0, pred % 3)) as x(k)) select row_number() over (order by o, k)-1 as row_idx, uid from c""")
def level_repeat(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid", (F.col("pred") % 3).alias("times"))
    return B.sample_level_repeat(df, "times").drop("times")


@query("b17_unfold_column_chunks", f"""with {R} select row_idx*2+k as row_idx, uid, cast(case when k=0 then 2*response_len*(2*response_len+1)//2/1 - (select 0) else 0 end as bigint)*0 +
  cast(case when k=0 then response_len*(response_len+1)//2 else (2*response_len)*(2*response_len+1)//2 - response_len*(response_len+1)//2 end as bigint) as total from r, range(2) as x(k)""")
def unfold_chunks(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid", F.expr("sequence(1L, 2L*response_len)").alias("ids"))
    out = B.unfold_column_chunks(df, 2, ["ids"])
    return out.select("row_idx", "uid", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


query("b18_fold_unfold", f"with {R} select row_idx, uid, score from r")(
    lambda s, d: B.unfold(B.fold(rows(s, d).select("row_idx", "uid", "score"), 16), 16))
query("b18_fold", f"with {R} select cast(row_idx//16 as bigint) as row_idx, sum(score) as total, cast(count(*) as integer) as n from r group by 1")(
    lambda s, d: B.fold(rows(s, d).select("row_idx", "score"), 16).select(
        "row_idx", F.aggregate("score", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("score").alias("n")))


@query("b19_pad_to_divisor", f"""with {R}, n as (select count(*) n from r), m as (select (7 - n % 7) % 7 k, n from n) select row_idx, uid, false as is_pad from r
  union all select n + row_idx, uid, true from r, m where row_idx < k""")
def pad_divisor(spark, sf_dir):
    return B.pad_to_divisor(rows(spark, sf_dir).select("row_idx", "uid"), 7)


query("b19_unpad", f"with {R} select row_idx, uid from r")(lambda s, d: B.unpad(B.pad_to_divisor(rows(s, d).select("row_idx", "uid"), 7)))
query("b20_pad_rows", f"with {R}, n as (select count(*) n from r) select row_idx, uid from r union all select n + k, uid from r, n, range(5) as x(k) where row_idx = n-1")(
    lambda s, d: B.pad_rows(rows(s, d).select("row_idx", "uid"), 5))


@query("b21_minibatches", f"""with {R}, e as (select row_idx, uid, ep::integer as epoch, md5('5|' || ep || '|' || row_idx) k from r, range(2) as x(ep)),
  o as (select *, row_number() over (partition by epoch order by k, row_idx)-1 i from e) select row_idx, epoch, cast(i//1000 as bigint) as batch_id from o""")
def minibatches(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "uid")
    return B.minibatches(df, 1000, 2, seed=5).select("row_idx", "epoch", "batch_id")


@query("b22_rows_to_columns", f"with {R} select uid, 0 as segment, array_to_string(list(cast(score as integer) order by rollout_n), ',') as scores from r group by uid")
def rows_to_columns(spark, sf_dir):
    out = B.rows_to_columns(rollouts(spark, sf_dir), "uid", "score", "rollout_n")
    return out.select("uid", "segment", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",").alias("scores"))


@query("b23_assign_uid_rollout_n", f"with {R} select md5(uid::varchar) as uid, rollout_n, score from r")
def assign_uid(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumnRenamed("rollout_n", "given").withColumnRenamed("uid", "k")
    return B.with_rollout_n(B.assign_uid(df, ["k"]), "uid", ["given"]).select("uid", "rollout_n", "score")


query("b24_flatten_trajectories", f"with {T} select row_idx, cast(t-1 as integer) as step_idx, mask, rewards from t")(
    lambda s, d: B.flatten_trajectories(tokens(s, d, "mask", "rewards", indexed=True).select("row_idx", "mask", "rewards"), ["mask", "rewards"]))


@query("b25_batch_size_report", """select 'doc_id' as "column", 'bigint' as type, count(*) as rows, cast(8*count(*) as bigint) as bytes from documents
  union all select 'text', 'string', count(*), cast(sum(strlen(text)) as bigint) from documents union all select 'lang','string', count(*), cast(sum(strlen(lang)) as bigint) from documents""")
def size_report(spark, sf_dir):
    return B.batch_size_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("b26_deep_equal", f"with {R} select 0::bigint as only_left, count(*) filter (where score < 1) as only_right, count(*) filter (where pred = 3 and score >= 1) as different from r")
def deep_equal(spark, sf_dir):
    df = rows(spark, sf_dir).select("row_idx", "score", "pred")
    a = df.where("score >= 1").withColumn("pred", F.expr("if(pred = 3, -1, pred)"))
    return B.deep_equal(a, df)


# ---------------------------------------------------------------- joins


@query("j01_rollouts_prompts", f"with {R} select uid, rollout_n, o_totalprice, o_orderstatus from r join orders on uid = o_orderkey")
def j_prompts(spark, sf_dir):
    prompts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), "o_totalprice", "o_orderstatus")
    return J.with_prompts(rollouts(spark, sf_dir).select("uid", "rollout_n"), prompts)


query("j02_positional", f"with {R} select row_idx, uid, pred from r")(
    lambda s, d: J.positional(rows(s, d).select("row_idx", "uid"), rows(s, d).select("row_idx", "pred")))


@query("j03_group_stats_to_rows", f"with {R} select uid, rollout_n, count(*) over (partition by uid) as n, round(avg(score) over (partition by uid),6) as m from r")
def j_stats(spark, sf_dir):
    from rewardloom.plans.scale import with_group_stats

    out = with_group_stats(rollouts(spark, sf_dir).select("uid", "rollout_n", "score"), ["uid"], F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"))
    return rounded(out.drop("score"))


query("j04_keep_groups", f"with {R} select uid, rollout_n from r where uid in (select uid from r where score = 10)")(
    lambda s, d: J.keep_groups(rollouts(s, d), rollouts(s, d).where("score = 10")).select("uid", "rollout_n"))
query("j05_unmatched", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")(
    lambda s, d: J.unmatched(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), ["doc_id"]))


@query("j06_paired_generations", f"with {R} select a.uid, a.rollout_n, a.score, b.pred as inverse_pred from r a join r b using (uid, rollout_n) where b.score > 2")
def j_paired(spark, sf_dir):
    df = rollouts(spark, sf_dir)
    return J.paired_generations(df.select("uid", "rollout_n", "score"), df.where("score > 2").select("uid", "rollout_n", "pred"))


@query("j09_baseline", f"with {R}, g as (select uid, score as b from r where rollout_n = 1) select uid, rollout_n, coalesce(b, 0) as baseline from r left join g using (uid)")
def j_baseline(spark, sf_dir):
    df = rollouts(spark, sf_dir)
    return J.with_baseline(df, df.where("rollout_n = 1")).select("uid", "rollout_n", "baseline")


@query("j10_as_of_version", """with v as (select ts, event_id as version from events where event_type = 'error')
  select e.event_id, v.version as current_version from events e asof left join v on e.ts >= v.ts""")
def j_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    versions = e.where("event_type = 'error'").select("ts", F.col("event_id").alias("version"))
    return J.as_of(e.select("event_id", "ts"), versions, "ts", "version").select("event_id", "current_version")


@query("j10_as_of_by_user_null_times", """with x as (select event_id, case when event_id % 7 = 0 then null else ts end as ts, case when user_id % 5 = 0 then null else user_id end as u, event_type from events),
    v as (select u, ts, max(event_id) as version from x where event_type in ('error', 'purchase') and ts is not null group by 1, 2)
  select event_id, (select max_by(version, v.ts) from v where v.ts <= x.ts and v.u is not distinct from x.u) as current_version from x""")
def j_asof_by(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"),
                                              F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("u"), "event_type")
    versions = e.where("event_type in ('error', 'purchase')").select("u", "ts", F.col("event_id").alias("version"))
    return J.as_of(e.select("event_id", "u", "ts"), versions, "ts", "version", by=["u"]).select("event_id", "current_version")


@query("j09_baseline_null_key", f"""with {R}, x as (select *, case when uid % 4 = 0 then null else uid end as u from r), g as (select u, avg(score) as b from x where rollout_n = 1 group by u)
  select x.uid, rollout_n, round(coalesce(b, 0), 6) as baseline from x left join g on x.u is not distinct from g.u""")
def j_baseline_null(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("u", F.when(F.col("uid") % 4 != 0, F.col("uid")))
    return rounded(J.with_baseline(df, df.where("rollout_n = 1"), "u").select("uid", "rollout_n", "baseline"))


@query("b26_deep_equal_null_keys", f"""with {R} select 0::bigint as only_left, count(distinct uid) filter (where uid % 3 = 0) as only_right, count(*) filter (where rollout_n = 0 and uid % 3 <> 0 and pred = 3) as different from r""")
def deep_equal_null(spark, sf_dir):
    """One row of every uid has a null in its key; on the left the rows of some uids lack it."""
    df = rollouts(spark, sf_dir).select("uid", F.when(F.col("rollout_n") != 0, F.col("rollout_n")).alias("n"), "pred")
    left = df.where("uid % 3 <> 0 or n is not null").withColumn("pred", F.when((F.col("pred") == 3) & F.col("n").isNull(), None).otherwise(F.col("pred")))
    return B.deep_equal(left, df, ["uid", "n"])


# ---------------------------------------------------------------- sampling

query("t01_max_samples", "select doc_id, source from documents order by md5('9|' || doc_id) limit 300")(
    lambda s, d: S.max_samples(table(s, d, "documents").select("doc_id", "source"), 300, "doc_id", True, 9))
query("t02_shuffle_rows", "select doc_id, row_number() over (order by md5('4|' || doc_id))-1 as position from documents")(
    lambda s, d: S.shuffle_rows(table(s, d, "documents").select("doc_id"), "doc_id", 4))


@query("t03_curriculum_order", "select doc_id, row_number() over (order by coalesce(quality + 2*toxic, 0.5) desc, doc_id)-1 as position from documents left join labels using (doc_id)")
def curriculum(spark, sf_dir):
    feedback = table(spark, sf_dir, "labels").withColumn("p", F.col("quality") + 2 * F.col("toxic"))
    return S.curriculum_order(table(spark, sf_dir, "documents").select("doc_id"), feedback, "doc_id", "p", 0.5).select("doc_id", "position")


@query("t04_append_generated", "select doc_id, n_chars from documents union all select doc_id + 1000000, n_chars from documents where n_chars <= 500")
def append(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return S.append_generated(d, d.withColumn("doc_id", F.col("doc_id") + 1000000), F.col("n_chars"), 500)


RATIOS = {"5-LOW": 0.5, "1-URGENT": 0.3, "2-HIGH": 0.2}


@query("t05_mix_sources", f"""with {R}, k as (select row_idx, data_source, row_number() over (partition by data_source order by md5('2|' || row_idx), row_idx) i from r)
  select row_idx, data_source from k where i <= case data_source when '5-LOW' then 500 when '1-URGENT' then 300 when '2-HIGH' then 200 else 0 end""")
def mix(spark, sf_dir):
    return S.mix_sources(rows(spark, sf_dir).select("row_idx", "data_source"), "data_source", "row_idx", S.source_quotas(RATIOS, 1000, 1000), 2)


@query("t06_interleave_cycle", """with l as (select lang, count(*) n from documents group by 1),
  k as (select doc_id, lang, row_number() over (partition by lang order by md5('6|' || doc_id), doc_id)-1 i from documents where lang in ('en','de')),
  d as (select lang, n, q, j from (values ('en', 700), ('de', 300)) x(lang, q) join l using (lang), unnest(range(0, q)) as u(j))
  select k.doc_id, k.lang, d.j as draw from d join k on k.lang = d.lang and k.i = (d.q::bigint*3 + d.j) % d.n""")
def interleave(spark, sf_dir):
    return S.interleave_cycle(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 700, "de": 300}, 3, 6)


query("t07_shuffle_shards", "select shard, row_number() over (order by md5('1|' || shard), shard)-1 as position from (select distinct source as shard from documents)")(
    lambda s, d: S.shuffle_shards(table(s, d, "documents").select(F.col("source").alias("shard")).distinct(), "shard", 1))
query("t08_train_test_split", "select doc_id, case when ('0x' || substr(md5('8|' || doc_id),1,13))::bigint::double/pow(2,52) < 0.25 then 'test' else 'train' end as split from documents")(
    lambda s, d: S.train_test_split(table(s, d, "documents").select("doc_id"), "doc_id", 0.25, 8))
query("t08_head_tail_split", f"with {R} select row_idx, case when row_idx < floor((select count(*) from r)*0.75) then 'train' else 'test' end as split from r")(
    lambda s, d: S.head_tail_split(rows(s, d).select("row_idx"), "row_idx", 0.75))


@query("t09_holdout_group_split", """with g as (select source from (select distinct source from documents) order by md5('3|' || source) limit 1),
  k as (select doc_id, source, row_number() over (partition by source order by md5('3|' || doc_id), doc_id) i from documents)
  select * from (select doc_id, source, case when source in (select source from g) then case when i <= 20 then 'ood' end when i <= 40 then 'train' when i <= 50 then 'test' end as split from k) where split is not null""")
def holdout(spark, sf_dir):
    return S.holdout_group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", seed=3)


query("t10_top_k_tokens", f"with {T} select uid, rollout_n, t, round(entropy,6) as entropy from t order by entropy desc, uid, rollout_n, t limit 1000")(
    lambda s, d: rounded(S.top_k_rows(tokens(s, d, "entropy").select("uid", "rollout_n", F.posexplode("entropy").alias("p", "entropy")).select(
        "uid", "rollout_n", (F.col("p") + 1).cast("long").alias("t"), "entropy"), "entropy", 1000, ["uid", "rollout_n", "t"])))
query("t11_log_sample", "select item_id, text from benchmark order by md5('5|' || item_id) limit 10")(
    lambda s, d: S.log_sample(table(s, d, "benchmark"), 10, "item_id", 5))
query("t12_first_per_source", "select source, doc_id, cast(row_number() over (partition by source order by doc_id) as integer) as place from documents qualify place <= 3")(
    lambda s, d: S.first_per_source(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 3))
query("t13_best_second_per_group", f"with {R} select uid, rollout_n, score, cast(row_number() over (partition by uid order by score desc, rollout_n) as integer) as place from r qualify place <= 2")(
    lambda s, d: S.best_second_per_group(rollouts(s, d).select("uid", "rollout_n", "score"), "uid", "score", "rollout_n"))

# ---------------------------------------------------------------- set operators

query("u01_union_datasets", "select doc_id as id, text from documents union all select item_id, text from benchmark")(
    lambda s, d: U.union_datasets([table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")]))
query("u02_union_missing", "select doc_id, lang, null as quality from documents union all select doc_id, null, quality from labels")(
    lambda s, d: U.union_missing([table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id", "quality")]))


@query("u03_merge_validation", f"""with {R}, m as (select data_source, uid, score as acc, null::double as fmt from r where l_linenumber <= 3 union all select data_source, uid, null, pred::double from r where l_linenumber > 3)
  select data_source, round(avg(acc),6) as acc, round(avg(fmt),6) as fmt, count(*) as n from m group by 1""")
def merge_validation(spark, sf_dir):
    df = rollouts(spark, sf_dir)
    a = df.where("l_linenumber <= 3").select("data_source", "uid", F.col("score").alias("acc"))
    b = df.where("l_linenumber > 3").select("data_source", "uid", F.col("pred").cast("double").alias("fmt"))
    return rounded(U.merge_validation(a, b).groupBy("data_source").agg(F.avg("acc").alias("acc"), F.avg("fmt").alias("fmt"), F.count(F.lit(1)).alias("n")))


query("u04_key_difference", "select distinct l_partkey from lineitem where l_partkey not in (select l_partkey from lineitem where l_discount > 0.09)")(
    lambda s, d: U.key_difference(table(s, d, "lineitem"), table(s, d, "lineitem").where("l_discount > 0.09"), "l_partkey"))
query("u04_key_intersection", "select distinct doc_id from documents where doc_id in (select doc_id from labels)")(
    lambda s, d: U.key_intersection(table(s, d, "documents"), table(s, d, "labels"), "doc_id"))
query("u05_distinct_keys", f"with {R} select distinct data_source, uid from r")(lambda s, d: U.distinct_keys(rollouts(s, d), "data_source", "uid"))




_MIXED = """select o_orderkey, case when o_custkey % 7 = 0 then null when o_custkey % 11 = 0 then 'nan'::double else o_totalprice end as price, o_orderstatus as status,
  case when o_custkey % 5 = 0 then null else o_orderdate end as day, case when o_custkey % 6 = 0 then null else o_orderpriority end as grp from orders"""


@query("rank_mixed_types_null_groups", f"""with m as ({_MIXED}) select o_orderkey, grp, cast(row_number() over (partition by grp order by status desc, price desc nulls last, day desc nulls last, o_orderkey) - 1 as bigint) as place from m""")
def rank_mixed(spark, sf_dir):
    """Ranks in groups (one of them null) by descending text, number with NaN and date, cut into many ranges."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_custkey")
    mixed = orders.select(
        "o_orderkey", F.when(key % 6 != 0, F.col("o_orderpriority")).alias("grp"), F.col("o_orderstatus").alias("status"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(key % 5 != 0, F.col("o_orderdate")).alias("day"),
    )
    ranked = rank_within(mixed, ["grp"], ["status desc", "price desc", "day desc", "o_orderkey"], "place", rows_per_range=500)
    return ranked.select("o_orderkey", "grp", "place")


@query("group_stats_null_key", """with m as (select o_orderkey, case when o_custkey % 6 = 0 then null else o_orderpriority end as grp, o_totalprice as v from orders)
  select o_orderkey, grp, round(avg(v) over (partition by grp), 2) as mean, count(*) over (partition by grp) as n from m""")
def stats_null_key(spark, sf_dir):
    """Rows with a null key are a group and stay."""
    orders = table(spark, sf_dir, "orders")
    keyed = orders.select("o_orderkey", F.when(F.col("o_custkey") % 6 != 0, F.col("o_orderpriority")).alias("grp"), F.col("o_totalprice").alias("v"))
    stats = with_group_stats(keyed, ["grp"], F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return stats.select("o_orderkey", "grp", r6(F.col("mean"), 2).alias("mean"), "n")
