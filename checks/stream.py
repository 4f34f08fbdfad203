"""Sources, sinks, extension points and streams against SQL; streams run over the events table."""

import io
import json
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from checks.base import ORACLES, R, query, r6, rollouts, rounded, table, tokens
from checks.correction import COLS
from checks.reduce import M_SQL, metric_rows
from rewardloom.functions import text as X
from rewardloom.operators.reduce import aggregate_steps
from rewardloom.plans import registry as G
from rewardloom.sources import files as S
from rewardloom.sources import tar as TAR
from rewardloom.streaming import flows as L
from rewardloom.streaming import state as Z

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, sf_dir):
    Z.with_rocksdb(spark)
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")


# ---------------------------------------------------------------- sources and sinks

query("s01_scan_parquet", "select l_orderkey, l_quantity from lineitem where l_quantity > 40")(
    lambda s, d: S.scan_parquet(s, [f"{d}/lineitem.parquet"], ["l_orderkey", "l_quantity"]).where("l_quantity > 40"))


@query("s02_scan_json", "select item_id, text from benchmark")
def scan_json(spark, sf_dir):
    path = f"{L.work_folder(spark)}/benchmark"
    table(spark, sf_dir, "benchmark").write.json(path)
    return S.scan_json(spark, path, "item_id long, text string")


@query("s03_detect_format", "select 'parquet' as format, count(*) as rows from documents")
def detect(spark, sf_dir):
    df = S.scan(spark, f"{sf_dir}/documents.parquet")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(S.detect_format(f"{sf_dir}/documents.parquet")).alias("format"), "rows")


SHARD_BYTES = 64 << 20


def write_shards(spark, sf_dir):
    """Documents as TAR shards of one source and about SHARD_BYTES at most: a JSON member and a binary member per sample."""
    folder = L.work_folder(spark)
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/made")  # Spark makes the folder, wherever it is

    def write(batches):
        name = out = file = None
        for batch in batches:
            for doc, source, lang, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != (source, part):
                    if out is not None:
                        out.close()
                        file.close()
                    name = (source, part)
                    file = TAR.open_shared(f"{folder}/{source}{f'-{part}' if part else ''}.tar", write=True)
                    out = tarfile.open(fileobj=file, mode="w|")
                meta = json.dumps({"doc_id": int(doc), "lang": lang}).encode()
                for ext, payload in (("json", meta), ("txt", text.encode())):
                    info = tarfile.TarInfo(f"doc{doc}.{ext}")
                    info.size = len(payload)
                    out.addfile(info, io.BytesIO(payload))
            yield pa.record_batch([pa.array([batch.num_rows])], names=["rows"])
        if out is not None:
            out.close()
            file.close()

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # A source is dealt over as many shards as the bytes of the largest one ask for, by the key of the sample.
    most = docs.groupBy("source").agg(F.sum(F.octet_length("text") + 2048).alias("bytes")).agg(F.max("bytes")).first()[0]
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-(most or 0) // SHARD_BYTES)))))
    dealt = dealt.repartition("source", "part").sortWithinPartitions("source", "part")
    dealt.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return folder


@query("s04_scan_tar_samples", "select 'doc' || doc_id as key, ext, octet_length(case ext when 'txt' then encode(text) else encode('{\"doc_id\": ' || doc_id || ', \"lang\": \"' || lang || '\"}') end) as bytes from documents, (values ('json'), ('txt')) e(ext)")
def tar_members(spark, sf_dir):
    df = TAR.scan_tar_members(spark, [write_shards(spark, sf_dir)], split_bytes=200_000)
    return df.select("key", "ext", F.octet_length("payload").cast("long").alias("bytes"))


@query("s05_members_to_samples", "select 'doc' || doc_id as key, doc_id, lang, 1 as files from documents")
def tar_samples(spark, sf_dir):
    df = TAR.scan_tar_samples(spark, [write_shards(spark, sf_dir)])
    j = F.from_json("json", "doc_id long, lang string")
    return df.select("key", j["doc_id"].alias("doc_id"), j["lang"].alias("lang"), F.size("files").alias("files"))


@query("s05_samples_of_cut_shards", "select 'doc' || doc_id as key, doc_id, octet_length(encode(text)) as bytes from documents")
def cut_samples(spark, sf_dir):
    """Shards cut at sample borders give the samples of whole ones."""
    df = TAR.scan_tar_samples(spark, write_shards(spark, sf_dir), split_bytes=50_000)
    return df.select("key", F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"), F.octet_length(F.col("files")[0]["payload"]).cast("long").alias("bytes"))


@query("s01_scan_arrow", "select vec_id, label, cast(len(embedding) as integer) as width, round(list_sum([x::double for x in embedding]), 4) + 0.0 as total from embeddings")
def arrow_files(spark, sf_dir):
    """Vectors written as Arrow files and streams by tasks, read back with a declared schema."""
    folder = L.work_folder(spark)
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/made")

    def write(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            name = uuid.uuid4().hex
            make = pa.ipc.new_file if name < "8" else pa.ipc.new_stream
            with TAR.open_shared(f"{folder}/{name}.arrow", write=True) as file, make(file, batch.schema) as out:
                for lo in range(0, batch.num_rows, 100):
                    out.write_batch(batch.slice(lo, 100))
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").repartition(4, "vec_id").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    df = S.scan_arrow(spark, f"{folder}/*.arrow", "label int, vec_id long, embedding array<float>")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", "label", F.size("embedding").alias("width"), r6(total, 4).alias("total"))


def _dump(spark, sf_dir):
    df = rollouts(spark, sf_dir).select(F.concat(F.lit("q"), "uid").alias("input"), F.concat(F.lit("a"), "pred").alias("output"),
                                        F.lit("t").alias("gts"), "score", F.col("param_version").alias("step"), "rollout_n")
    path = f"{L.work_folder(spark)}/dump"
    S.write_generations(df, path, ["rollout_n"])
    return path


@query("s06_scan_rollout_dump", f"with {R} select 'q' || uid as input, 'a' || pred as output, score, param_version as step from r where param_version % 12 = 5")
def rollout_dump(spark, sf_dir):
    return S.scan_rollout_dump(spark, _dump(spark, sf_dir)).where("step % 12 = 5").select("input", "output", "score", "step")


@query("s07_write_generations", f"with {R} select param_version as step, count(*) as rows, sum(score) as total, cast(sum(rollout_n) as bigint) as extra from r group by 1")
def generations(spark, sf_dir):
    df = S.scan_rollout_dump(spark, _dump(spark, sf_dir), S.GENERATION_SCHEMA + ", rollout_n long")
    return df.groupBy("step").agg(F.count(F.lit(1)).alias("rows"), F.sum("score").alias("total"), F.sum("rollout_n").alias("extra"))


@query("s08_write_prompts", "select o_orderkey, o_orderpriority from orders")
def write_prompts(spark, sf_dir):
    path = S.write_prompts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), L.work_folder(spark), "train")
    return spark.read.parquet(path)


@query("s09_metric_sink", f"with {R}, {M_SQL} select step, count(*) as keys, round(max(case when k.key='critic/score/mean' then k.value end),6)+0.0 as score_mean from metrics group by 1")
def metric_sink(spark, sf_dir):
    path = f"{L.work_folder(spark)}/metrics"
    S.write_metrics(metric_rows(spark, sf_dir), path)
    back = spark.read.schema("step long, data map<string,double>").json(path)
    return back.select("step", F.size("data").cast("long").alias("keys"), r6(F.col("data")["critic/score/mean"]).alias("score_mean"))


@query("s10_flatten_params", "select doc_id, source as \"info/source\", n_chars as \"info/size/chars\" from documents")
def flatten(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", F.struct(F.col("n_chars").alias("chars")).alias("size")).alias("info"))
    return S.flatten_struct(d, "info").withColumnsRenamed({"source": "info/source", "size/chars": "info/size/chars"})


@query("s11_rollout_cache", f"with {R} select uid, rollout_n, score from r")
def cache(spark, sf_dir):
    df = rollouts(spark, sf_dir).select("uid", "rollout_n", "score")
    folder = L.work_folder(spark)
    S.rollout_cache(df, folder, "exp/batch0")
    return S.rollout_cache(df.where("score < 0"), folder, "exp/batch0")


@query("s12_parse_metric_log", f"with {R} select param_version as step, 'critic/rewards/mean' as key, round(avg(score),4) as value from r group by 1 union all select param_version, 'n', count(*)::double from r group by 1")
def metric_log(spark, sf_dir):
    g = rollouts(spark, sf_dir).groupBy("param_version").agg(F.round(F.avg("score"), 4).alias("m"), F.count(F.lit(1)).alias("n"))
    lines = g.select(F.concat(F.lit("step:"), "param_version", F.lit(" - critic/rewards/mean:"), F.col("m").cast("string"), F.lit(" - n:"), "n").alias("value"))
    return S.parse_metric_log(lines)


@query("s12_best_metric", f"with {R} select max(v) as best, max(v) >= 4.0 as reached from (select round(avg(score),4) v from r group by param_version)")
def best_metric(spark, sf_dir):
    return S.best_metric(metric_log(spark, sf_dir), "critic/rewards/mean", 4.0)


# ---------------------------------------------------------------- extension points


@query("f01_custom_reward", f"with {R} select uid, rollout_n, case when pred = l_linenumber then 1.0::double else 0.5 end as score from r")
def custom_reward(spark, sf_dir):
    fn = G.load_function("rewardloom.operators.score", "score_hash_answer", format_score=0.5)
    df = rollouts(spark, sf_dir).withColumn("text", F.concat(F.lit("#### "), "pred"))
    return df.select("uid", "rollout_n", fn(F.col("text"), F.col("l_linenumber").cast("string")).alias("score"))


@query("f02_scoring_jobs", f"""with {R} select uid, rollout_n, case when data_source in ('1-URGENT','2-HIGH','4-NOT SPECIFIED') then (pred = l_linenumber)::int::double else 0.0 end as score from r""")
def jobs(spark, sf_dir):
    """Responses spell a hash answer; sources routed to the boxed rule get nothing for it."""
    df = rollouts(spark, sf_dir).drop("score")
    df = df.withColumn("response", F.concat(F.lit("#### "), "pred")).withColumn("ground_truth", F.col("l_linenumber").cast("string"))
    routes = {"1-URGENT": "hash_answer", "2-HIGH": "hash_answer", "3-MEDIUM": "boxed", "4-NOT SPECIFIED": "hash_answer", "5-LOW": "boxed"}
    return G.job("routed")(df, routes).select("uid", "rollout_n", "score")


@query("f03_advantage_registry", f"""with {R}, s as (select uid, sum(score) t, count(*) n from r group by 1) select uid, rollout_n, round(case when n>1 then (n*score-t)/(n-1) else 0 end,6)+0.0 as advantage from r join s using (uid)""")
def advantage_registry(spark, sf_dir):
    df = G.estimator("rloo_vectorized")(tokens(spark, sf_dir, "rewards", "mask"))
    return rounded(df.select("uid", "rollout_n", "advantage"))


NAMED = {"gpg": "l04_loss_gpg", "reinforce": "l09_loss_reinforce", "vanilla": "l01_loss_vanilla"}


@query("f04_objective_registry", " union all ".join(f"select '{name}' as name, pg_loss from ({ORACLES[checked]})" for name, checked in NAMED.items()))
def objective_registry(spark, sf_dir):
    """Losses over all tokens, each by the name of its objective."""
    df = tokens(spark, sf_dir, *COLS, "rollout_logp")
    losses = [G.objective(name)(df).select(F.lit(name).alias("name"), "pg_loss") for name in NAMED]
    return rounded(losses[0].union(losses[1]).union(losses[2]))


@query("f05_custom_dataset", "select doc_id, n_chars from documents where lang = 'en'")
def custom_dataset(spark, sf_dir):
    G.DATASETS.setdefault("documents_of", lambda spark, folder, lang: S.scan_parquet(spark, f"{folder}/documents.parquet").where(F.col("lang") == lang))
    return G.dataset(spark, "documents_of", folder=sf_dir, lang="en").select("doc_id", "n_chars")


@query("f06_group_function", f"with {R} select uid, max(score) - min(score) as spread from r group by 1")
def group_function(spark, sf_dir):
    return G.group_reduce(rollouts(spark, sf_dir), ["uid"], lambda v: v.max() - v.min(), "score", "spread")


@query("f06_group_fold", f"""with {R}, x as (select case when data_source like '1%' then null else view_type end as g, case when pred = 5 then null else score end as v from r)
  select g, max(v) - min(v) as spread, round(kurtosis_pop(v), 6) as kurtosis from x group by g""")
def group_fold(spark, sf_dir):
    """Range and fourth moment of a few large groups, from states that merge."""
    df = rollouts(spark, sf_dir).select(F.when(~F.col("data_source").startswith("1"), F.col("view_type")).alias("g"), F.when(F.col("pred") != 5, F.col("score")).alias("v"))
    spread = G.Fold(lambda x: (x.min(), x.max()), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0])
    sums = G.Fold(lambda x: [float((x ** p).sum()) for p in range(5)], lambda a, b: [x + y for x, y in zip(a, b, strict=True)], _kurtosis)
    both = G.group_fold(df, ["g"], spread, "v", "spread").withColumnRenamed("g", "h")
    other = G.group_fold(df, ["g"], sums, "v", "kurtosis")
    return rounded(other.join(both, F.col("g").eqNullSafe(F.col("h"))).select("g", "spread", "kurtosis"))


def _kurtosis(sums):
    n, *powers = sums
    m = [p / n for p in powers]
    variance = m[1] - m[0] ** 2
    return (m[3] - 4 * m[0] * m[2] + 6 * m[0] ** 2 * m[1] - 3 * m[0] ** 4) / variance ** 2 - 3


@query("f07_table_function", f"with {R} select uid, rollout_n, cast(k as integer) as position, case k when 0 then 'find' else 'sum' end as name from r, range(2) x(k)")
def table_function(spark, sf_dir):
    from checks.prep import CALLS

    df = rollouts(spark, sf_dir).withColumn("text", F.expr(CALLS))
    return G.explode_with(df, X.tool_calls(F.col("text")), ["uid", "rollout_n"]).select("uid", "rollout_n", "position", F.col("item.name").alias("name"))


# ---------------------------------------------------------------- streams


@query("z01_bounded_queue", """with x as (select user_id % 5 as q, event_id, row_number() over (partition by user_id % 5 order by event_id) i, count(*) over (partition by user_id % 5) n from events)
  select cast(q as varchar) as queue, event_id as item from x where i <= n - 50""")
def queue(spark, sf_dir):
    stream = events(spark, sf_dir).select((F.col("user_id") % 5).alias("q"), "event_id")
    out = L.run_available(Z.bounded_queue(stream, "q", "event_id", 50))
    return out.where("outcome = 'dropped'").select("queue", "item")


@query("z01_queue_counters", "select cast(user_id % 5 as varchar) as queue, count(*) as produced, greatest(count(*) - 50, 0) as dropped, least(count(*), 50) as size from events group by 1")
def queue_counters(spark, sf_dir):
    stream = events(spark, sf_dir).select((F.col("user_id") % 5).alias("q"), "event_id")
    out = L.run_available(Z.bounded_queue(stream, "q", "event_id", 50)).where("outcome = 'state'")
    return out.groupBy("queue").agg(F.max("produced").alias("produced"), F.max("dropped").alias("dropped"), F.max_by("size", "produced").alias("size"))


@query("z02_take_required", """with x as (select event_type, event_id, row_number() over (partition by event_type order by event_id)-1 i, count(*) over (partition by event_type) n from events)
  select event_type as queue, i // 64 as step, event_id as item from x where i < n // 64 * 64""")
def take(spark, sf_dir):
    return L.run_available(Z.take_required(events(spark, sf_dir), "event_type", "event_id", 64))


VERSIONED = "v as (select *, event_id // 100 as param_version from events)"


@query("z03_staleness", f"with {VERSIONED}, c as (select event_type, max(param_version) cur from v group by 1) select v.event_type, count(*) as samples, count(*) filter (where cur - param_version >= 1) as stale_samples, cast(coalesce(sum(case when cur - param_version >= 1 then user_id % 4 end),0) as bigint) as stale_trajectories, max(cur - param_version) as max_lag from v join c using (event_type) group by 1")
def stale(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("param_version", F.floor(F.col("event_id") / 100))
    current = e.groupBy("event_type").agg(F.max("param_version").alias("current"))
    return L.staleness(e.join(current, "event_type"), F.col("current"), by=("event_type",), trajectories=F.col("user_id") % 4)


@query("z04_staleness_budget", f"with {VERSIONED}, s as (select user_id % 5 as q, count(*) as queued, count(*) filter (where param_version < 50) as stale from v group by 1) select q, queued, stale, queued >= 3000 or stale >= 750 as pause, 750 as budget from s")
def budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("param_version", F.floor(F.col("event_id") / 100))
    s = e.groupBy((F.col("user_id") % 5).alias("q")).agg(F.count(F.lit(1)).alias("queued"), F.sum((F.col("param_version") < 50).cast("long")).alias("stale"))
    return L.staleness_budget(s, "queued", "stale", 3000, 250, 0.5, 2)


GROUPS = "g as (select event_id // 4 as uid, count(*) n, max(value) hi, min(value) lo, sum(value) total from events where event_type <> 'error' group by 1)"


def group_stream(spark, sf_dir):
    stream = events(spark, sf_dir).where("event_type <> 'error'").withColumn("uid", F.floor(F.col("event_id") / 4))
    return Z.complete_groups(stream, "uid", "event_id", "value", "ts", 4, "1 hour", 3600)


@query("z05_complete_groups", f"with {GROUPS} select uid, n, round(total,6)+0.0 as total from g where n = 4")
def complete(spark, sf_dir):
    out = L.run_available(group_stream(spark, sf_dir)).where("complete")
    return out.select("uid", "n", r6(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("z06_stream_dynamic_sampling", f"with {GROUPS} select uid, n from g where n = 4 and hi > lo order by uid limit 200")
def dynamic(spark, sf_dir):
    return L.stream_dynamic_sampling(group_stream(spark, sf_dir), 200).select("uid", "n")


@query("z07_partial_rollout_stats", f"with {VERSIONED}, x as (select event_type, param_version e, param_version - user_id % 3 s from v) select event_type, count(*) filter (where e<>s) as partial, round(avg((e<>s)::int),6) as partial_ratio, max(abs(e-s)) as max_span, count(distinct e) as versions from x group by 1")
def partial(spark, sf_dir):
    from rewardloom.operators.reduce import partial_rollout_stats

    e = table(spark, sf_dir, "events").withColumn("param_version", F.floor(F.col("event_id") / 100)).withColumn("start", F.expr("param_version - user_id % 3"))
    return rounded(partial_rollout_stats(e, "start", "param_version", "param_version", ["event_type"]))


@query("z08_assemble_batch", f"with {R} select 0 as batch_id, count(*) as rows, 8::bigint as parts, cast(sum(response_len) as bigint) as tokens from r")
def assemble(spark, sf_dir):
    folder = L.work_folder(spark)
    rollouts(spark, sf_dir, indexed=True).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")

    def each(batch, batch_id):
        out, _, _ = L.assemble_batch(batch, batch_id, "row_idx", "response_len", 8, 24000)
        out.write.mode("overwrite").parquet(f"{folder}/assembled/id={batch_id}")

    L.run_batches(stream, each, folder)
    done = spark.read.parquet(f"{folder}/assembled")
    return done.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("part").alias("parts"), F.sum("response_len").alias("tokens"))


@query("z09_step_metrics_stream", f"""with {R}, {M_SQL}, x as (select step // 6 as sync, k.key as key, k.value as v, step from metrics),
  y as (select sync, key, case when key='training/global_step' then 'last' when key='perf/time_per_step' or key like 'timing_s/%' then 'time_sum' when key like '%mean%' then 'avg'
    when key like '%max%' then 'max' when key like '%min%' then 'min' when key like '%total%' then 'sum' else 'avg' end as rule, sum(v) s, avg(v) a, max(v) hi, min(v) lo, arg_max(v, step) l from x group by 1,2)
  select sync, key, rule, round(case rule when 'last' then l when 'time_sum' then s when 'sum' then s when 'max' then hi when 'min' then lo else a end,6)+0.0 as value from y""")
def step_metrics(spark, sf_dir):
    folder = L.work_folder(spark)
    rows = metric_rows(spark, sf_dir)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    out = L.step_metrics_stream(stream, 6)
    query_ = out.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
    query_.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    last = done.agg(F.max("batch").alias("b"))
    return rounded(done.join(F.broadcast(last), done.batch == last.b).select("sync", "key", "rule", "value"))


@query("z09_aggregate_steps_by_window", f"with {R}, {M_SQL} select step // 6 as sync, count(distinct k.key) + 1 as keys from metrics group by 1")
def windows(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).withColumn("sync", F.floor(F.col("step") / 6))
    return aggregate_steps(rows, ["sync"], 8.0).groupBy("sync").agg(F.count(F.lit(1)).alias("keys"))


@query("z10_rate_audit", "select cast(user_id % 5 as varchar) as client, count(*) as requests, true as sane from events group by 1")
def rate(spark, sf_dir):
    stream = events(spark, sf_dir).withColumn("client", F.col("user_id") % 5).withColumn("tokens", F.col("event_id") % 50)
    out = L.run_available(Z.rate_audit(stream, "client", "event_id", "ts", "tokens", rpm=30, tpm=2000, burst=60))
    return out.groupBy("client").agg(F.count(F.lit(1)).alias("requests"), F.every((F.col("wait_s") >= 0) & (F.col("allowed") == (F.col("wait_s") <= 1e-9))).alias("sane"))


@query("z11_field_readiness", """with x as (select event_id // 6 as row, list_distinct(list(event_type)) f from events group by 1), a as (select row, 'train' as task from x where list_contains(f,'view') and list_contains(f,'click')),
  b as (select row, 'score' as task from x where list_contains(f,'purchase')) select * from a union all select * from b""")
def readiness(spark, sf_dir):
    stream = events(spark, sf_dir).withColumn("row", F.floor(F.col("event_id") / 6))
    return L.run_available(Z.field_readiness(stream, "row", "event_type", {"train": ["view", "click"], "score": ["purchase"]}))


@query("z12_validation_stream", "select event_id, value from events where user_id % 7 = 0")
def validation(spark, sf_dir):
    _, held = L.validation_stream(events(spark, sf_dir).withColumn("validate", F.col("user_id") % 7 == 0))
    return L.run_available(held.select("event_id", "value"))


