"""Sequence, balancing and packing operators against SQL."""

from pyspark.sql import functions as F

from checks.base import R, T, query, rollouts, rounded, table, tokens, with_tokens
from rewardloom.operators import balance as K
from rewardloom.operators import pack as P
from rewardloom.operators import sequence as Q
from rewardloom.plans.scale import gather_lists

ROW = ["uid", "rollout_n"]
IDS = "transform(sequence(1, response_len), t -> cast((l_partkey*7 + t*3) % 23 as int))"
TOK = "((l_partkey*7 + t*3) % 23)"


def ids(spark, sf_dir, *columns):
    return tokens(spark, sf_dir, *columns).withColumn("ids", F.expr(IDS))


def total(c):
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def weighted(c):
    return total(F.transform(c, lambda x, i: x.cast("long") * (i + 1)))


@query("q01_pad_to_length", f"with {T} select uid, rollout_n, 50 as size, cast(sum({TOK}*t) + 9*(50*51//2 - response_len*(response_len+1)//2) as bigint) as weighted, cast(sum({TOK}*(t + 50 - response_len)) + 9*((50-response_len)*(51-response_len)//2) as bigint) as left_weighted from t group by uid, rollout_n, response_len")
def pad(spark, sf_dir):
    df = ids(spark, sf_dir)
    right, left = Q.pad_to_length("ids", 50, F.lit(9)), Q.pad_to_length("ids", 50, F.lit(9), True)
    return df.select(*ROW, F.size(right).alias("size"), weighted(right).alias("weighted"), weighted(left).alias("left_weighted"))


@query("q02_truncate", f"""with {T}, x as (select uid, rollout_n, response_len n, t, {TOK} k from t)
  select uid, rollout_n, cast(sum(case when t<=10 then k else 0 end) as bigint) as head, cast(sum(case when t>n-10 then k else 0 end) as bigint) as tail,
   cast(sum(case when n<=10 or t<=5 or t>n-5 then k else 0 end) as bigint) as middle from x group by 1,2""")
def truncate(spark, sf_dir):
    return ids(spark, sf_dir).select(*ROW, total(Q.truncate("ids", 10)).alias("head"), total(Q.truncate("ids", 10, "left")).alias("tail"),
                                     total(Q.truncate("ids", 10, "middle")).alias("middle"))


@query("q03_strip_padding", f"with {T} select uid, rollout_n, cast(sum({TOK}*mask) as bigint) as kept, cast(sum(mask) as integer) as n from t group by 1,2")
def strip(spark, sf_dir):
    s = Q.strip_padding("ids", "mask")
    return ids(spark, sf_dir, "mask").select(*ROW, total(s).alias("kept"), F.size(s).alias("n"))


@query("q04_position_ids", f"with {T}, x as (select uid, rollout_n, greatest(sum(mask) over (partition by uid, rollout_n order by t)-1,0) p, t from t) select uid, rollout_n, cast(sum(p*t) as bigint) as weighted from x group by 1,2")
def positions(spark, sf_dir):
    return ids(spark, sf_dir, "mask").withColumn("p", Q.position_ids("mask")).select(*ROW, weighted(F.col("p")).alias("weighted"))


@query("q05_sft_loss_mask", f"with {R} select uid, rollout_n, cast(l_linenumber + response_len as integer) as size, cast(response_len as bigint) as ones, cast(response_len*(l_linenumber-1) + response_len*(response_len+1)//2 as bigint) as weighted from r")
def sft_mask(spark, sf_dir):
    m = Q.sft_loss_mask(F.col("l_linenumber"), F.col("response_len"))
    return rollouts(spark, sf_dir).select(*ROW, F.size(m).alias("size"), total(m).alias("ones"), weighted(m).alias("weighted"))


@query("q06_multiturn_loss_mask", """with c as (select conv_id, turn, role, length(text) % 40 + 3 as n from conversations)
  select conv_id, cast(sum(n) as integer) as size, cast(sum(case when role='assistant' then n-3 else 0 end) as bigint) as ones from c group by 1""")
def multiturn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("role", (F.length("text") % 40 + 3).alias("len"), F.lit(3).alias("header"))
    df = gather_lists(c, ["conv_id"], ["turn"], turn, "turns").withColumn("m", Q.multiturn_loss_mask(F.col("turns")))
    return df.select("conv_id", F.size("m").alias("size"), total("m").alias("ones"))


CHAT_IDS = "concat(array(900, if(role = 'assistant', 901, 902)), transform(sequence(1, length(text) % 40 + 1), i -> i), array(903))"


@query("q07_marker_loss_mask", """with c as (select conv_id, turn, role, length(text) % 40 + 1 as n from conversations)
  select conv_id, cast(sum(n+3) as integer) as size, cast(sum(case when role='assistant' then n+1 else 0 end) as bigint) as ones from c group by 1""")
def marker(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("ids", F.expr(CHAT_IDS))
    df = gather_lists(c, ["conv_id"], ["turn"], F.col("ids"), "l").withColumn("ids", F.flatten("l"))
    df = df.withColumn("m", Q.marker_loss_mask("ids", 900, 901, 903))
    return df.select("conv_id", F.size("m").alias("size"), total("m").alias("ones"))


@query("q08_safe_truncate", f"""with {T}, x as (select uid, rollout_n, any_value(response_len) n, max(case when {TOK}=22 then t else 0 end) li, sum(case when t<=30 then {TOK} else 0 end) h, sum({TOK}) a from t group by 1,2)
  select uid, rollout_n, cast(case when n<=30 then a when li<=30 then h end as bigint) as kept from x""")
def safe(spark, sf_dir):
    df = ids(spark, sf_dir).withColumn("cut", Q.safe_truncate("ids", 30, 22))
    return df.select(*ROW, F.when(F.col("cut").isNotNull(), total("cut")).alias("kept"))


@query("q09_collate_pad", f"with {R}, w as (select uid, max(response_len) as width from r group by 1) select uid, rollout_n, width, cast(width - response_len as bigint) as padded from r join w using (uid)")
def collate(spark, sf_dir):
    df = Q.collate_pad(ids(spark, sf_dir), "uid", {"ids": F.lit(-1)})
    return df.select(*ROW, F.size("ids").alias("width"), F.size(F.filter("ids", lambda x: x == -1)).cast("long").alias("padded"))


@query("q09_collate_pad_null_batch", f"with {R}, x as (select *, case when l_linenumber = 1 then null else data_source end as b from r), w as (select b, max(response_len) as width from x group by 1) select uid, rollout_n, width, cast(width - response_len as bigint) as padded from x join w on x.b is not distinct from w.b")
def collate_null(spark, sf_dir):
    df = ids(spark, sf_dir).withColumn("b", F.when(F.col("l_linenumber") != 1, F.col("data_source")))
    df = Q.collate_pad(df, "b", {"ids": F.lit(-1)})
    return df.select(*ROW, F.size("ids").alias("width"), F.size(F.filter("ids", lambda x: x == -1)).cast("long").alias("padded"))


@query("q10_pair_sequences", f"""with {T}, x as (select uid, rollout_n, response_len n, l_linenumber p, {TOK} k, t from t)
  select uid, rollout_n, cast(least(n + p + 1, 40) as bigint) as chosen_tokens, cast(least(2*p + 1, 40) as bigint) as rejected_tokens,
    cast(sum(case when t + p <= 40 then k else 0 end) + 5*p + case when n+p+1 <= 40 then 99 else 0 end as bigint) as chosen_sum from x group by uid, rollout_n, n, p""")
def pair(spark, sf_dir):
    df = ids(spark, sf_dir).withColumn("prompt", F.expr("array_repeat(5, l_linenumber)")).withColumn("short", F.expr("array_repeat(6, l_linenumber)"))
    df = df.withColumn("pair", Q.pair_sequences("prompt", "ids", "short", 40, 99, 0))
    return df.select(*ROW, total(F.col("pair")[0]["attention_mask"]).alias("chosen_tokens"), total(F.col("pair")[1]["attention_mask"]).alias("rejected_tokens"),
                     total(F.col("pair")[0]["input_ids"]).alias("chosen_sum"))


@query("q11_prefix_group_rows", f"""with {T}, m as (select uid, min_by(l_linenumber, rollout_n) as prefix_len from r group by 1), s as (select uid, count(*) n, sum(response_len) len, sum(response_len*(response_len-1)//2) tri from r group by 1),
  k as (select uid, sum({TOK}) tok from t group by 1)
  select uid, prefix_len, cast(n as integer) as suffixes, cast(prefix_len + len as integer) as size, cast(prefix_len*(prefix_len-1)//2 + prefix_len*len + tri as bigint) as positions, cast(tok + 7*prefix_len as bigint) as token_sum
  from m join s using (uid) join k using (uid)""")
def prefix(spark, sf_dir):
    df = ids(spark, sf_dir).withColumn("prompt", F.expr("array_repeat(7, l_linenumber)"))
    out = Q.prefix_group_rows(df, "uid", "rollout_n", "prompt", "ids")
    return out.select("uid", "prefix_len", F.size("suffix_lens").alias("suffixes"), F.size("input_ids").alias("size"), total("position_ids").alias("positions"),
                      total("input_ids").alias("token_sum"))


@query("q11_prefix_groups_null_uid", f"""with {R}, x as (select *, case when uid % 1000 < 3 then null else uid end as u from r where l_linenumber <= 3)
  select u as uid, cast(count(*) as integer) as suffixes, cast(sum(response_len) + 2 as integer) as size from x group by u""")
def prefix_null(spark, sf_dir):
    df = ids(spark, sf_dir).where("l_linenumber <= 3").withColumn("prompt", F.array(F.lit(7), F.lit(7))).withColumn("place", F.col("uid") * 10 + F.col("rollout_n"))
    df = df.withColumn("uid", F.when(F.col("uid") % 1000 >= 3, F.col("uid")))
    return Q.prefix_group_rows(df, "uid", "place", "prompt", "ids").select("uid", F.size("suffix_lens").alias("suffixes"), F.size("input_ids").alias("size"))


@query("q12_packed_eos_audit", f"""with {T}, x as (select *, {TOK} k, coalesce(max(mask) over (partition by uid, rollout_n order by t rows between 4 preceding and 1 preceding),0) near from t)
  select data_source, cast(count(*) filter (where k=5 and mask=1) as bigint) as supervised, cast(count(*) filter (where k=5 and mask=0 and near>0) as bigint) as missed, cast(count(*) filter (where k=5 and mask=0 and near=0) as bigint) as other from x group by 1""")
def eos_audit(spark, sf_dir):
    return Q.packed_eos_audit(ids(spark, sf_dir, "mask"), "ids", "mask", 5, 4, ["data_source"])


@query("q13_loss_segments_audit", f"""with {T}, x as (select *, lag(mask,1,0) over (partition by uid, rollout_n order by t) pm from t), y as (select data_source, uid, rollout_n, count(*) filter (where mask=1 and pm=0) seg, any_value(l_linenumber) tu, sum(mask) o, count(*) n from x group by 1,2,3)
  select data_source, count(*) as rows, cast(count(*) filter (where seg=tu) as bigint) as matching, cast(sum(seg) as bigint) as segments, cast(sum(tu) as bigint) as assistant_turns, round(sum(o)/sum(n),6) as supervised_ratio from y group by 1""")
def segments(spark, sf_dir):
    return rounded(Q.loss_segments_audit(tokens(spark, sf_dir, "mask"), "mask", "l_linenumber", ["data_source"]))


@query("q14_kl_token_mask", f"with {R} select uid, cast(sum(case when view_type='N' then 0 else response_len end) as bigint) as kl_tokens, cast(sum(response_len) as integer) as size from r group by 1")
def kl_mask(spark, sf_dir):
    item = F.struct((F.col("view_type") == "N").alias("has_view_type"), F.col("response_len").alias("len"))
    df = gather_lists(rollouts(spark, sf_dir), ["uid"], ["rollout_n"], item, "members").withColumn("m", Q.kl_token_mask())
    return df.select("uid", total("m").alias("kl_tokens"), F.size("m").alias("size"))


@query("q15_jagged_and_window", f"with {T} select uid, rollout_n, cast(sum({TOK}*mask) as bigint) as jagged, 60 as width, cast(sum({TOK}) as bigint) as windowed from t group by 1,2")
def jagged(spark, sf_dir):
    df = ids(spark, sf_dir, "mask").withColumn("full", F.expr("concat(array_repeat(3, l_linenumber), ids)"))
    df = df.withColumn("window", Q.response_window("full", F.col("response_len"), 60, F.lit(0)))
    out = Q.to_jagged(df, ["ids"], "mask")
    return out.select(*ROW, total("ids").alias("jagged"), F.size("window").alias("width"), total("window").alias("windowed"))


@query("q16_assemble_turns", """with c as (select conv_id, role, length(text) % 40 + 1 as n, sum(length(text) % 40 + 1) over (partition by conv_id order by turn) as hi from conversations)
  select conv_id, cast(least(sum(n), 64) as integer) as size, cast(sum(case when role='assistant' then greatest(least(hi,64) - (hi-n), 0) else 0 end) as bigint) as generated, cast(count(*) as integer) as num_turns from c group by 1""")
def assemble(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("ids", F.expr("sequence(1, cast(length(text) % 40 + 1 as int))"))
    out = Q.assemble_turns(c, "conv_id", "turn", "role", "ids", 64)
    return out.select("conv_id", F.size("input_ids").alias("size"), total("loss_mask").alias("generated"), "num_turns")


# ---------------------------------------------------------------- balancing: rows covered, sizes, groups kept whole



def batched(spark, sf_dir):
    df = rollouts(spark, sf_dir, indexed=True).withColumn("batch", F.floor(F.col("row_idx") / 512))
    df = df.withColumn("work", K.workload(F.col("response_len")))
    return df


ALL = f"with {R}, b as (select *, row_idx // 512 as batch, 24576::bigint*response_len + response_len::bigint*response_len as work from r)"


def _sizes(assigned, df):
    j = assigned.join(df.select("row_idx", "work"), "row_idx")
    p = j.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("work").alias("w"))
    return p.groupBy("batch").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("parts"), F.sum("w").alias("work"),
                                  ((F.max("w") - F.min("w")) <= F.lit(24576 * 50 + 2500)).alias("balanced"))


def _sized_sql(parts):
    return f"{ALL} select batch, count(*) as rows, {parts} as parts, cast(sum(work) as bigint) as work, true as balanced from b group by 1"


@query("k01_balance_partitions", _sized_sql("cast(least(count(*), 8) as bigint)"))
def balance(spark, sf_dir):
    df = batched(spark, sf_dir)
    return _sizes(K.balance_partitions(df, "batch", "row_idx", "work", 8, equal_size=False), df)


@query("k02_balance_greedy", f"{ALL} select batch, count(*) as rows, cast(sum(work) as bigint) as work, cast(least(count(*), 8) as bigint) as parts, true as balanced from b group by 1")
def greedy(spark, sf_dir):
    df = batched(spark, sf_dir)
    return _sizes(K.balance_greedy(df, "batch", "row_idx", "work", 8), df)


@query("k03_balance_snake", f"""{ALL}, k as (select row_idx, work, row_number() over (order by work desc, row_idx)-1 i from b)
  select row_idx, cast(case when (i//8) % 2 = 0 then i % 8 else 7 - i % 8 end as bigint) as part from k""")
def snake(spark, sf_dir):
    return K.snake(batched(spark, sf_dir), 8, "work", "row_idx").select("row_idx", "part")


@query("k04_balance_groups", f"""with {R}, g as (select uid, dense_rank() over (order by uid)-1 d, count(*) n from r group by uid)
  select d // 64 as batch, cast(least(count(*), 8) as bigint) as parts, count(*) as groups, cast(sum(n) as bigint) as rows, 1::bigint as parts_per_group from g group by 1""")
def groups(spark, sf_dir):
    from rewardloom.operators.reduce import factorize

    g = factorize(rollouts(spark, sf_dir), "uid", "d").withColumn("batch", F.floor(F.col("d") / 64))
    out = K.balance_groups(g, "batch", "uid", "response_len", 8, equal_size=False)
    per = out.groupBy("batch", "uid").agg(F.countDistinct("part").alias("p"), F.count(F.lit(1)).alias("r"), F.min("part").alias("part"))
    return per.groupBy("batch").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("groups"), F.sum("r").alias("rows"), F.max("p").alias("parts_per_group"))


@query("k05_balance_within_minibatch", f"{ALL} select batch // 4 as minibatch, count(*) as rows, cast(sum(work) as bigint) as work, true as balanced, cast(least(count(*),16) as bigint) as parts from b group by 1")
def minibatch(spark, sf_dir):
    df = batched(spark, sf_dir).withColumn("batch", F.floor(F.col("row_idx") / 2048))
    return _sizes(K.balance_partitions(df, "batch", "row_idx", "work", 16, equal_size=False), df).withColumnRenamed("batch", "minibatch")


@query("k06_order_inside_part", f"""{ALL}, k as (select batch, row_idx, row_number() over (partition by batch order by response_len, row_idx)-1 i, count(*) over (partition by batch) n from b)
  select batch, row_idx, cast(case when i % 2 = 0 then i // 2 else n - 1 - i // 2 end as bigint) as place from k""")
def inside(spark, sf_dir):
    return K.order_inside_part(batched(spark, sf_dir), ["batch"], "response_len", "row_idx").select("batch", "row_idx", "place")


@query("k07_micro_batches", f"""{ALL} select batch, count(*) as rows, cast(ceil(least(count(*), ceil(sum(response_len)/1024.0))/2.0)*2 as bigint) as parts, cast(sum(work) as bigint) as work, true as balanced from b group by 1""")
def micro(spark, sf_dir):
    df = batched(spark, sf_dir)
    return _sizes(K.micro_batches(df, "batch", "row_idx", "response_len", 1024, divisor=2), df)


# The assignment itself: largest differencing as lists of sets, joined step by step.


def differencing(items, equal):
    """SQL tables that turn ``items`` (batch, item, w, k) into ``parts`` (batch, item, part)."""
    unit = "r // k" if equal else "r"
    empty = "{'s': 0::double, 'n': 0, 'f': -1::bigint, 'items': []::bigint[]}"
    return f"""item as (select batch, item, w, k, row_number() over (partition by batch order by w, item) - 1 as r from ({items})),
  first as (select batch, k, {unit} as u, list({{'s': w::double, 'n': 1, 'f': item::bigint, 'items': [item::bigint]}} order by w desc, item desc) as p from item group by batch, k, {unit}),
  full_split as (select batch, k, list_concat(p, [{empty} for x in range(k - len(p))]) as p from first),
  keyed as (select batch, k, {{'a': p[k].s - p[1].s, 'b': -p[1].s, 'c': -p[1].n, 'd': -p[1].f, 'p': p}} as split from full_split),
  joining(batch, k, splits) as (
    select batch, k, list_sort(list(split)) from keyed group by batch, k
    union all
    select batch, k, list_sort(list_append(splits[3:], {{'a': p[k].s - p[1].s, 'b': -p[1].s, 'c': -p[1].n, 'd': -p[1].f, 'p': p}})) from (
      select batch, k, splits, list_reverse(list_sort([{{'s': splits[1].p[i].s + splits[2].p[k + 1 - i].s, 'n': splits[1].p[i].n + splits[2].p[k + 1 - i].n,
        'f': case when splits[1].p[i].n > 0 then splits[1].p[i].f else splits[2].p[k + 1 - i].f end,
        'items': list_concat(splits[1].p[i].items, splits[2].p[k + 1 - i].items)}} for i in range(1, k + 1)])) as p
      from joining where len(splits) > 1)),
  part_of as (select batch, k, i - 1 as part, splits[1].p[i] as p from joining, unnest(range(1, k + 1)) as u(i) where len(splits) = 1),
  parts as (select batch, k, part, p.s as w, unnest(p.items) as item from part_of)"""


SMALL = f"{ALL.replace('with ', 'with recursive ', 1)}"
PER_32 = "select row_idx // 32 as batch, row_idx as item, work as w, {k} as k from b"


def small_batches(spark, sf_dir, size=32):
    return batched(spark, sf_dir).withColumn("batch", F.floor(F.col("row_idx") / size))


@query("k01_partition_members", f"{SMALL}, {differencing(PER_32.format(k=4), False)} select batch, item as row_idx, cast(part as bigint) as part from parts")
def partition_members(spark, sf_dir):
    return K.balance_partitions(small_batches(spark, sf_dir), "batch", "row_idx", "work", 4, equal_size=False).select("batch", "row_idx", "part")


WHOLE_32 = "select * from (select row_idx // 32 as batch, row_idx as item, work as w, 4 as k, count(*) over (partition by row_idx // 32) as n from b) where n = 32"


@query("k01_equal_size_members", f"{SMALL}, {differencing(WHOLE_32, True)} select batch, item as row_idx, cast(part as bigint) as part from parts")
def equal_size_members(spark, sf_dir):
    df = small_batches(spark, sf_dir)
    df = df.join(df.groupBy("batch").count().where("count = 32").select("batch"), "batch")
    return K.balance_partitions(df, "batch", "row_idx", "work", 4, equal_size=True).select("batch", "row_idx", "part")


@query("k02_greedy_members", f"""{SMALL}, w as (select row_idx // 200 as batch, row_idx % 200 as i, row_idx, work from b),
  s(batch, i, loads, part) as (
    select distinct batch, -1::bigint, [0::double for x in range(8)], null::bigint from w
    union all select s.batch, w.i, [case when j = low then loads[j] + work else loads[j] end for j in range(1, 9)], (low - 1)::bigint
    from (select *, list_position(loads, list_min(loads)) as low from s) s join w on w.batch = s.batch and w.i = s.i + 1)
  select w.batch, row_idx, part from s join w using (batch, i)""")
def greedy_members(spark, sf_dir):
    return K.balance_greedy(small_batches(spark, sf_dir, 200), "batch", "row_idx", "work", 8).select("batch", "row_idx", "part")


GROUPS_24 = """select d // 24 as batch, d as item, w, 3 as k from (select d, sum(work) as w, count(*) over (partition by d // 24) as n
  from (select *, case when l_suppkey % 10 = 0 then null else dense_rank() over (order by uid) - 1 end as d from b) where d is not null group by d) where n = 24"""


@query("k04_group_members", f"{SMALL}, {differencing(GROUPS_24, True)} select batch, item as d, cast(part as bigint) as part from parts")
def group_members(spark, sf_dir):
    """Whole groups, as many in each part."""
    from rewardloom.operators.reduce import factorize

    g = factorize(rollouts(spark, sf_dir, indexed=True), "uid", "d").where("l_suppkey % 10 <> 0").withColumn("batch", F.floor(F.col("d") / 24))
    full = g.groupBy("batch").agg(F.countDistinct("d").alias("n")).where("n = 24").select("batch")
    out = K.balance_groups(g.join(full, "batch"), "batch", "d", "response_len", 3, equal_size=True)
    return out.select("batch", "d", "part").distinct()


@query("k04_groups_with_null_uid", f"""{SMALL}, g as (select row_idx // 128 as batch, case when l_linenumber = 2 then null else uid end as uid, count(*) as n from b group by 1, 2)
  select batch, cast(sum(n) as bigint) as rows, count(*) as groups, true as whole from g group by batch""")
def groups_null_uid(spark, sf_dir):
    df = small_batches(spark, sf_dir, 128).withColumn("uid", F.when(F.col("l_linenumber") != 2, F.col("uid")))
    out = K.balance_groups(df, "batch", "uid", "response_len", 4, equal_size=False)
    per = out.groupBy("batch", "uid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("p"))
    return per.groupBy("batch").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.every(F.col("p") == 1).alias("whole"))


COUNT_8 = "cast(ceil(greatest(2, least(count(*) over q, ceil(sum(response_len) over q / 160.0))) / 2.0) * 2 as bigint)"
MICRO = f"""select batch, item, w, max(k) over (partition by batch // 2) as k from (
  select row_idx // 16 as batch, row_idx as item, work as w, {COUNT_8} as k, count(*) over q as n from b window q as (partition by row_idx // 16)) where n = 16"""


@query("k07_micro_batch_members", f"""{SMALL}, {differencing(MICRO, False)},
  rank as (select batch, k, part, row_number() over (partition by batch order by max(w) desc, min(item) desc) - 1 as r from parts group by batch, k, part)
  select batch, item as row_idx, cast(case when r % 2 = 0 then (k + 1) // 2 - 1 - r // 2 else (k + 1) // 2 + r // 2 end as bigint) as part from parts join rank using (batch, k, part)""")
def micro_members(spark, sf_dir):
    df = small_batches(spark, sf_dir, 16)
    df = df.join(df.groupBy("batch").count().where("count = 16").select("batch"), "batch").withColumn("step", F.floor(F.col("batch") / 2))
    return K.micro_batches(df, "batch", "row_idx", "response_len", 160, divisor=2, min_count=2, together="step").select("batch", "row_idx", "part")


# ---------------------------------------------------------------- packing: rows and tokens kept, limits held


SHARDS = """w as (select row_idx // 1000 as shard, row_idx, response_len as n, (pred % 2 = 0)::int as f, pred * 10 as t,
    row_number() over (partition by row_idx // 1000 order by {order}) - 1 as i from r)"""


@query("k08_pack_members", f"""{("with recursive " + R)}, {SHARDS.format(order="response_len, row_idx")},
  s(shard, i, pack, used, images, tokens) as (
    select distinct shard, -1::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from w
    union all select shard, i, case when fresh then pack + 1 else pack end, case when fresh then n else used + n end, case when fresh then f else images + f end, case when fresh then t else tokens + t end
    from (select w.shard, w.i, w.n, w.f, w.t, s.pack, s.used, s.images, s.tokens, w.i > 0 and (s.used + n > 180 or (f = 1 and s.images >= 3) or s.tokens + t > 150) as fresh
          from s join w on w.shard = s.shard and w.i = s.i + 1))
  select row_idx, w.shard || '-' || pack as pack_id, i as place from s join w using (shard, i)""")
def pack_members(spark, sf_dir):
    """Next-fit in segments of 300 rows equals one pass over shards of 1000."""
    df = rollouts(spark, sf_dir, indexed=True).withColumn("shard", F.floor(F.col("row_idx") / 1000))
    out = P.pack_sorted(df, "shard", "row_idx", "response_len", 180, F.col("pred") % 2 == 0, F.col("pred") * 10, 3, 150, segment_rows=300)
    return out.select("row_idx", "pack_id", "place")


@query("k09_first_fit_members", f"""{("with recursive " + R)}, {SHARDS.format(order="row_idx")},
  s(shard, i, base, room, slot) as (
    select distinct shard, -1::bigint, 0::bigint, []::bigint[], null::bigint from w
    union all select shard, i, case when slot is null and len(room) >= 12 then base + len(room) else base end,
      case when slot is not null then [case when j = slot then room[j] - n else room[j] end for j in range(1, len(room) + 1)] when len(room) >= 12 then [120 - n] else list_append(room, 120 - n) end,
      coalesce(slot, case when len(room) >= 12 then 1 else len(room) + 1 end)
    from (select w.shard, w.i, w.n, s.base, s.room, list_position([x >= w.n for x in s.room], true)::bigint as slot from s join w on w.shard = s.shard and w.i = s.i + 1))
  select row_idx, w.shard || '-' || (base + slot - 1) as pack_id, i as place from s join w using (shard, i)""")
def first_fit_members(spark, sf_dir):
    df = rollouts(spark, sf_dir, indexed=True).withColumn("shard", F.floor(F.col("row_idx") / 1000))
    return P.pack_first_fit(df, "shard", "row_idx", "response_len", 120, 12).select("row_idx", "pack_id", "place")


@query("k08_pack_sorted", f"with {R} select data_source, count(*) as rows, cast(sum(response_len) as bigint) as tokens, true as within from r group by 1")
def pack_sorted(spark, sf_dir):
    df = rollouts(spark, sf_dir, indexed=True)
    a = P.pack_sorted(df, "data_source", "row_idx", "response_len", 512, F.col("pred") % 2 == 0, F.col("pred") * 10, 3, 10000)
    j = a.join(df.select("row_idx", "response_len", "pred"), "row_idx")
    p = j.groupBy("data_source", "pack_id").agg(F.count(F.lit(1)).alias("n"), F.sum("response_len").alias("t"), F.sum((F.col("pred") % 2 == 0).cast("int")).alias("i"))
    return p.groupBy("data_source").agg(F.sum("n").alias("rows"), F.sum("t").alias("tokens"), F.every((F.col("t") <= 512) & (F.col("i") <= 3)).alias("within"))


@query("k09_pack_first_fit", f"with {R} select data_source, count(*) as rows, cast(sum(response_len) as bigint) as tokens, true as within from r group by 1")
def first_fit(spark, sf_dir):
    df = rollouts(spark, sf_dir, indexed=True)
    j = P.pack_first_fit(df, "data_source", "row_idx", "response_len", 256, 64).join(df.select("row_idx", "response_len"), "row_idx")
    p = j.groupBy("data_source", "pack_id").agg(F.count(F.lit(1)).alias("n"), F.sum("response_len").alias("t"))
    return p.groupBy("data_source").agg(F.sum("n").alias("rows"), F.sum("t").alias("tokens"), F.every(F.col("t") <= 256).alias("within"))


def fixed_packs(spark, sf_dir):
    """Eight consecutive rollouts per pack: a packing both engines can state."""
    from rewardloom.operators.batch import with_row_idx

    # Rows are numbered before they have tokens, which so are not sorted and shuffled with them.
    df = with_row_idx(rollouts(spark, sf_dir).drop("data_source", "view_type", "pred", "param_version"), ["uid", "rollout_n"])
    df = with_tokens(df, "mask", "entropy").withColumn("ids", F.expr(IDS))
    return df.withColumn("pack_id", F.floor(F.col("row_idx") / 8).cast("string")).withColumn("place", F.col("row_idx"))


@query("k10_build_packs", f"""with {T}, x as (select cast(row_idx//8 as varchar) as pack_id, * from t), s as (select cast(row_idx//8 as varchar) as pack_id, count(*) m, sum(response_len*(response_len-1)//2) pos, sum(response_len) n from r group by 1)
  select pack_id, cast(m as integer) as members, cast(n as integer) as last_offset, 400 as size, cast(sum({TOK}) as bigint) as id_sum, cast(sum(mask) as bigint) as mask_sum, cast(pos as bigint) as position_sum
  from x join s using (pack_id) group by pack_id, m, n, pos""")
def build_packs(spark, sf_dir):
    out = P.build_packs(fixed_packs(spark, sf_dir), "ids", "mask", "row_idx", 400)
    return out.select("pack_id", F.size("members").alias("members"), F.element_at("cu_seqlens", -1).alias("last_offset"), F.size("input_ids").alias("size"),
                      total("input_ids").alias("id_sum"), total("loss_mask").alias("mask_sum"), total("position_ids").alias("position_sum"))


@query("k11_pack_report", f"""with {R}, p as (select row_idx//8 as p, sum(response_len) t, count(*) n from r group by 1)
  select count(*) as packs, cast(sum(n) as bigint) as rows, cast(sum(t) as bigint) as tokens, round(avg(t/400),6) as mean_use, round(min(t/400),6) as min_use, round(max(t/400),6) as max_use,
    round(avg((t/400>=0.9)::int),6) as high, round(avg((t/400>=0.7 and t/400<0.9)::int),6) as medium, round(avg((t/400<0.7)::int),6) as low, round(avg(n),6) as members_per_pack from p""")
def pack_report(spark, sf_dir):
    df = rollouts(spark, sf_dir, indexed=True).withColumn("pack_id", F.floor(F.col("row_idx") / 8))
    return rounded(P.pack_report(df, "response_len", 400))


@query("a30_subsequence_loss", f"""with {T}, x as (select row_idx, sum(entropy*mask)/sum(mask) l from t group by 1) select round(avg(l),6) as loss, count(*) as members from x""")
def subsequence(spark, sf_dir):
    from rewardloom.operators.reduce import subsequence_loss

    df = fixed_packs(spark, sf_dir)
    item = F.struct("place", F.col("row_idx"), F.size("ids").alias("len"), "entropy", "mask")
    packs = df.groupBy("pack_id").agg(F.array_sort(F.collect_list(item)).alias("m")).select(
        F.transform("m", lambda m: F.struct(m["row_idx"].alias("row_idx"), m["len"].alias("len"))).alias("members"),
        F.flatten("m.entropy").alias("loss"), F.flatten("m.mask").alias("loss_mask"))
    return rounded(subsequence_loss(packs))


