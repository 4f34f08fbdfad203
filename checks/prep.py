"""Dataset preparation against SQL; raw questions, answers and chats come from the provided tables."""

from pyspark.sql import functions as F

from checks.base import R, query, rollouts, table
from rewardloom.functions import text as X
from rewardloom.operators import prep as P
from rewardloom.plans.scale import gather_lists

QA = """qa as (select o_orderkey as k, 'How much is order ' || o_orderkey || '?' as question, o_orderpriority as pri,
   'Count ' || o_custkey || ' items. #### ' || (o_custkey*7) || ',' || lpad((o_orderkey % 1000)::varchar, 3, '0') as answer,
   'So \\boxed{\\frac{' || o_custkey || '}{' || (o_orderkey % 97) || '}} and \\boxed{x_{' || o_orderkey || '}+{1}} holds.' as solution from orders)"""


def qa(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("k"), F.format_string("How much is order %d?", "o_orderkey").alias("question"),
        F.col("o_orderpriority").alias("pri"),
        F.concat(F.lit("Count "), "o_custkey", F.lit(" items. #### "), F.col("o_custkey") * 7, F.lit(","),
                 F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")).alias("answer"),
        F.concat(F.lit("So \\boxed{\\frac{"), "o_custkey", F.lit("}{"), F.col("o_orderkey") % 97, F.lit("}} and \\boxed{x_{"),
                 "o_orderkey", F.lit("}+{1}} holds.")).alias("solution"))


def _flat(df):
    return df.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability",
                     F.col("reward_model.style").alias("style"), F.col("reward_model.ground_truth").alias("truth"),
                     F.col("extra_info.index").alias("idx"), F.col("extra_info.split").alias("split"),
                     F.col("extra_info.question").alias("question"))


@query("p01_build_prompt_rows", f"""with {QA} select 'made/arith' as data_source, 'user' as role, question || ' Think step by step.' as content, 'math' as ability,
  'rule' as style, replace(split_part(answer, '#### ', 2), ',', '') as truth, row_number() over (order by k)-1 as idx, 'train' as split, question from qa""")
def prompt_rows(spark, sf_dir):
    return _flat(P.build_hash_rows(qa(spark, sf_dir), "made/arith", F.col("question"), F.col("answer"), ["k"], instruction="Think step by step."))


@query("p02_extract_hash_answer", f"""with {QA} select k, replace(split_part(answer, '#### ', 2), ',', '') as value, cast(null as varchar) as absent from qa""")
def hash_answer(spark, sf_dir):
    return qa(spark, sf_dir).select("k", X.hash_answer(F.col("answer")).alias("value"), X.hash_answer(F.col("question")).alias("absent"))


@query("p03_extract_boxed_answer", f"""with {QA} select k, 'x_{{' || k || '}}+{{1}}' as value from qa""")
def boxed(spark, sf_dir):
    return qa(spark, sf_dir).select("k", X.boxed_answer(F.col("solution")).alias("value"))


@query("p04_build_math_rows", f"""with {QA} select 'made/boxed' as data_source, 'user' as role, question as content, 'math' as ability, 'rule' as style,
  'x_{{' || k || '}}+{{1}}' as truth, row_number() over (order by k)-1 as idx, 'test' as split, question from qa""")
def math_rows(spark, sf_dir):
    return _flat(P.build_math_rows(qa(spark, sf_dir), "made/boxed", F.col("question"), F.col("solution"), ["k"], split="test"))


@query("p05_build_multiple_choice_rows", """with d as (select doc_id, lang || ' [title] ' || source || '  [x]' as a, text from documents where n_chars % 2 = 0),
  c as (select doc_id, replace(regexp_replace(replace(trim(lang || ': ' || a || ' ' || upper(substr(source,1,1)) || lower(substr(source,2))), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') as q,
     replace(regexp_replace(replace(trim(a), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') as ch from (select d.*, documents.lang, documents.source from d join documents using (doc_id)))
  select row_number() over (order by doc_id)-1 as idx, q as query, ch as first_choice, 3 as gold from c""")
def multiple_choice(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.withColumn("a", F.concat("lang", F.lit(" [title] "), "source", F.lit("  [x]")))
    label = F.when(F.col("n_chars") % 2 == 0, "3").otherwise("")
    out = P.build_multiple_choice_rows(d, "made/cloze", F.col("lang"), F.col("a"), F.col("source"), F.array("a", "source"), label, ["doc_id"])
    return out.select(F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("query"),
                      F.col("reward_model.choices")[0].alias("first_choice"), F.col("reward_model.ground_truth").alias("gold"))


@query("p06_build_tool_rows", f"""with {QA} select 'system' as role0, 'Use the tool.' as content0, question as content1, replace(split_part(answer, '#### ', 2), ',', '') as create_truth,
   question as interaction_query, true as need_tools, 'tool_agent' as agent_name, row_number() over (order by k)-1 as idx from qa""")
def tool_rows(spark, sf_dir):
    base = P.build_hash_rows(qa(spark, sf_dir), "made/arith", F.col("question"), F.col("answer"), ["k"])
    out = P.build_tool_rows(base, "Use the tool.", "calc_reward", True, "tool_agent")
    return out.select(F.col("prompt")[0]["role"].alias("role0"), F.col("prompt")[0]["content"].alias("content0"), F.col("prompt")[1]["content"].alias("content1"),
                      F.col("extra_info.tools_kwargs.calc_reward.create_kwargs.ground_truth").alias("create_truth"),
                      F.col("extra_info.interaction_kwargs.query").alias("interaction_query"), F.col("extra_info.need_tools_kwargs").alias("need_tools"),
                      "agent_name", F.col("extra_info.index").alias("idx"))


@query("p07_build_search_rows", f"""with {QA} select 'searchR1_' || pri as data_source, 'Answer: ' || question as content, case when k % 2 = 0 then k::varchar else 'gold ' || k end as truth,
  row_number() over (order by k)-1 as idx from qa""")
def search_rows(spark, sf_dir):
    df = qa(spark, sf_dir)
    out = P.build_search_rows(df, F.col("pri"), F.col("question"), F.concat(F.lit("gold "), "k"),
                              F.when(F.col("k") % 2 == 0, F.col("k").cast("string")), ["k"], "Search first.", "Answer: \n")
    return out.select("data_source", F.col("prompt")[1]["content"].alias("content"), F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth").alias("truth"),
                      F.col("extra_info.index").alias("idx"))


@query("p08_build_sft_messages", f"with {QA} select k, 'user: ' || question || ' | assistant: ' || answer as chat from qa")
def sft_messages(spark, sf_dir):
    m = P.build_sft_messages(F.col("question"), F.col("answer"))
    return qa(spark, sf_dir).select("k", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), " | ").alias("chat"))


@query("p09_preference_to_sft", f"with {QA} select k, question, 0 as side, answer as response from qa union all select k, question, 1, solution from qa")
def pref_sft(spark, sf_dir):
    return P.preference_to_sft(qa(spark, sf_dir).drop("pri"), "question", "answer", "solution")


@query("p10_preference_pairs", f"with {QA} select k, question as prompt, answer as chosen, solution as rejected from qa")
def pref_pairs(spark, sf_dir):
    return P.preference_pairs(qa(spark, sf_dir), "question", "answer", "solution", ["k"])


@query("p10_preference_to_rl", f"""with {QA} select 'made/pref' as data_source, question as content, answer as truth, 'alignment' as ability, row_number() over (order by k)-1 as idx from qa""")
def pref_rl(spark, sf_dir):
    out = P.preference_to_rl(qa(spark, sf_dir), "made/pref", "question", "answer", ["k"])
    return out.select("data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), "ability", F.col("extra_info.index").alias("idx"))


def chats(spark, sf_dir, role=None, text=None):
    c = table(spark, sf_dir, "conversations")
    item = F.struct((role if role is not None else F.col("role")).alias("role"), (text if text is not None else F.col("text")).alias("content"))
    return gather_lists(c, ["conv_id"], ["turn"], item, "messages")


MEDIA = "case when turn % 3 = 0 then '<image><image>' || text || '<image>' when turn % 3 = 1 then text || '<video>' else text end"
FOREIGN = "case role when 'user' then 'human' when 'assistant' then 'gpt' else role end"


@query("p11_normalize_roles", "select conv_id, string_agg(role, ',' order by turn) as roles from conversations group by conv_id")
def roles(spark, sf_dir):
    df = chats(spark, sf_dir, role=F.expr(FOREIGN)).withColumn("messages", P.normalize_roles(F.col("messages")))
    return df.select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("p12_split_content_parts", """select conv_id, cast(sum(case when turn%3=0 then 3 else 0 end) as integer) as images, cast(sum(case when turn%3=1 then 1 else 0 end) as integer) as videos,
  cast(sum(case when turn%3=0 then 3 else 0 end) as integer) - 1 as last_image, string_agg(case when text='' then '' else text end, '' order by turn) as joined from conversations group by 1""")
def content_parts(spark, sf_dir):
    df = chats(spark, sf_dir, text=F.expr(MEDIA)).withColumn("m", P.split_content_parts(F.col("messages")))
    parts = F.flatten(F.transform("m", lambda x: x["content"]))
    of = lambda k: F.filter(parts, lambda p: p["type"] == k)
    return df.select("conv_id", F.size(of("image")).alias("images"), F.size(of("video")).alias("videos"),
                     F.coalesce(F.array_max(F.transform(of("image"), lambda p: p["index"])), F.lit(-1)).alias("last_image"),
                     F.array_join(F.transform(of("text"), lambda p: p["text"]), "").alias("joined"))


@query("p13_normalize_messages_json", """select conv_id, string_agg(role || ':' || text, '|' order by turn) as chat from conversations group by 1""")
def messages_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    # Three encodings: plain text, a JSON list of parts, and a whole message as a JSON string.
    listed = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    content = F.when(F.col("turn") % 3 == 1, listed).otherwise(F.col("text"))
    obj = F.to_json(F.struct("role", content.alias("content")))
    quoted = F.to_json(F.struct(obj.alias("x")))
    item = F.when(F.col("turn") % 3 == 2, F.expr("substring(x, 6, length(x) - 6)")).otherwise(obj)
    c = c.withColumn("x", quoted).withColumn("o", item)
    df = gather_lists(c, ["conv_id"], ["turn"], F.col("o"), "items")
    m = P.normalize_messages_json(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    return df.select("conv_id", F.array_join(F.transform(P.parts_to_text(m), lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("chat"))


THINK = "case when role = 'assistant' and turn % 4 <> 3 then '<think>step ' || turn || '</think> ' || text else text end"


@query("p14_strip_reasoning", """select conv_id, string_agg(case when role='assistant' then trim(regexp_replace(text, '<think>.*?</think>', '', 'gs')) else text end, '|' order by turn) as chat from conversations group by 1""")
def strip(spark, sf_dir):
    df = chats(spark, sf_dir, text=F.expr(THINK))
    m = P.parts_to_text(P.strip_reasoning(P.plain_parts(F.col("messages"))))
    return df.select("conv_id", F.array_join(F.transform(m, lambda x: x["content"]), "|").alias("chat"))


@query("p15_has_reasoning", """select conv_id, bool_or((role='assistant' and turn%4<>3) or regexp_matches(text, '(?s)<think>.*?</think>')) as reasoning from conversations group by 1""")
def reasoning(spark, sf_dir):
    return chats(spark, sf_dir, text=F.expr(THINK)).select("conv_id", P.has_reasoning(P.plain_parts(F.col("messages"))).alias("reasoning"))


@query("p16_inject_system_prompt", """select conv_id, 'system:Think.|' || string_agg(role || ':' || text, '|' order by turn) as chat from conversations group by 1""")
def inject(spark, sf_dir):
    df = chats(spark, sf_dir)
    m = P.parts_to_text(P.inject_system_prompt(P.plain_parts(F.col("messages")), "Think."))
    return df.select("conv_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("chat"))


@query("p17_derive_view_type", """select doc_id, case doc_id % 6 when 0 then source when 1 then 'Ours-' || lang when 2 then 'Ours-' || source when 3 then 'Ours-unknown' when 4 then 'Ours-unknown' else 'vsi' end as view_type from documents""")
def view_type(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.expr("""case doc_id % 6 when 0 then to_json(named_struct('question_tags', array(source, lang), 'question_type', lang))
      when 1 then to_json(named_struct('question_type', lang, 'view_type', source)) when 2 then to_json(named_struct('view_type', source))
      when 3 then to_json(named_struct('question_tags', source)) when 4 then '{}' else 'not json' end""")
    return d.select("doc_id", P.derive_view_type(meta, "vsi").alias("view_type"))


@query("p18_derive_reward_routing", """select doc_id, case doc_id % 4 when 0 then 'accuracy+spatial_xy' when 1 then 'spatial_z+' || lang when 2 then 'spatial_t' else 'accuracy+format' end as route,
  case when doc_id % 2 = 0 then 'A' || doc_id when doc_id % 3 = 0 then 'B ' || source else null end as truth from documents""")
def routing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rewards = F.expr("case doc_id % 4 when 0 then array('Accuracy ', 'xy') when 1 then array('z', lang) when 2 then array('T', '') else array() end")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>x</think><answer> B "), "source", F.lit(" </answer>"))).otherwise(F.lit("none"))
    truth = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A"), "doc_id"))
    return d.select("doc_id", P.reward_route(rewards, "accuracy+format").alias("route"), P.truth_or_answer(truth, F.lit("assistant"), text).alias("truth"))


@query("p19_validate_samples", """with c as (select conv_id, count(*) n, sum(case when turn%3=0 then 3 else 0 end) img, bool_or(role='assistant' and turn%3=0) ai, bool_or(trim(text)<>'') tx from conversations group by 1)
  select reason, count(*) as rows from (select case when not tx then 'no_text' when conv_id % 7 = 0 and img <> 3 then 'image_count_mismatch' when conv_id % 5 = 0 then 'no_ground_truth'
    when ai then 'assistant_image' when n > 5 then 'too_many_messages' end as reason from c) where reason is not null group by 1""")
def validate(spark, sf_dir):
    df = chats(spark, sf_dir, text=F.expr(MEDIA)).withColumn("m", P.split_content_parts(F.col("messages")))
    parts = F.flatten(F.transform("m", lambda x: x["content"]))
    images = F.size(F.filter(parts, lambda p: p["type"] == "image"))
    reason = P.reject_reason(F.col("m"), F.when(F.col("conv_id") % 5 != 0, F.lit("x")), F.when(F.col("conv_id") % 7 == 0, F.lit(3)).otherwise(images), max_messages=5)
    return P.validate_samples(df, reason)[1]


@query("p20_filter_difficulty", f"""with {R}, c as (select uid, count(*) filter (where score >= 5) as right_count from r group by 1) select uid, right_count from c where right_count not in (0, 4)""")
def difficulty(spark, sf_dir):
    c = rollouts(spark, sf_dir).groupBy("uid").agg(F.sum((F.col("score") >= 5).cast("long")).alias("right_count"))
    return P.filter_difficulty(c, "right_count")


@query("p21_filter_overlong", """select doc_id, n_chars from documents where case when trim(regexp_replace(text,'\\s+',' ','g'))='' then 0 else len(string_split(trim(regexp_replace(text,'\\s+',' ','g')), ' ')) end <= 100""")
def overlong(spark, sf_dir):
    return P.filter_overlong(table(spark, sf_dir, "documents"), X.word_count(F.col("text")), 100).select("doc_id", "n_chars")


@query("p22_project_path", "select event_id, props->>'$.k' as k from events")
def path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.project_json_path(F.col("props"), ["k"]).alias("k"))


@query("p23_with_index_kwargs", f"""with {QA} select row_number() over (order by k)-1 as index, '{{"calc":{{"create_kwargs":{{"ground_truth":"' || replace(split_part(answer, '#### ', 2), ',', '') || '"}}}}}}' as tools_kwargs, '{{}}' as interaction_kwargs from qa""")
def index_kwargs(spark, sf_dir):
    base = P.build_tool_rows(P.build_hash_rows(qa(spark, sf_dir), "s", F.col("question"), F.col("answer"), ["k"]), "Use it.", "calc")
    return P.with_index_kwargs(base).select("index", "tools_kwargs", "interaction_kwargs")


@query("p24_render_chat", """select conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by turn) || '<|assistant|>' || chr(10) as prompt from conversations group by 1""")
def render(spark, sf_dir):
    return chats(spark, sf_dir).select("conv_id", P.render_chat(F.col("messages")).alias("prompt"))


@query("p25_passages_to_text", """select conv_id, string_agg('Doc ' || (turn+1-m) || ' (Title: ' || role || ')' || chr(10) || text || chr(10) || chr(10), '' order by turn) as block
  from conversations join (select conv_id, min(turn) m from conversations group by 1) using (conv_id) group by 1""")
def passages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    df = gather_lists(c, ["conv_id"], ["turn"], F.struct(F.col("role").alias("title"), "text"), "hits")
    return df.select("conv_id", P.passages_to_text(F.col("hits")).alias("block"))


CALLS = """'Let me look. <tool_call>{"name": "find", "arguments": {"order": ' || uid || ', "n": ' || rollout_n || '}}</tool_call> then <tool_call>{bad json</tool_call> and <tool_call>{"name": "sum", "arguments": {"v": ' || pred || '}}</tool_call> done'"""


@query("p26_extract_tool_calls", f"""with {R} select uid, rollout_n, 2 as calls, 'find' as first_name, '{{"v":' || pred || '}}' as last_arguments, 'Let me look.  then  and  done' as rest from r""")
def tool_calls(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("text", F.expr(CALLS))
    c = X.tool_calls(F.col("text"))
    return df.select("uid", "rollout_n", F.size(c).alias("calls"), c[0]["name"].alias("first_name"), c[1]["arguments"].alias("last_arguments"),
                     X.without_tool_calls(F.col("text")).alias("rest"))


CHANNEL = """'<|channel|>analysis<|message|>plan <|start|>assistant<|channel|>commentary to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>' ||
  '<|start|>assistant<|channel|>commentary to=functions.lookup <|constrain|>json<|message|>{"u": ' || uid || '}<|call|>Answer ' || pred"""


@query("p27_extract_channel_tool_calls", f"""with {R} select uid, rollout_n, 1 as calls, 'lookup' as name, '{{"u": ' || uid || '}}' as arguments, 'Answer ' || pred as rest from r""")
def channel(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("text", F.expr(CHANNEL))
    c = X.channel_tool_calls(F.col("text"))
    return df.select("uid", "rollout_n", F.size(c).alias("calls"), c[0]["name"].alias("name"), c[0]["arguments"].alias("arguments"),
                     X.without_channel_calls(F.col("text")).alias("rest"))


@query("p28_sanitize_numeric", """select event_id, case when event_type='error' or value is null then 0.0::double else value end as value, case when event_id % 3 = 0 then 0.0::double else 1.5::double end as other from events""")
def sanitize(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.withColumn("value", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")))
    e = e.withColumn("other", F.when(F.col("event_id") % 3 == 0, F.lit(float("-inf"))).otherwise(1.5))
    return P.sanitize_numeric(e, ["value", "other"]).select("event_id", "value", "other")


@query("p29_normalize_extras", f"""with {R} select uid, rollout_n, case when rollout_n % 2 = 0 then score else 0 end as extras_acc, case when rollout_n % 2 = 1 then pred::double else 0 end as extras_fmt from r""")
def extras(spark, sf_dir):
    df = rollouts(spark, sf_dir).select("uid", "rollout_n", F.expr(
        "if(rollout_n % 2 = 0, map('acc', score), map('fmt', cast(pred as double)))").alias("extras"))
    return P.normalize_extras(df)


@query("p30_reverse_leading_images", """select conv_id, string_agg(case when turn%3=0 then '1,0,t' || ',2' else 't' end, '|' order by turn) as shape from conversations group by 1""")
def reverse_images(spark, sf_dir):
    # Each third turn starts with two images and ends with one; numbering restarts per message here.
    lead = "case when turn % 3 = 0 then '<image><image>' || conv_id || '<image>' else 'x' end"
    df = chats(spark, sf_dir, text=F.expr(lead))
    one = F.transform("messages", lambda m: P.reverse_leading_images(P.split_content_parts(F.array(m)))[0]["content"])
    shape = F.transform(one, lambda c: F.array_join(F.transform(c, lambda p: F.coalesce(p["index"].cast("string"), F.lit("t"))), ","))
    return df.select("conv_id", F.array_join(shape, "|").alias("shape"))


