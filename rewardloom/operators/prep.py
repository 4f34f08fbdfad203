"""Dataset preparation: raw rows to chat-format prompt, preference and conversation rows.

Messages are ``array<struct<role, content>>``; after ``split_content_parts`` or
``normalize_messages_json`` the content is ``array<struct<type, text, index>>``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import text as X
from rewardloom.plans.scale import rank_within

PART = "struct<type:string,text:string,index:int>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _indexed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return rank_within(df, [], order, "__index")


# ---------------------------------------------------------------- builders


def build_prompt_rows(
    df: DataFrame, source: str, question: Column, answer: Column, truth: Column, order: Sequence[str],
    instruction: str = "", ability: str = "math", split: str = "train",
) -> DataFrame:
    """PROMPTS rows from question and answer columns; index follows ``order``."""
    asked = F.concat(question, F.lit(" " + instruction if instruction else ""))
    out = _indexed(df.select("*", question.alias("__q"), answer.alias("__a"), asked.alias("__p"), truth.alias("__t")), order)
    return out.select(
        F.lit(source).alias("data_source"), F.array(message("user", F.col("__p"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("__t").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("__index").alias("index"), F.col("__a").alias("answer"),
                 F.col("__q").alias("question")).alias("extra_info"),
    )


def build_hash_rows(df, source, question, answer, order, **options) -> DataFrame:
    """Prompt rows whose truth follows ``####``; a row without it is an error."""
    return build_prompt_rows(df, source, question, answer, X.hash_answer(answer, required=True), order, **options)


def build_math_rows(df, source, question, solution, order, **options) -> DataFrame:
    """Prompt rows whose truth is the last boxed expression."""
    return build_prompt_rows(df, source, question, solution, X.boxed_answer(solution), order, **options)


def build_multiple_choice_rows(
    df: DataFrame, source: str, activity: Column, ctx_a: Column, ctx_b: Column, endings: Column, label: Column,
    order: Sequence[str], split: str = "train",
) -> DataFrame:
    """Cloze rows with cleaned query and choices; rows without a label are dropped."""
    query = X.clean_cloze(F.concat(activity, F.lit(": "), ctx_a, F.lit(" "), X.capitalize(ctx_b)))
    kept = df.where(F.length(label) > 0).select(
        *order, query.alias("__q"), F.transform(endings, X.clean_cloze).alias("__c"), label.cast("int").alias("__l")
    )
    return _indexed(kept, order).select(
        F.lit(source).alias("data_source"), F.array(message("user", F.col("__q"))).alias("prompt"), F.lit("nlp").alias("ability"),
        F.struct(F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"), F.col("__l").alias("ground_truth"),
                 F.col("__c").alias("choices")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("__index").alias("index")).alias("extra_info"),
    )


def build_tool_rows(
    prompts: DataFrame, system: str, tool: str, interaction: bool = False, agent_name: str | None = None
) -> DataFrame:
    """Add a system turn, the tool's creation arguments and optional interaction arguments."""
    truth = F.col("reward_model.ground_truth")
    create = F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias(tool))
    info = F.col("extra_info").withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", create)
    if interaction:
        query = F.try_element_at("prompt", F.lit(-1))["content"]
        info = info.withField("interaction_kwargs", F.struct(query.alias("query"), truth.alias("ground_truth")))
    out = prompts.withColumn("prompt", F.concat(F.array(message("system", F.lit(system))), F.col("prompt")))
    out = out.withColumn("extra_info", info)
    return out.withColumn("agent_name", F.lit(agent_name)) if agent_name else out


def build_search_rows(
    df: DataFrame, source: Column, question: Column, golden: Column, truth: Column, order: Sequence[str], system: str,
    user_prefix: str, split: str = "train",
) -> DataFrame:
    """Search-tool prompts; the truth falls back to the golden answers."""
    base = df.select(*order, F.concat(F.lit("searchR1_"), source).alias("__s"), question.alias("__q"),
                     F.coalesce(truth, golden).alias("__t"))
    create = F.struct(F.col("__t").alias("ground_truth"), F.col("__q").alias("question"), F.col("__s").alias("data_source"))
    return _indexed(base, order).select(
        F.col("__s").alias("data_source"),
        F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(user_prefix.rstrip("\n")), F.col("__q")))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), F.col("__t").alias("ground_truth")).alias("reward_model"),
        F.struct(F.col("__index").alias("index"), F.lit(True).alias("need_tools_kwargs"), F.col("__q").alias("question"),
                 F.lit(split).alias("split"), F.struct(F.struct(create.alias("create_kwargs")).alias("search")).alias("tools_kwargs"),
                 ).alias("extra_info"),
    )


def build_sft_messages(question: Column, answer: Column) -> Column:
    return F.array(message("user", question), message("assistant", answer))


def preference_to_sft(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Both responses of a preference as supervised rows."""
    keep = [c for c in df.columns if c not in (prompt, chosen, rejected)]
    return df.select(*keep, prompt, F.posexplode(F.array(chosen, rejected)).alias("side", "response"))


def preference_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def preference_to_rl(df: DataFrame, source: str, prompt: str, chosen: str, order: Sequence[str], split: str = "train"):
    """Prompt rows judged by a model, with the chosen response as truth."""
    base = df.select(*order, F.col(prompt).alias("__p"), F.col(chosen).alias("__c"))
    return _indexed(base, order).select(
        F.lit(source).alias("data_source"), F.array(message("user", F.col("__p"))).alias("prompt"), F.lit("alignment").alias("ability"),
        F.struct(F.lit("model").alias("style"), F.col("__c").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("__index").alias("index")).alias("extra_info"),
    )


# ---------------------------------------------------------------- messages

# Role names of other chat formats.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system"}


def normalize_role(role: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown role "), role)).cast("string")
    for name, target in ROLES.items():
        out = F.when(role == name, F.lit(target)).otherwise(out)
    return out


def normalize_roles(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(normalize_role(m["role"]).alias("role"), m["content"].alias("content")))


def _parts(text: Column) -> Column:
    pieces = F.split(text, r"(?=<image>|<video>)|(?<=<image>|<video>)", -1)
    kinds = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(
        kinds(p).alias("type"), F.when(kinds(p) == "text", p).alias("text")
    ))


def _count(parts: Column, kind: str) -> Column:
    return F.size(F.filter(parts, lambda p: p["type"] == kind))


def split_content_parts(messages: Column, images: Column | None = None, videos: Column | None = None) -> Column:
    """Text content to ordered parts; media carry a running index over the conversation.

    With ``images`` or ``videos`` given, a different number of placeholders is an error.
    """
    parsed = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), _parts(m["content"]).alias("content")))
    flat = F.flatten(F.transform(parsed, lambda m: m["content"]))
    checks = []
    for kind, given in (("image", images), ("video", videos)):
        if given is not None:
            text = F.concat(F.lit(f"{kind} count mismatch: "), _count(flat, kind).cast("string"))
            checks.append(F.when(_count(flat, kind) != given, F.raise_error(text)))
    start = F.struct(F.lit(0).alias("image"), F.lit(0).alias("video"),
                     F.array().cast(f"array<struct<role:string,content:array<{PART}>>>").alias("out"))

    def number(acc: Column, part: Column) -> Column:
        index = F.when(part["type"] == "image", acc["image"]).when(part["type"] == "video", acc["video"])
        numbered = F.struct(part["type"].alias("type"), part["text"].alias("text"), index.cast("int").alias("index"))
        return F.struct(
            (acc["image"] + (part["type"] == "image").cast("int")).alias("image"),
            (acc["video"] + (part["type"] == "video").cast("int")).alias("video"),
            F.concat(acc["out"], F.array(numbered)).alias("out"),
        )

    def step(acc: Column, m: Column) -> Column:
        inner = F.struct(acc["image"].alias("image"), acc["video"].alias("video"), F.array().cast(f"array<{PART}>").alias("out"))
        done = F.aggregate(m["content"], inner, number)
        return F.struct(done["image"].alias("image"), done["video"].alias("video"),
                        F.concat(acc["out"], F.array(F.struct(m["role"].alias("role"), done["out"].alias("content")))).alias("out"))

    result = F.aggregate(parsed, start, step, lambda acc: acc["out"])
    for check in checks:
        result = F.when(check.isNull(), result)
    return result


def normalize_messages_json(text: Column) -> Column:
    """Messages from a JSON list whose messages, contents and parts may themselves be JSON strings.

    Null when the text is not a list of messages.
    """
    opened = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    part = lambda v: F.struct(F.try_variant_get(v, "$.type", "string").alias("type"),
                              F.try_variant_get(v, "$.text", "string").alias("text"), F.lit(None).cast("int").alias("index"))
    listed = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda p: part(opened(p)))

    def content(c: Column) -> Column:
        plain = F.try_variant_get(c, "$", "string")
        alone = F.array(F.struct(F.lit("text").alias("type"), plain.alias("text"), F.lit(None).cast("int").alias("index")))
        is_text = F.schema_of_variant(c) == "STRING"
        return F.when(is_text & F.startswith(F.trim(plain), F.lit("[")), listed(F.try_parse_json(plain))).when(
            is_text, alone).otherwise(listed(c))

    one = lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"),
                             content(F.try_variant_get(m, "$.content", "variant")).alias("content"))
    return F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), lambda m: one(opened(m)))


def _map_text(messages: Column, change, roles: Sequence[str]) -> Column:
    def one(m):
        parts = F.transform(m["content"], lambda p: F.struct(
            p["type"].alias("type"), F.when(p["type"] == "text", change(p["text"])).otherwise(p["text"]).alias("text"), p["index"].alias("index")))
        return F.struct(m["role"].alias("role"), F.when(m["role"].isin(list(roles)), parts).otherwise(m["content"]).alias("content"))

    return F.transform(messages, one)


def strip_reasoning(messages: Column) -> Column:
    """Remove think blocks from assistant text."""
    return _map_text(messages, lambda t: F.trim(F.regexp_replace(t, r"(?s)<think>.*?</think>", "")), ["assistant"])


def has_reasoning(messages: Column) -> Column:
    """Whether any part holds a complete think block."""
    return F.exists(messages, lambda m: F.exists(m["content"], lambda p: F.coalesce(p["text"].rlike(r"(?s)<think>.*?</think>"), F.lit(False))))


def inject_system_prompt(messages: Column, prompt: str) -> Column:
    part = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"), F.lit(None).cast("int").alias("index"))
    return F.concat(F.array(message("system", F.array(part))), messages)


def plain_parts(messages: Column) -> Column:
    """String contents to one text part each."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(
        F.lit("text").alias("type"), m["content"].alias("text"), F.lit(None).cast("int").alias("index"))).alias("content")))


def reverse_leading_images(messages: Column) -> Column:
    """Reverse the run of image parts a message starts with, when there are at least two."""

    def one(m: Column) -> Column:
        parts = m["content"]
        stop = F.array_position(F.transform(parts, lambda p: (p["type"] != "image").cast("int")), 1).cast("int")
        run = F.when(stop == 0, F.size(parts)).otherwise(stop - 1)
        turned = F.concat(F.reverse(F.slice(parts, F.lit(1), run)), F.slice(parts, run + 1, F.size(parts)))
        return F.struct(m["role"].alias("role"), F.when(run >= 2, turned).otherwise(parts).alias("content"))

    return F.transform(messages, one)


def render_chat(messages: Column, generation_marker: bool = True) -> Column:
    """One prompt text: ``<|role|>`` line, content, ``<|end|>`` line per turn.

    Accepts string contents or parts; media parts become ``<type>``.
    """
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n<|end|>\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n")) if generation_marker else body


def parts_to_text(messages: Column) -> Column:
    """Parts back to string contents."""
    flat = lambda c: F.array_join(F.transform(c, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(
        F.concat(F.lit("<"), p["type"], F.lit(">")))), "")
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), flat(m["content"]).alias("content")))


# ---------------------------------------------------------------- metadata


def derive_view_type(metadata: Column, default: str | None = None) -> Column:
    """Category from metadata JSON: first question tag, else prefixed question or view type."""
    m = F.try_parse_json(metadata)
    tags = F.try_variant_get(m, "$.question_tags", "variant")
    tag = F.when(F.schema_of_variant(tags).startswith("ARRAY"), F.try_variant_get(tags, "$[0]", "string")).otherwise("Ours-unknown")
    named = lambda key: F.concat(F.lit("Ours-"), F.try_variant_get(m, f"$.{key}", "string"))
    inside = F.when(tags.isNotNull(), tag).otherwise(F.coalesce(named("question_type"), named("view_type"), F.lit("Ours-unknown")))
    is_object = F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, inside).otherwise(F.lit(default or "OpenData"))


# Short reward names.
REWARD_NAMES = {"z": "spatial_z", "xy": "spatial_xy", "t": "spatial_t"}


def reward_route(rewards: Column, default: str) -> Column:
    """Reward list to one ``a+b`` route; short names are expanded, an empty list takes the default."""
    clean = F.filter(F.transform(rewards, lambda r: F.lower(F.trim(r))), lambda r: r != "")
    full = lambda r: F.when(r == "z", "spatial_z").when(r == "xy", "spatial_xy").when(r == "t", "spatial_t").otherwise(r)
    return F.when(F.coalesce(F.size(clean), F.lit(0)) > 0, F.array_join(F.transform(clean, full), "+")).otherwise(F.lit(default))


def truth_or_answer(truth: Column, last_role: Column, last_text: Column) -> Column:
    """Ground truth, else the answer tag of a closing assistant turn."""
    tagged = F.trim(F.regexp_extract(last_text, r"(?s)<answer>(.*?)</answer>", 1))
    found = F.contains(last_text, F.lit("<answer>")) & F.contains(last_text, F.lit("</answer>"))
    return F.coalesce(truth, F.when((last_role == "assistant") & found, tagged))


def reject_reason(
    messages: Column, truth: Column, image_count: Column, route: Column | None = None, inverse_truth: Column | None = None,
    width: Column | None = None, height: Column | None = None, max_messages: int | None = None,
) -> Column:
    """Why a sample is unusable, or null; the first failing rule is named."""
    parts = F.flatten(F.transform(messages, lambda m: m["content"]))
    images = _count(parts, "image")
    text = F.exists(parts, lambda p: (p["type"] == "text") & (F.length(F.trim(p["text"])) > 0))
    assistant_image = F.exists(messages, lambda m: (m["role"] == "assistant") & F.exists(m["content"], lambda p: p["type"] == "image"))
    rules = [(messages.isNull(), "no_json"), (F.size(messages) == 0, "no_messages"), (~text, "no_text"),
             (images != image_count, "image_count_mismatch"), (truth.isNull() | (truth == ""), "no_ground_truth")]
    if route is not None and inverse_truth is not None:
        short = F.coalesce(F.trim(inverse_truth), F.lit("")) == ""
        rules.append((F.contains(route, F.lit("spatial_t")) & (short | (images < 2)), "incomplete_temporal"))
    rules.append((assistant_image, "assistant_image"))
    if max_messages is not None:
        rules.append((F.size(messages) > max_messages, "too_many_messages"))
    if width is not None and height is not None:
        ratio = width / height
        rules += [((ratio < 0.005) | (ratio > 200.0), "aspect_ratio"), (width.cast("long") * height > 100_000_000, "too_many_pixels")]
    reason = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        reason = F.when(bad, F.lit(name)).otherwise(reason)
    return reason


def validate_samples(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and rejects counted by reason."""
    marked = df.withColumn("reason", reason)
    rejects = marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    return marked.where(F.col("reason").isNull()).drop("reason"), rejects


# ---------------------------------------------------------------- filters and projections


def filter_difficulty(df: DataFrame, count: str, exclude: Iterable[int] = (0, 4)) -> DataFrame:
    """Drop rows whose number of correct trials is excluded; missing or unreadable counts stay."""
    value = F.try_to_number(F.col(count).cast("string"), F.lit("999999999")) if dict(df.dtypes)[count] == "string" else F.col(count)
    return df.where(~F.coalesce(value.isin([int(v) for v in exclude]), F.lit(False)))


def filter_overlong(df: DataFrame, length: Column, max_length: int) -> DataFrame:
    """Keep rows within the limit; a row that cannot be measured counts as too long."""
    return df.where(F.coalesce(length, F.lit(max_length + 1)) <= max_length)


def project_path(column: Column, keys: Sequence[str]) -> Column:
    """Walk nested struct fields or a variant."""
    for key in keys:
        column = column[key]
    return column


def project_json_path(column: Column, keys: Sequence[str]) -> Column:
    return F.get_json_object(column, "$." + ".".join(keys))


def with_index_kwargs(df: DataFrame, info: str = "extra_info") -> DataFrame:
    """Surface index and the keyword structs of extra_info, with defaults."""
    fields = df.schema[info].dataType.fieldNames()
    value = lambda name, default: F.coalesce(F.col(info)[name], default) if name in fields else default
    text = lambda name: F.to_json(F.col(info)[name]) if name in fields else F.lit(None).cast("string")
    return df.withColumns({
        "index": value("index", F.lit(0)),
        "tools_kwargs": F.coalesce(text("tools_kwargs"), F.lit("{}")),
        "interaction_kwargs": F.coalesce(text("interaction_kwargs"), F.lit("{}")),
    })


def passages_to_text(hits: Column) -> Column:
    """Reference block from hits with title and text."""
    return F.array_join(F.transform(hits, lambda h, i: F.concat(
        F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), h["title"], F.lit(")\n"), h["text"], F.lit("\n\n"))), "")


def sanitize(value: Column) -> Column:
    """NaN, infinities and null to 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def sanitize_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: sanitize(F.col(c).cast("double")) for c in columns})


def extra_keys(df: DataFrame, extras: str = "extras") -> list[str]:
    """Union of the extra keys of all rows: a small distinct aggregate."""
    return sorted(r.k for r in df.select(F.explode(F.map_keys(extras)).alias("k")).distinct().collect())


def normalize_extras(df: DataFrame, extras: str = "extras", keys: Sequence[str] | None = None) -> DataFrame:
    """Every row with every key of the table; a missing numeric extra is 0."""
    keys = extra_keys(df, extras) if keys is None else keys
    full = {f"{extras}_{k}": F.coalesce(F.try_element_at(F.col(extras), F.lit(k)), F.lit(0.0)) for k in keys}
    return df.withColumns(full).drop(extras)


def make_inverse_prompts(df: DataFrame, messages: str = "prompt") -> DataFrame:
    """Row-for-row second table with the leading images of every prompt reversed."""
    return df.withColumn(messages, reverse_leading_images(F.col(messages)))


def with_roles(df: DataFrame, mapping: Mapping[str, str], role: str = "role") -> DataFrame:
    """The same role mapping on a turn-per-row table."""
    out = F.raise_error(F.concat(F.lit("unknown role "), F.col(role))).cast("string")
    for name, target in mapping.items():
        out = F.when(F.col(role) == name, F.lit(target)).otherwise(out)
    return df.withColumn(role, out)
