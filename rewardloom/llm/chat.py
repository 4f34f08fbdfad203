"""Reply trees to formatted conversations, in DataFrame operations only.

Messages point to the message they answer. Jump tables (parent, its parent's parent, ...) come from self-joins
that double their reach; going through them from the longest jump down, every leaf meets each of its
ancestors once. Work is the total length of the paths, and the number of joins the logarithm of the depth.

The template of a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|`` (in roles a line end ``<\\n``), so no text holds a control string, and each can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: conv_id, leaf, branch (1 is best), score, and one row per message: depth, node_id.

    ``messages`` has conv_id, node_id, parent_id, score. A message whose parent is null or missing is a root. A path
    scores the sum of its messages (null: 0); ties go to the smaller leaf. ``branches`` keeps that many
    paths per conversation, None all. node_id must be unique in a conversation and not null; replies in a
    circle are an error.
    """
    # A message is named by one struct, equal where both parts are, null included. Every table here grows with the
    # messages: all joins are shuffle joins, none may become a broadcast.
    nodes = stored(messages.select(
        F.struct("conv_id", "node_id").alias("k"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"),
        F.when(F.col("parent_id").isNotNull(), F.struct("conv_id", F.col("parent_id").alias("node_id"))).alias("up"),
    ), "messages")
    jumps = nodes.where("up is not null").select("k", "up").join(nodes.select(F.col("k").alias("up")).hint("merge"), "up", "left_semi").select("k", "up")
    jumps = stored(jumps, "jumps")
    leaves = nodes.select("k").join(jumps.select(F.col("up").alias("k")).hint("merge"), "k", "left_anti")
    most = nodes.groupBy("k.conv_id").count().agg(F.max("count")).first()[0] or 0
    tables = []
    while not jumps.isEmpty():
        if 1 << len(tables) > most:
            raise ValueError("replies form a circle")
        tables.append(jumps)
        far = jumps.select(F.col("k").alias("up"), F.col("up").alias("far")).hint("merge")
        jumps = stored(jumps.join(far, "up").select("k", F.col("far").alias("up")), "jumps")
    steps = leaves.select(F.col("k").alias("leaf"), "k", F.lit(0).alias("back"))
    for n in range(len(tables) - 1, -1, -1):
        more = steps.join(tables[n].hint("merge"), "k")
        steps = stored(steps.union(more.select("leaf", F.col("up").alias("k"), (F.col("back") + (1 << n)).alias("back"))), "paths")
    paths = steps.join(nodes.select("k", "s").hint("merge"), "k").groupBy("leaf").agg(F.sum("s").alias("score"), F.max("back").alias("last"))
    rank = F.row_number().over(Window.partitionBy("leaf.conv_id").orderBy(F.desc("score"), "leaf.node_id"))
    paths = paths.withColumn("branch", rank)
    if branches is not None:
        paths = paths.where(F.col("branch") <= branches)
    found = steps.join(paths.hint("merge"), "leaf")
    return found.select(
        F.col("leaf.conv_id").alias("conv_id"), F.col("leaf.node_id").alias("leaf"), "branch", "score",
        (F.col("last") - F.col("back")).alias("depth"), F.col("k.node_id").alias("node_id"),
    )


def format_conversations(messages: DataFrame, branches: int | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted conversation per chosen path of ``messages`` (conv_id, node_id, parent_id, role, text, score).

    Returns conv_id, leaf, branch, score, formatted, and loss_spans: array of (start, end) code points of
    ``formatted`` that hold the texts of the roles in ``learn``. Null roles and texts are empty; further columns are
    not looked at; a null conv_id is a conversation of its own; no message, no row.
    """
    names = ("conv_id", "node_id", "parent_id", "role", "text", "score")
    messages = stored(messages.select(*names), "conversations")
    paths = reply_paths(messages, branches).withColumn("k", F.struct("conv_id", "node_id"))
    parts = messages.select(
        F.struct("conv_id", "node_id").alias("k"),
        _escaped_role(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("_role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"),
        F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("_learn"),
    )
    rows = paths.join(parts.hint("merge"), "k").drop("k")
    head = F.length("_role") + (len(START) + 1)
    size = head + F.length("_text") + len(END)
    path = Window.partitionBy("conv_id", "leaf").orderBy("depth")
    rows = rows.withColumn("_start", F.sum(size).over(path) - size + head)
    turn = F.struct("depth", F.concat(F.lit(START), "_role", F.lit("\n"), "_text", F.lit(END)).alias("part"),
                    "_start", (F.col("_start") + F.length("_text")).alias("_end"), "_learn")
    grouped = rows.groupBy("conv_id", "leaf", "branch", "score").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return grouped.select(
        "conv_id", "leaf", "branch", "score",
        F.array_join(F.transform("_turns", lambda t: t["part"]), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["_learn"]), lambda t: F.struct(t["_start"].alias("start"), t["_end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(_unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != ""), turn)


def chains(conversations: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as trees without branches: each turn answers the one before.

    Rows of one turn follow each other by role and text; repeated rows are turns of their own.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return conversations.select("conv_id", place.alias("node_id"), "role", "text").select(
        "conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what can be read back from ``formatted`` and ``loss_spans``."""
    turns = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = formatted.withColumns({"_turns": read_back(F.col("formatted")), "_loss": F.array_join(under, "")})
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
