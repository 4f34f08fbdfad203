"""Array and sequence operators: padding, masks, positions, packing audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import scan, seq
from rewardloom.plans.scale import gather_lists, keyed_join, with_group_stats


def pad_to_length(values: Column | str, size: int, filler: Column, left: bool = False) -> Column:
    """Pad to a size; a longer array is left as it is."""
    return seq.pad(F.col(values) if isinstance(values, str) else values, size, filler, left)


def truncate(values: Column | str, size: int, how: str = "right") -> Column:
    """Cut to a size: keep the head (right), the tail (left), both ends (middle), or fail (error)."""
    v = F.col(values) if isinstance(values, str) else values
    n = F.size(v)
    if how == "right":
        return F.slice(v, F.lit(1), F.lit(size))
    tail = lambda k: F.when(n > k, F.slice(v, n - k + 1, F.lit(k))).otherwise(v)
    if how == "left":
        return tail(size)
    if how == "middle":
        head = size // 2
        both = F.concat(F.slice(v, F.lit(1), F.lit(head)), F.slice(v, n - (size - head) + 1, F.lit(size - head)))
        return F.when(n > size, both).otherwise(v)
    if how == "error":
        return F.when(n <= size, v).otherwise(F.raise_error(F.concat(F.lit("sequence too long: "), n.cast("string"))))
    raise ValueError(f"unknown truncation: {how}")


def strip_padding(values: str, mask: str) -> Column:
    """Values where the mask is set."""
    kept = F.filter(seq.zipped(values, mask), lambda e: e[mask] != 0)
    return F.transform(kept, lambda e: e[values])


def position_ids(mask: str) -> Column:
    """max(running count of the mask - 1, 0)."""
    counts = scan.prefix_sum(F.transform(F.col(mask), lambda m: m.cast("double")))
    return F.transform(counts, lambda c: F.greatest(c.cast("int") - 1, F.lit(0)))


def sft_loss_mask(prompt_len: Column, response_len: Column) -> Column:
    """Zeros over the prompt but its last token, ones over the response but its last token."""
    zeros = F.array_repeat(F.lit(0), F.greatest(prompt_len - 1, F.lit(0)).cast("int"))
    ones = F.array_repeat(F.lit(1), (response_len - F.when(prompt_len > 0, 0).otherwise(1)).cast("int"))
    return F.concat(zeros, ones, F.array(F.lit(0)))


def multiturn_loss_mask(turns: Column) -> Column:
    """From turns (role, len, header): assistant tokens after their header are 1."""

    def one(t: Column) -> Column:
        own = t["role"] == "assistant"
        head = F.when(own, F.least(t["header"], t["len"])).otherwise(t["len"]).cast("int")
        return F.concat(F.array_repeat(F.lit(0), head), F.array_repeat(F.lit(1), t["len"].cast("int") - head))

    return F.flatten(F.transform(turns, one))


def marker_loss_mask(ids: str, start: int, assistant: int, end: int, header: int = 2) -> Column:
    """Ones from after each assistant opening through its end marker; an opening without end gives none."""
    mask = scan.marker_spans(F.transform(F.col(ids), lambda i: i.cast("double")), start, assistant, end, header)
    return F.transform(mask, lambda m: m.cast("int"))


def safe_truncate(ids: str, size: int, image_token: int) -> Column:
    """Head of the sequence, or null when that would cut an image token."""
    flags = F.transform(F.col(ids), lambda i: (i == image_token).cast("int"))
    last = F.array_position(F.reverse(flags), 1).cast("int")
    last_image = F.when(last == 0, 0).otherwise(F.size(ids) - last + 1)
    return F.when(F.size(ids) <= size, F.col(ids)).when(last_image <= size, F.slice(ids, F.lit(1), F.lit(size)))


def collate_pad(df: DataFrame, batch: str, columns: dict[str, Column], left: bool = False) -> DataFrame:
    """Pad the arrays of each batch to its longest row; widths come from one small aggregate."""
    out = with_group_stats(df, [batch], *[F.max(F.size(c)).alias(f"__w_{c}") for c in columns])
    out = out.withColumns({c: seq.pad(F.col(c), F.col(f"__w_{c}"), filler, left) for c, filler in columns.items()})
    return out.drop(*[f"__w_{c}" for c in columns])


def pair_sequences(prompt: str, chosen: str, rejected: str, size: int, eos: int, pad: int) -> Column:
    """Chosen and rejected continuations with end token, clipped or padded to one size, with masks."""

    def one(response: str) -> Column:
        ids = F.concat(F.col(prompt), F.col(response), F.array(F.lit(eos)))
        cut = F.slice(ids, F.lit(1), F.lit(size))
        return F.struct(seq.pad(cut, size, F.lit(pad)).alias("input_ids"),
                        seq.pad(F.transform(cut, lambda i: F.lit(1)), size, F.lit(0)).alias("attention_mask"))

    return F.array(one(chosen), one(rejected))


def prefix_group_rows(df: DataFrame, uid: str, order: str, prompt: str, response: str, limit: int = 1024) -> DataFrame:
    """Shared prompt once, then every response of the group; positions restart after the prompt.

    A group with more than ``limit`` responses gives several rows, each with the prompt.
    """
    lists = gather_lists(df, [uid], [order], F.col(response), "suffixes", limit)
    prompts = df.groupBy(uid).agg(F.min_by(prompt, order).alias("prefix"))
    out = keyed_join(lists, prompts, [uid])
    size = F.size("prefix")
    count_up = lambda first, n: F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))
    positions = F.concat(F.array(count_up(F.lit(0), size)), F.transform("suffixes", lambda s: count_up(size, F.size(s))))
    return out.select(
        uid, "segment", F.concat("prefix", F.flatten("suffixes")).alias("input_ids"), F.flatten(positions).alias("position_ids"),
        size.alias("prefix_len"), F.transform("suffixes", F.size).alias("suffix_lens"),
    )


def packed_eos_audit(members: DataFrame, ids: str, mask: str, eos: int, lookback: int = 100, by: Sequence[str] = ()):
    """End tokens of packed members (one row each): supervised, missed after supervised text, or not the assistant's."""
    window = F.struct(F.col(ids).alias("ids"), F.col(mask).alias("mask"))
    near = scan.window_any(F.transform(F.col(mask), lambda m: m.cast("double")), lookback)
    df = members.select(*by, window.alias("w"), near.alias("near"))
    tokens = df.select(*by, F.posexplode(F.arrays_zip(F.col("w.ids").alias("id"), F.col("w.mask").alias("m"), F.col("near").alias("near"))).alias("p", "e"))
    hit = F.col("e.id") == eos
    total = lambda c: F.sum(c.cast("long"))
    return tokens.groupBy(*by).agg(
        total(hit & (F.col("e.m") == 1)).alias("supervised"), total(hit & (F.col("e.m") == 0) & (F.col("e.near") > 0)).alias("missed"),
        total(hit & (F.col("e.m") == 0) & (F.col("e.near") <= 0)).alias("other"),
    )


def count_segments(mask: str) -> Column:
    """Number of contiguous runs of ones."""
    m = F.col(mask)
    shifted = F.concat(F.array(F.lit(0)), F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))))
    return F.aggregate(F.zip_with(m, shifted, lambda a, b: ((a == 1) & (b == 0)).cast("int")), F.lit(0), lambda s, x: s + x)


def loss_segments_audit(df: DataFrame, mask: str, turns: str, by: Sequence[str] = ()) -> DataFrame:
    """Mask runs against assistant turns, and the share of supervised tokens."""
    rows = df.select(*by, count_segments(mask).alias("seg"), F.col(turns).alias("turns"), seq.mask_count(mask).alias("on"), F.size(mask).alias("n"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("seg") == F.col("turns")).cast("long")).alias("matching"),
        F.sum("seg").alias("segments"), F.sum("turns").cast("long").alias("assistant_turns"), (F.sum("on") / F.sum("n")).alias("supervised_ratio"),
    )


def kl_token_mask(members: str = "members") -> Column:
    """Ones over packed members without a view type."""
    return F.flatten(F.transform(F.col(members), lambda m: F.array_repeat(
        F.when(m["has_view_type"], 0).otherwise(1), m["len"].cast("int"))))


def to_jagged(df: DataFrame, columns: Sequence[str], mask: str) -> DataFrame:
    """Drop padding from the token columns."""
    stripped = {c: strip_padding(c, mask) for c in columns}
    return df.withColumns(stripped)


def response_window(values: str, response_len: Column, width: int, filler: Column) -> Column:
    """The last ``response_len`` values, padded to the response width."""
    n = F.size(values)
    return seq.pad(F.slice(values, (n - response_len + 1).cast("int"), response_len.cast("int")), width, filler)


def assemble_turns(df: DataFrame, conv: str, turn: str, role: str, ids: str, max_len: int, turn_limit: int = 10_000) -> DataFrame:
    """Turns to one token row: generated turns have mask 1, tool and user turns 0; cut at the limit."""
    lists = gather_lists(df, [conv], [turn], F.struct(role, F.col(ids).alias("ids")), "__t", turn_limit)
    own = lambda t: F.when(t[role] == "assistant", 1).otherwise(0)
    mask = F.flatten(F.transform("__t", lambda t: F.array_repeat(own(t), F.size(t["ids"]))))
    return lists.select(
        conv, "segment", F.slice(F.flatten(F.transform("__t", lambda t: t["ids"])), F.lit(1), F.lit(max_len)).alias("input_ids"),
        F.slice(mask, F.lit(1), F.lit(max_len)).alias("loss_mask"), F.size("__t").alias("num_turns"),
    )

