"""Packing sequences into fixed-size rows.

Next-fit begins every pack empty, so where a pack ends depends on where it begins and on nothing before. A shard is cut into
segments; each one tells, for every row at which a pack may begin near its head, how its last pack stands at its end. A pass over
these few numbers per segment gives every segment the state in which it begins, and segments are then packed in parallel: the
packs are those of one pass over the shard, whatever the segments. First-fit looks back at all open packs and is one
pass by nature; it streams over the sorted shard with the free room of at most ``target`` packs in a tree of maxima.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import seq
from rewardloom.plans.scale import keyed_join, rank_within, scan_in_order
from rewardloom.session import ensure_checkpoint_dir

SEGMENT_ROWS = 100_000


class Limits(NamedTuple):
    length: int
    images: int
    tokens: int


class Open(NamedTuple):
    """What the open pack holds."""

    length: int
    images: int
    tokens: int


class _Segment:
    """Running sums of a segment's rows, from which the end of any pack is a look-up."""

    def __init__(self, lengths, has_images, image_tokens, limits: Limits):
        sums = lambda x: np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))])
        flags = np.asarray(has_images, bool)
        self.length, self.images, self.tokens = sums(lengths), sums(flags), sums(image_tokens)
        self.flagged = np.flatnonzero(flags)
        self.limits, self.rows = limits, len(flags)

    def _break(self, at: int, held: Open) -> int:
        """First row from ``at`` on that does not fit a pack which holds ``held`` before it."""
        over = lambda sums, limit, have: int(np.searchsorted(sums, sums[at] + limit - have, "right")) - 1
        first = min(over(self.length, self.limits.length, held.length), over(self.tokens, self.limits.tokens, held.tokens))
        image = int(self.images[at]) + max(self.limits.images - held.images, 0)
        return max(at, min(first, int(self.flagged[image]) if image < len(self.flagged) else self.rows))

    def follow(self, start: int) -> int:
        """Where the pack after the one that begins at ``start`` begins: its first row always fits."""
        return min(self._break(start + 1, self.between(start, start + 1)), self.rows)

    def between(self, start: int, end: int) -> Open:
        return Open(*(int(x[end] - x[start]) for x in (self.length, self.images, self.tokens)))

    def starts(self, held: Open | None) -> list[int]:
        """Rows at which packs begin after an open pack (None: there is none)."""
        at = self._break(0, held) if held is not None else 0
        found = []
        while at < self.rows:
            found.append(at)
            at = self.follow(at)
        return found

    def heads(self) -> dict[str, list[int]]:
        """For each row that can be the first to break an open pack: sums before it, and the pack's stand and number at the end."""
        last = min(self.follow(0), self.rows - 1)
        known: dict[int, tuple[Open, int]] = {}
        for start in range(last + 1):
            path, at = [], start
            while at < self.rows and at not in known:
                path.append(at)
                at = self.follow(at)
            if at < self.rows:
                stand, more = known[at][0], known[at][1] + 1
            elif path:
                stand, more = self.between(path[-1], self.rows), 0
            for begin in reversed(path):
                known[begin] = stand, more
                more += 1
        ends = [known[s] for s in range(last + 1)]
        return {"at": list(range(last + 1)), "length": [e.length for e, _ in ends], "images": [e.images for e, _ in ends],
                "tokens": [e.tokens for e, _ in ends], "more": [m for _, m in ends]}


def next_fit(lengths, has_images, image_tokens, max_len: int, max_images: int, max_image_tokens: int, held: Open | None = None) -> np.ndarray:
    """Pack number per item: a new pack starts when the current one would break a limit; 0 goes on with ``held``."""
    segment = _Segment(lengths, has_images, image_tokens, Limits(max_len, max_images, max_image_tokens))
    begins = np.zeros(segment.rows, np.int64)
    begins[segment.starts(held)] = 1
    return np.cumsum(begins) - (1 if held is None else 0)


class FirstFit:
    """First open pack with room; once ``target`` packs are open, an item that fits nowhere closes them all and opens the next set."""

    def __init__(self, max_len: int, target: int):
        self.max_len, self.target = max_len, target
        self.width = 1 << max(target - 1, 0).bit_length()
        self.closed = 0
        self._clear()

    def _clear(self) -> None:
        self.open = 0
        self.most = [-1] * (2 * self.width)  # per node the most room below it; packs not open have none

    def _set(self, slot: int, room: int) -> None:
        node = slot + self.width
        self.most[node] = room
        while node > 1:
            node >>= 1
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])

    def place(self, n: int) -> int:
        """Pack number of an item of length ``n``."""
        if self.open and self.most[1] >= n:
            node = 1
            while node < self.width:
                node *= 2
                if self.most[node] < n:
                    node += 1
            slot = node - self.width
            self._set(slot, self.most[node] - n)
            return self.closed + slot
        if self.open >= self.target:
            self.closed += self.open
            self._clear()
        slot = self.open
        self.open += 1
        self._set(slot, self.max_len - n)
        return self.closed + slot


def first_fit(lengths, max_len: int, target: int) -> np.ndarray:
    """Pack number per item."""
    packs = FirstFit(max_len, target)
    return np.array([packs.place(int(n)) for n in lengths], np.int64)


def _named(shard: str, pack: Column) -> Column:
    return F.concat_ws("-", F.col(f"`{shard}`").cast("string"), pack.cast("string"))


_HEADS = "struct<at:array<long>,length:array<long>,images:array<long>,tokens:array<long>,more:array<long>>"
_SUMS = "struct<length:array<long>,images:array<long>,tokens:array<long>>"


def _entries(rows: DataFrame, shard: str, kind: str, limits: Limits) -> DataFrame:
    """(shard, __segment, pack, length, images, tokens): the open pack with which each segment but the first begins."""

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        segment = _Segment(pdf["__len"], pdf["__img"], pdf["__tok"], limits)
        heads = segment.heads()
        rows = len(heads["at"])
        return pd.DataFrame([{
            shard: pdf[shard].iloc[0], "__segment": pdf["__segment"].iloc[0], "heads": heads,
            "own": {"length": pdf["__len"].iloc[:rows].tolist(), "images": pdf["__img"].iloc[:rows].astype(int).tolist(), "tokens": pdf["__tok"].iloc[:rows].tolist()},
            "whole": segment.between(0, segment.rows)._asdict(), "rows": segment.rows,
        }])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, pack = [], None, 0
        for row in pdf.sort_values("__segment").to_dict("records"):
            if held is not None:
                out.append({shard: row[shard], "__segment": row["__segment"], "pack": pack, **held._asdict()})
            near = _Segment(row["own"]["length"], row["own"]["images"], row["own"]["tokens"], limits)
            at = near._break(0, held) if held is not None else 0
            if at >= near.rows:  # the whole segment goes on with the open pack
                held = Open(*(a + int(row["whole"][c]) for a, c in zip(held, Open._fields, strict=True)))
                continue
            heads = row["heads"]
            pack += int(heads["more"][at]) + (0 if held is None else 1)
            held = Open(*(int(heads[c][at]) for c in Open._fields))
        return pd.DataFrame(out, columns=[shard, "__segment", "pack", *Open._fields])

    summary = rows.groupBy(shard, "__segment").applyInPandas(
        summarise, f"`{shard}` {kind}, __segment int, heads {_HEADS}, own {_SUMS}, whole struct<length:long,images:long,tokens:long>, rows long")
    return summary.groupBy(shard).applyInPandas(chain, f"`{shard}` {kind}, __segment int, pack long, length long, images long, tokens long")


def pack_sorted(
    df: DataFrame, shard: str, row: str, length: str, max_len: int, has_images: Column | None = None,
    image_tokens: Column | None = None, max_images: int = 3, max_image_tokens: int = 10_000, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """(shard, row, pack_id, place): next-fit over the shard's rows from short to long.

    Lengths are not negative; a row longer than ``max_len`` has a pack of its own. ``segment_rows`` bounds a task and changes no pack.
    """
    kinds = dict(df.dtypes)
    limits = Limits(max_len, max_images, max_image_tokens)
    rows = df.select(shard, row, F.col(length).cast("long").alias("__len"), F.coalesce(has_images if has_images is not None else F.lit(False), F.lit(False)).alias("__img"),
                     F.coalesce((image_tokens if image_tokens is not None else F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("__tok"))
    ranked = rank_within(rows, [shard], ["__len", row], "__i").withColumn("__segment", F.floor(F.col("__i") / segment_rows).cast("int"))
    largest = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    fields = "pack long, length long, images long, tokens long"
    if largest <= segment_rows:
        ready = ranked.withColumns({f.split()[0]: F.lit(None).cast("long") for f in fields.split(", ")})
    else:
        ensure_checkpoint_dir(df.sparkSession)
        ranked = ranked.checkpoint()
        ready = keyed_join(ranked, _entries(ranked, shard, kinds[shard], limits), [shard, "__segment"], "left")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        first = pdf.iloc[0]
        held = None if pd.isna(first["pack"]) else Open(int(first["length"]), int(first["images"]), int(first["tokens"]))
        packs = next_fit(pdf["__len"], pdf["__img"], pdf["__tok"], *limits, held) + (0 if held is None else int(first["pack"]))
        return pd.DataFrame({shard: pdf[shard], row: pdf[row], "__pack": packs, "place": pdf["__i"]})

    out = ready.groupBy(shard, "__segment").applyInPandas(assign, f"`{shard}` {kinds[shard]}, `{row}` {kinds[row]}, __pack long, place long")
    return out.select(shard, row, _named(shard, F.col("__pack")).alias("pack_id"), "place")


def pack_first_fit(df: DataFrame, shard: str, row: str, length: str, max_len: int, target: int = 256) -> DataFrame:
    """(shard, row, pack_id, place): first-fit over the shard's rows in arrival order."""
    rows = df.select(shard, row, F.col(length).cast("long").alias("__len"))

    def start():
        packs, seen = FirstFit(max_len, target), 0

        def assign(batch):
            nonlocal seen
            found = [{"pack": packs.place(n), "place": seen + i} for i, n in enumerate(batch.column("__len").to_pylist())]
            seen += len(found)
            return pa.array(found, pa.struct([("pack", pa.int64()), ("place", pa.int64())]))

        return assign

    out = scan_in_order(rows, shard, [row], start, "__p struct<pack:long,place:long>")
    return out.select(shard, row, _named(shard, F.col("__p.pack")).alias("pack_id"), F.col("__p.place").alias("place"))


def build_packs(assigned: DataFrame, ids: str, mask: str, row: str, pad_to: int | None = None, pad_id: int = 0) -> DataFrame:
    """PACKS rows: concatenated ids and masks, positions restarting per member, offsets; a pack
    holds at most the packed length."""
    item = F.struct("place", F.col(row).alias("row_idx"), F.col(ids).alias("ids"), F.col(mask).alias("mask"))
    packs = assigned.groupBy("pack_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    lens = F.transform("m", lambda m: F.size(m["ids"]))
    start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all"))
    offsets = F.aggregate(lens, start, lambda a, n: F.struct(
        (a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")), lambda a: a["all"])
    count_up = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = packs.select(
        "pack_id", offsets.alias("cu_seqlens"),
        F.transform("m", lambda m: F.struct(m["row_idx"].alias("row_idx"), F.size(m["ids"]).alias("len"))).alias("members"),
        F.flatten(F.transform("m", lambda m: m["ids"])).alias("input_ids"),
        F.flatten(F.transform("m", lambda m: m["mask"])).alias("loss_mask"),
        F.flatten(F.transform("m", lambda m: count_up(F.size(m["ids"])))).alias("position_ids"),
    )
    if pad_to is None:
        return out
    filler = {"input_ids": F.lit(pad_id), "loss_mask": F.lit(0), "position_ids": F.lit(0)}
    return out.withColumns({c: seq.pad(F.col(c), pad_to, f) for c, f in filler.items()})


def pack_report(assigned: DataFrame, length: str, max_len: int) -> DataFrame:
    """Utilisation of packs: mean and range, three bins, members per pack."""
    packs = assigned.groupBy("pack_id").agg(F.sum(length).alias("tokens"), F.count(F.lit(1)).alias("members"))
    use = F.col("tokens") / max_len
    share = lambda c: F.avg(c.cast("double"))
    return packs.agg(
        F.count(F.lit(1)).alias("packs"), F.sum("members").alias("rows"), F.sum("tokens").cast("long").alias("tokens"), F.avg(use).alias("mean_use"),
        F.min(use).alias("min_use"), F.max(use).alias("max_use"), share(use >= 0.9).alias("high"),
        share((use >= 0.7) & (use < 0.9)).alias("medium"), share(use < 0.7).alias("low"), F.avg("members").alias("members_per_pack"),
    )
