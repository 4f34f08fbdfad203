"""Baselines per group and position, from curves instead of token rows.

A batch of rows gives one partial curve per group: sums of weighted returns and of weights at each position, beside the two
longest lengths. Partial curves meet by group and add up in one streaming pass, so no token is a row of its own and a group with most
of the table is as many curves as it has batches. The finished curve goes back to the group's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.scan import row_scan, suffix_sum
from rewardloom.plans.scale import keyed_join, run_edges


def _to_go(rewards, mask):
    return np.cumsum(np.where(mask != 0, rewards * mask, 0.0)[:, ::-1], axis=1)[:, ::-1]


def _lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column; null counts as empty."""
    lengths = np.nan_to_num(array.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths


def _inside(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _positions(mask: pa.Array, compact: bool) -> np.ndarray:
    """Place of each token in its row, or its number among the valid ones."""
    if compact:
        return _lists(row_scan(lambda m: np.cumsum(m, axis=1), mask))[0].astype(np.int64) - 1
    return _inside(_lists(mask)[1])


def _add_up(code: np.ndarray, groups: int, place: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Per group, sums of values by place."""
    width = np.zeros(groups, np.int64)
    np.maximum.at(width, code, place + 1)
    ends = np.cumsum(width)
    cell = (ends - width)[code] + place
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(np.bincount(cell, v, minlength=int(ends[-1]) if groups else 0).astype(np.float64))) for v in values]


def _longest(code: np.ndarray, groups: int, first: np.ndarray, count: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Per group: greatest length, how many rows have it, greatest length below it (-1: none)."""
    top = np.full(groups, -1, np.int64)
    np.maximum.at(top, code, first)
    many = np.bincount(code, np.where(first == top[code], count, 0), minlength=groups).astype(np.int64)
    below = np.full(groups, -1, np.int64)
    for lengths in (first, second):
        np.maximum.at(below, code, np.where(lengths < top[code], lengths, -1))
    return [top, many, below]


_FIELDS = ["num", "den", "longest", "many", "second", "n"]
_PARTIAL = "num array<double>, den array<double>, longest long, many long, second long, n long"


def _partial(compact: bool, weighted: bool):
    def run(batches):
        for batch in batches:
            key, rewards, logp, squared, mask = batch.columns[:5]
            key = pc.dictionary_encode(key, null_encoding="encode")
            groups, code = len(key.dictionary), key.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            m, lengths = _lists(mask)
            proxy = 1.0 - 2.0 * np.exp(_lists(logp)[0]) + _lists(squared)[0]
            if weighted:
                proxy = proxy * _lists(batch.column(5))[0] ** 2
            proxy = np.where(m != 0, proxy * m, 0.0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            weight = _lists(row_scan(lambda p: np.cumsum(p, axis=1), pa.ListArray.from_arrays(offsets, pa.array(proxy))))[0]
            returns = _lists(row_scan(_to_go, rewards, mask))[0]
            place = _positions(mask, compact)
            on = place >= 0
            weight = np.where(m != 0, weight * m, 0.0)
            curves = _add_up(np.repeat(code, lengths)[on], groups, place[on], (returns * weight)[on], weight[on])
            valid = np.bincount(np.repeat(np.arange(len(lengths)), lengths), m, minlength=len(lengths)).astype(np.int64)
            rows = valid > 0 if compact else np.ones(len(valid), bool)
            own = code[rows]
            long = _longest(own, groups, valid[rows], np.ones(len(own), np.int64), np.full(len(own), -1))
            yield pa.record_batch([key.dictionary, *curves, *[pa.array(x) for x in long], pa.array(np.bincount(own, minlength=groups))], names=["key", *_FIELDS])

    return run


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per run of equal keys."""
    edges = run_edges(batch.column(0))
    groups = len(edges) - 1
    code = np.repeat(np.arange(groups), np.diff(edges))
    num, lengths = _lists(batch.column(1))
    curves = _add_up(np.repeat(code, lengths), groups, _inside(lengths), num, _lists(batch.column(2))[0])
    longest, many, second, n = (batch.column(c).to_numpy() for c in range(3, 7))
    long = _longest(code, groups, longest, many, second)
    return pa.record_batch([batch.column(0).take(pa.array(edges[:-1])), *curves, *[pa.array(x) for x in long], pa.array(np.bincount(code, n, minlength=groups).astype(np.int64))], names=batch.schema.names)


def _merge(eps: float):
    def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
        num, lengths = _lists(batch.column(1))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        curve = pa.ListArray.from_arrays(offsets, pa.array(num / (_lists(batch.column(2))[0] + eps)))
        lone = (batch.column("many").to_numpy() == 1) & (batch.column("second").to_numpy() >= 0)
        ends = [pa.array(np.where(lone, batch.column(c).to_numpy(), -1)) for c in ("longest", "second")]
        return pa.record_batch([batch.column(0), curve, *ends, batch.column("n")], names=["key", "curve", "longest", "second", "n"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            batch = _merged(batch)
            if batch.num_rows > 1:
                yield finished(batch.slice(0, batch.num_rows - 1))
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield finished(held)

    return run


def _advantages(compact: bool, handle_zero_tail: bool):
    def run(rewards: pa.Array, mask: pa.Array, curve: pa.Array, longest: pa.Array, second: pa.Array, n: pa.Array) -> pa.Array:
        returns, lengths = _lists(row_scan(_to_go, rewards, mask))
        m, _ = _lists(mask)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = _positions(mask, compact)
        values, widths = _lists(curve)
        number = lambda c: pc.fill_null(c, -1).to_numpy(zero_copy_only=False)
        known = (place >= 0) & (place < widths[row])
        base = np.zeros(len(m))
        base[known] = values[((np.cumsum(widths) - widths)[row] + place)[known]]
        off = number(n)[row] < 2
        if handle_zero_tail:
            valid = np.bincount(row, m, minlength=len(lengths)).astype(np.int64)
            off |= (valid == number(longest))[row] & (place >= number(second)[row])
        out = (returns - np.where(off, 0.0, base)) * m
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(out))

    # The number of arguments is read from the signature.
    return F.arrow_udf(lambda a, b, c, d, e, f: run(a, b, c, d, e, f), "array<double>")


def token_baseline(df: DataFrame, key: str, mask: str, weights: str | None, handle_zero_tail: bool, eps: float, compact: bool) -> DataFrame:
    """Adds ``returns`` and ``advantages``: per group and position the return less its mean, weighted by the accumulated score-norm proxy.

    A group of one row has no baseline; with ``handle_zero_tail`` neither do the tokens of a group's only longest row that lie past its
    second longest. ``compact`` counts positions among valid tokens only. Rows with a null key are a group.
    """
    kind = dict(df.dtypes)[key]
    names = ["rewards", "old_logp", "sum_pi_squared", mask, *([weights] if weights else [])]
    part = df.select(F.col(key).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    part = part.mapInArrow(_partial(compact, weights is not None), f"key {kind}, {_PARTIAL}")
    curves = part.repartition("key").sortWithinPartitions("key").mapInArrow(_merge(eps), f"key {kind}, curve array<double>, longest long, second long, n long")
    curves = curves.select(F.col("key").alias(key), F.struct("curve", "longest", "second", "n").alias("__group"))
    out = keyed_join(df, curves, [key], "left")
    of = lambda c: F.col(f"__group.{c}")
    advantages = _advantages(compact, handle_zero_tail)(F.col("rewards"), F.col(mask), of("curve"), of("longest"), of("second"), of("n"))
    return out.withColumns({"returns": suffix_sum("rewards", mask), "advantages": advantages}).drop("__group")
