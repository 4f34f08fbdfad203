"""Sequential scans over token arrays, vectorised across the rows of an Arrow batch.

A recurrence over tokens has no native column expression that is linear in the length
(an ``aggregate`` that appends to an array copies it), and folding costs microseconds per
token. Here only the needed arrays travel as Arrow columns; rows of similar length are laid
side by side as a matrix of bounded size and the recurrence runs once per position.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 2_000_000


def _on_matrices(fn: Callable[..., np.ndarray], lists: tuple[pa.ListArray, ...]) -> pa.Array:
    lengths = np.nan_to_num(lists[0].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flats = [x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in lists]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(int(starts[-1]))
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    i = 0
    while i < len(order):
        cells = np.arange(1, len(order) - i + 1) * lengths[order[i:]]
        rows = order[i : i + max(1, int(np.searchsorted(cells, CELLS, side="right")))]
        places = np.arange(lengths[rows[-1]])
        valid = places < lengths[rows][:, None]
        index = np.where(valid, starts[rows][:, None] + places, 0)
        result = fn(*[np.where(valid, f[index], 0.0) for f in flats])
        out[index[valid]] = result[valid]
        i += len(rows)
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))


def row_scan(fn: Callable[..., np.ndarray], *lists: pa.ListArray) -> pa.Array:
    """``fn`` over the rows of list columns of equal shape, for use inside Arrow functions."""
    return _on_matrices(fn, lists)


class Zipped:
    """Tokens of list columns side by side as ``arrays_zip`` lays them: a shorter list goes on as nulls, and a row with a null list is null.

    ``values`` and ``nulls`` have one array per column (the value of a null is any), ``row`` is the row of each token.
    """

    def __init__(self, *lists: pa.ListArray):
        own = [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) for x in lists]
        self.known = ~np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in lists])
        self.lengths = np.where(self.known, np.maximum.reduce(own), 0)
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.values, self.nulls = [], []
        for x, sizes in zip(lists, own, strict=True):
            flat = x.flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.array_equal(sizes, self.lengths):
                place = self.place()
                # One null behind the tokens stands for those a shorter list lacks.
                at = np.where(place < sizes[self.row], (np.cumsum(sizes) - sizes)[self.row] + place, len(value))
                value, null = np.append(value, 0.0)[at], np.append(null, True)[at]
            self.values.append(value)
            self.nulls.append(null)

    def place(self) -> np.ndarray:
        """Position of each token in its row."""
        return np.arange(len(self.row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def lists(self, values: np.ndarray, null: np.ndarray | None = None, kind: pa.DataType | None = None) -> pa.Array:
        """One value per token, as lists."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int32))
        entries = pa.array(values, mask=null)
        return pa.ListArray.from_arrays(offsets, entries if kind is None else entries.cast(kind), mask=pa.array(~self.known))

    def sums(self, values: np.ndarray, null: np.ndarray) -> pa.Array:
        """Sum per row in the order of tokens; null where a token is."""
        total = np.bincount(self.row, np.where(null, 0.0, values), minlength=len(self.lengths))
        gone = ~self.known | (np.bincount(self.row, null, minlength=len(self.lengths)) > 0)
        return pa.array(total, mask=gone)


def masked_sums(z: Zipped, values: np.ndarray, null: np.ndarray) -> pa.Array:
    """Sum per row over the tokens whose mask, the last of the zipped arrays, is set."""
    on = (z.values[-1] != 0) & ~z.nulls[-1]
    return z.sums(np.where(on, values * z.values[-1], 0.0), null & on)


def total(values: Column | str) -> Column:
    """Sum of an array; null where an entry is."""

    def run(v: pa.Array) -> pa.Array:
        z = Zipped(v)
        return z.sums(z.values[0], z.nulls[0])

    return F.arrow_udf(lambda v: run(v), "double")(values)


def _column(fn: Callable[..., np.ndarray], *arrays: Column | str) -> Column:
    def run(*lists: pa.Array) -> pa.Array:
        return _on_matrices(fn, lists)

    # The number of arguments is read from the signature, so it has to be spelled out.
    shapes = {
        1: lambda a: run(a),
        2: lambda a, b: run(a, b),
        3: lambda a, b, c: run(a, b, c),
    }
    return F.arrow_udf(shapes[len(arrays)], "array<double>")(*arrays)


def _masked(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask != 0, values * mask, 0.0)


def prefix_sum(values: Column | str) -> Column:
    """Inclusive running sum of an array."""
    return _column(lambda v: np.cumsum(v, axis=1), values)


def suffix_sum(values: Column | str, mask: Column | str) -> Column:
    """Reward-to-go: masked sum from each position to the end."""
    return _column(lambda v, m: np.cumsum(_masked(v, m)[:, ::-1], axis=1)[:, ::-1], values, mask)


def discounted_returns(rewards: Column | str, mask: Column | str, gamma: float) -> Column:
    """Right-to-left discounted return; a masked token hands nothing to the token before it."""

    def run(r: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, carry = np.empty_like(r), np.zeros(len(r))
        for t in range(r.shape[1] - 1, -1, -1):
            out[:, t] = r[:, t] + gamma * carry
            carry = out[:, t] * m[:, t]
        return out

    return _column(run, rewards, mask)


def generalized_advantages(
    rewards: Column | str, values: Column | str, mask: Column | str, gamma: float, lam: float
) -> Column:
    """Right-to-left temporal-difference trace; masked tokens hand value and trace through unchanged."""

    def run(r: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, after, trace = np.empty_like(r), np.zeros(len(r)), np.zeros(len(r))
        for t in range(r.shape[1] - 1, -1, -1):
            on = m[:, t] != 0
            delta = r[:, t] + gamma * after - v[:, t]
            trace = np.where(on, delta + gamma * lam * trace, trace)
            after = np.where(on, v[:, t], after)
            out[:, t] = trace
        return out

    return _column(run, rewards, values, mask)


def marker_spans(ids: Column | str, start: int, assistant: int, end: int, header: int) -> Column:
    """1 from ``header`` tokens after a (start, assistant) pair through the next end token."""

    def run(x: np.ndarray) -> np.ndarray:
        width = x.shape[1]
        at = np.arange(width)
        opens = np.zeros(x.shape, dtype=bool)
        opens[:, :-1] = (x[:, :-1] == start) & (x[:, 1:] == assistant)
        first = np.full(x.shape, -1)
        if width > header:
            first[:, header:] = np.where(opens[:, : width - header], at[header:], -1)
        opened = np.maximum.accumulate(first, axis=1)
        ends = x == end
        closed = np.full(x.shape, -1)
        closed[:, 1:] = np.maximum.accumulate(np.where(ends, at, -1), axis=1)[:, :-1]
        ahead = np.minimum.accumulate(np.where(ends, at, width)[:, ::-1], axis=1)[:, ::-1]
        inside = (opened >= 0) & (opened > closed) & (ahead < width)
        # A span that would hold only its end marker is empty.
        return (inside & (ahead > opened)).astype(np.float64)

    return _column(run, ids)


def window_any(flags: Column | str, size: int) -> Column:
    """Number of set flags among the ``size`` entries before each position."""

    def run(m: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((len(m), 1)), np.cumsum(m != 0, axis=1)], axis=1)
        at = np.arange(m.shape[1])
        return (total[:, at] - total[:, np.maximum(at - size, 0)]).astype(np.float64)

    return _column(run, flags)
