"""Building blocks that keep one huge group or one huge table out of a single task.

* ``with_group_stats`` aggregates a group once (partial aggregation before the
  shuffle) and joins the small result back, so a hot key is only ever a skewed
  join side, which AQE splits.
* ``rank_within`` / ``running_total`` number or accumulate rows with a window per
  group while groups are small. Where one is not, the sort order is cut into key
  ranges; each range is one window partition and the totals of earlier ranges are
  added from a table with at most one row per range.
* ``with_scalars`` attaches a one-row aggregate as constants, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions.bind import let

ROWS_PER_RANGE = 250_000
MAX_RANGES = 16_384
SAMPLES_PER_RANGE = 20

Order = Sequence[str]


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as constants (scalar subqueries, not a join).

    They are ordinary columns afterwards, so array lambdas may use them.
    """
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s"))
    held = df.withColumn("__scalars", packed.scalar())
    return held.withColumns({c: F.col("__scalars")[c] for c in one_row.columns}).drop("__scalars")


def key_of(keys: Sequence[str]) -> Column:
    """Key columns as one value that is never null: structs are equal where their fields are, nulls included."""
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left join on equal keys where null equals null, as in ``groupBy``: no row is lost for want of a key."""
    other = right.select(key_of(keys).alias("__right"), *[f"`{c}`" for c in right.columns if c not in keys])
    return _on_key(left, other, keys, how)


def _on_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    joined = left.withColumn("__left", key_of(keys)).join(right, F.col("__left") == F.col("__right"), how)
    return joined.select(*[f"`{k}`" for k in keys], *[f"`{c}`" for c in joined.columns if c not in keys and c not in ("__left", "__right")])


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach aggregates of each key group to every row of the group; rows with a null key are a group.

    Groups and join share one key, so the aggregate is joined where its shuffle has left it.
    """
    return _on_key(df, df.groupBy(key_of(keys).alias("__right")).agg(*aggs), keys, "inner")


def _parse(order: Order) -> list[tuple[str, bool]]:
    parsed = []
    for item in order:
        name, _, direction = item.partition(" ")
        parsed.append((name, direction.strip().lower() == "desc"))
    return parsed


def _sort_columns(order: Order) -> list[Column]:
    return [F.col(n).desc() if d else F.col(n).asc() for n, d in _parse(order)]


def _position(keys: Sequence[str], order: Order) -> Column:
    """The values that place a row, keys first."""
    return F.struct(*[F.col(n).alias(f"p{i}") for i, (n, _) in enumerate(_fields(keys, order))])


def _fields(keys: Sequence[str], order: Order) -> list[tuple[str, bool]]:
    return [(k, False) for k in keys] + _parse(order)


def _cut_points(df: DataFrame, keys: Sequence[str], order: Order, ranges: int, rows: int) -> tuple[int, str]:
    """Up to ``ranges - 1`` quantiles of the sort position, from a bounded sample, in the order of the rows.

    The sample only decides where ranges begin; every row is still ranked.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    sample = df.select(_position(keys, order).alias("p"))
    if wanted < rows:
        sample = sample.where(F.rand(17) < wanted / rows)
    sort = [F.col(f"p.p{i}").desc() if d else F.col(f"p.p{i}").asc() for i, (_, d) in enumerate(_fields(keys, order))]
    ordered = sample.select("p", F.row_number().over(Window.orderBy(*sort)).alias("i"))
    picked = ordered.where(F.col("i") % SAMPLES_PER_RANGE == 0)
    packed = picked.agg(F.count("i").alias("n"), F.array_sort(F.collect_list(F.struct("i", "p"))).alias("l"))
    row = packed.select("n", F.to_json(F.transform("l", lambda x: x["p"])).alias("json")).first()
    return row.n, row.json


def _at_or_below(edge: Column, place: Column, fields: list[tuple[str, bool]]) -> Column:
    """Whether ``edge`` sorts no later than ``place``: nulls first and NaN last, the other way round where descending."""
    below = F.lit(True)
    for i in range(len(fields) - 1, -1, -1):
        a, b = (place, edge) if fields[i][1] else (edge, place)
        a, b = a[f"p{i}"], b[f"p{i}"]
        less = F.when(a.isNull(), b.isNotNull()).when(b.isNull(), F.lit(False)).otherwise(a < b)
        below = less | (a.eqNullSafe(b) & below)
    return below


def _range_id(df: DataFrame, keys: Sequence[str], order: Order, count: int, json: str) -> Column:
    """Number of cut points at or below the row's position, by binary search."""
    kind = df.select(_position(keys, order).alias("p")).schema["p"].dataType
    edges = F.from_json(F.lit(json), f"array<{kind.simpleString()}>")
    steps = math.ceil(math.log2(count + 1)) + 1
    fields = _fields(keys, order)

    def halve(state: Column, _: Column) -> Column:
        # The cut points stand in the expression once: each further mention would be a copy of all of them.
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        step = let(mid, lambda m: let(F.get(edges, m), lambda edge: F.struct(
            m.alias("mid"), ((state["lo"] < state["hi"]) & _at_or_below(edge, F.col("__pos"), fields)).alias("below"))))
        return let(step, lambda x: F.struct(
            F.when(x["below"], x["mid"] + 1).otherwise(state["lo"]).alias("lo"),
            F.when(x["below"], state["hi"]).otherwise(x["mid"]).alias("hi"),
        ))

    start = F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), steps), start, halve, lambda s: s["lo"])


# Kinds whose order Arrow and numpy know as Spark does.
_PLAIN = {"tinyint", "smallint", "int", "bigint", "float", "double", "string", "binary", "date", "timestamp", "boolean"}


def _plain(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as numpy compares them, and which are null (their value is any)."""
    null = values.is_null().to_numpy(zero_copy_only=False)
    kind = values.type
    if pa.types.is_date(kind) or pa.types.is_timestamp(kind):
        values = values.cast(pa.int32() if pa.types.is_date32(kind) else pa.int64())
    elif pa.types.is_boolean(kind):
        values = values.cast(pa.int8())
    text = pa.types.is_string(kind) or pa.types.is_large_string(kind)
    blank = "" if text else b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else 0
    return pc.fill_null(values, pa.scalar(blank, values.type)).to_numpy(zero_copy_only=False), null


class _Steps:
    """Places of values among the known ones: odd at a known one, even between two; nulls first and NaN last, or all reversed."""

    def __init__(self, known: pa.Array, falling: bool):
        values, null = _plain(known)
        keep = ~null & (values == values)
        self.known, self.falling = np.unique(values[keep]), falling
        self.size = 2 * len(self.known) + 3

    def __call__(self, array: pa.Array) -> np.ndarray:
        values, null = _plain(array)
        code = np.where(null, 0, np.where(values == values, 1 + _step(self.known, values), self.size - 1))
        return self.size - 1 - code if self.falling else code


def _step(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    if not len(known):
        return at
    return 2 * at + (known[np.minimum(at, len(known) - 1)] == values)


def _ranges_of(edges: list[pa.Array], fields: list[tuple[str, bool]]) -> Callable[[pa.Array], pa.Array]:
    """Number of edges at or below each position (a struct); the edges are in order, field by field."""
    steps, prefixes = [], []
    place = np.zeros(len(edges[0]), np.int64)
    for known, (_, falling) in zip(edges, fields, strict=True):
        steps.append(_Steps(known, falling))
        place = place * steps[-1].size + steps[-1](known)
        prefixes.append(np.unique(place))
        place = _step(prefixes[-1], place)
    last = place

    def run(positions: pa.Array) -> pa.Array:
        place = np.zeros(len(positions), np.int64)
        for values, step, prefix in zip(positions.flatten(), steps, prefixes, strict=True):
            place = _step(prefix, place * step.size + step(values))
        return pa.array(np.searchsorted(last, place, side="right").astype(np.int32))

    return run


def _range_number(df: DataFrame, keys: Sequence[str], order: Order, count: int, json: str) -> Column:
    """``_range_id`` for a batch at a time, where numpy knows the order of all columns."""
    kind = df.select(_position(keys, order).alias("p")).schema["p"].dataType
    if not count or any(f.dataType.simpleString() not in _PLAIN for f in kind.fields):
        return _range_id(df, keys, order, count, json)
    edges = df.sparkSession.range(1).select(F.from_json(F.lit(json), f"array<{kind.simpleString()}>").alias("e"))
    known = edges.select(F.explode("e").alias("p")).select("p.*").toArrow().combine_chunks()
    run = _ranges_of([known.column(i).combine_chunks() for i in range(known.num_columns)], _fields(keys, order))
    return F.arrow_udf(lambda positions: run(positions), "int")(F.col("__pos"))


def _accumulate(df, keys, order, name, per_row, total, rows, rows_per_range, over=F.sum, merge=None, largest=None) -> DataFrame:
    """Shared body: a plain window while every group is small, else a window inside a range
    merged (by default added) with what ``over`` makes of the totals of earlier ranges. Group sizes come from one narrow aggregate."""
    merge = merge or (lambda own, before: own + F.coalesce(before, F.lit(0)))
    sort = _sort_columns(order)
    measure = rows is None or (keys and rows > rows_per_range and largest is None)
    largest = rows if largest is None else largest
    if measure:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
        largest, rows = sizes.largest or 0, sizes.rows or 0
    if largest <= rows_per_range:
        return df.withColumn(name, per_row(Window.partitionBy(*keys).orderBy(*sort)))
    ranges = min(MAX_RANGES, math.ceil(rows / rows_per_range))
    count, cuts = _cut_points(df, keys, order, ranges, rows)
    marked = df.withColumn("__pos", _position(keys, order))
    marked = marked.withColumn("__range", _range_number(df, keys, order, count, cuts))
    marked = marked.drop("__pos")
    sizes = marked.groupBy("__range", *keys).agg(total.alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # A range can continue at most one key from the range before it, so this has one row per range.
    carried = sizes.withColumn("__carry", over("__size").over(earlier)).where(F.col("__carry").isNotNull())
    carried = carried.select("__range", F.struct(*keys, F.lit(0).alias("__z")).alias("__carry_key"), "__carry")
    inside = marked.withColumn(name, per_row(Window.partitionBy("__range", *keys).orderBy(*sort)))
    own_key = F.struct(*keys, F.lit(0).alias("__z"))
    joined = inside.join(F.broadcast(carried), "__range", "left")
    carry = F.when(F.col("__carry_key").eqNullSafe(own_key), F.col("__carry"))
    return joined.withColumn(name, merge(F.col(name), carry)).drop("__range", "__carry_key", "__carry")


def largest_at_most(df: DataFrame, keys: Sequence[str], enough: int = ROWS_PER_RANGE, buckets: int = 16_384) -> tuple[int, int]:
    """A bound on the rows of the largest group, and the number of all rows.

    Groups are counted together in hashed buckets: no group is larger than its bucket, and a row per bucket and task is shuffled in place of
    one per group. Only where a bucket holds more than ``enough`` are the groups themselves counted.
    """
    largest, rows = 0, 0
    for group in ([F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")], list(keys)):
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
        largest, rows = sizes.largest or 0, sizes.rows or 0
        if largest <= enough:
            break
    return largest, rows


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    name: str,
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    largest: int | None = None,
) -> DataFrame:
    """Zero-based position of each row inside its key group (no keys: in the table).

    ``order`` holds column names, each optionally followed by `` desc``; together
    with the keys it must be unique. A known number of ``rows`` saves counting a small table, with the size of the ``largest`` group
    any table.
    """
    number = lambda w: (F.row_number().over(w) - 1).cast("long")
    return _accumulate(df, list(keys), order, name, number, F.count(F.lit(1)), rows, rows_per_range, largest=largest)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: Column,
    name: str,
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Inclusive running sum of ``value`` in the order of the group."""
    df = df.withColumn("__value", value)
    frame = (Window.unboundedPreceding, Window.currentRow)
    add = lambda w: F.sum("__value").over(w.rowsBetween(*frame))
    out = _accumulate(df, list(keys), order, name, add, F.sum("__value"), rows, rows_per_range)
    return out.drop("__value")


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, rows: int | None = None, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The last value that is not null at or before each row, in rising ``order`` inside the key group."""
    df = df.withColumn("__value", value)
    last = lambda c: F.last(c, ignorenulls=True)
    frame = (Window.unboundedPreceding, Window.currentRow)
    total = F.max_by(F.col("__value"), F.when(F.col("__value").isNotNull(), _position([], order)))
    out = _accumulate(df, list(keys), order, name, lambda w: last("__value").over(w.rowsBetween(*frame)), total, rows, rows_per_range, last, F.coalesce)
    return out.drop("__value")


def top_k(df: DataFrame, keys: Sequence[str], order: Order, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k per group and task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*_sort_columns(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


DIRECT_LIMIT = 10_000
SELECT_SAMPLE = 400_000
SELECT_ROWS = 1_000_000


def _before(place: Column, edge: Column, fields: list[tuple[str, bool]]) -> Column:
    return ~_at_or_below(edge, place, fields)


def _bracket(narrow: DataFrame, order: Order, n: int, rows: int) -> list[str | None]:
    """Two sample positions between which the n-th row most likely lies, as JSON; none where the sample ends before."""
    share = min(1.0, SELECT_SAMPLE / rows)
    at, spread = n * share, 5 * math.sqrt(n * share * max(1 - n / rows, 0)) + 10
    ends = [math.floor(at - spread), math.ceil(at + spread)]
    sort = [F.col(f"p.p{i}").desc() if d else F.col(f"p.p{i}").asc() for i, (_, d) in enumerate(_parse(order))]
    sample = narrow.where(F.rand(17) < share).select(_position([], order).alias("p"))
    picked = sample.select("p", F.row_number().over(Window.orderBy(*sort)).alias("i")).where(F.col("i").isin(ends))
    found = {r.i: r.json for r in picked.select("i", F.to_json("p").alias("json")).collect()}
    return [found.get(i) for i in ends]


def _selected(narrow: DataFrame, order: Order, n: int, rows: int | None) -> tuple[DataFrame, int, int]:
    """Rows in some interval of the order with the wanted one, its number there, and how many they are.

    A sample proposes the interval, one count of all rows tells what lies before and inside it, and so on inside until it is short. No
    row is shuffled or numbered.
    """
    place, fields = _position([], order), _parse(order)
    kind = narrow.select(place.alias("p")).schema["p"].dataType.simpleString()
    rows = narrow.count() if rows is None else rows
    inside = narrow
    while rows > SELECT_ROWS:
        low, high = (None if e is None else F.from_json(F.lit(e), kind) for e in _bracket(inside, order, min(n, rows), rows))
        early = F.lit(False) if low is None else _before(place, low, fields)
        late = F.lit(False) if high is None else _before(high, place, fields)
        counts = inside.agg(F.count_if(early).alias("early"), F.count_if(late).alias("late"), F.count(F.lit(1)).alias("rows")).first()
        n = min(n, counts.rows)
        if n <= counts.early:
            inside, left = inside.where(early), counts.early
        elif n > counts.rows - counts.late:
            inside, n, left = inside.where(late), n - (counts.rows - counts.late), counts.late
        else:
            inside, n, left = inside.where(~early & ~late), n - counts.early, counts.rows - counts.early - counts.late
        stuck, rows = left > counts.rows / 2, left
        if stuck:
            break  # equal positions, which no edge divides
    return inside, n, rows


def nth_row(df: DataFrame, order: Order, n: int, rows: int | None = None) -> DataFrame:
    """One row: the order columns of the n-th row (from 1), or of the last row when there are fewer.

    A short prefix is found by a per-task top-n; a long one inside an interval that holds it. About how many ``rows`` there are
    saves a count.
    """
    names = [name for name, _ in _parse(order)]
    narrow = df.select(*names)
    falling = [F.col(c).asc() if d else F.col(c).desc() for c, d in _parse(order)]
    if n > DIRECT_LIMIT:
        narrow, n, rows = _selected(narrow, order, n, rows)
    if n > DIRECT_LIMIT and rows > SELECT_ROWS:
        ranked = rank_within(narrow, [], order, "__n", rows=rows).where(F.col("__n") < n)
        return ranked.orderBy(F.col("__n").desc()).limit(1).drop("__n")
    return narrow.orderBy(*_sort_columns(order)).limit(n).orderBy(*falling).limit(1)


def first_rows(df: DataFrame, order: Order, n: int) -> DataFrame:
    """The first ``n`` rows in an order without ties, in any number: rows no later than the n-th one, filtered where they lie."""
    if n <= 0:
        return df.limit(0)
    names = [name for name, _ in _parse(order)]
    fields = _parse(order)
    place = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(names)])
    last = nth_row(df, order, n).select(F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(names)]).alias("__last"))
    return with_scalars(df, last).where(_at_or_below(place, F.col("__last"), fields)).drop("__last")


def seeded_key(seed: int, *cols: str | Column) -> Column:
    """Reproducible pseudo-random sort key; a digest, so any engine can recompute it."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def unit_draw(seed: int, *cols: str | Column) -> Column:
    """Reproducible uniform number in [0, 1) per row: 52 bits of the seeded digest."""
    digits = F.substring(seeded_key(seed, *cols), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def run_edges(column: pa.Array) -> list[int]:
    """Where runs of equal values begin, and the length; nulls are equal, and so are NaNs."""
    code = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]


def scan_in_order(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], Callable[[pa.RecordBatch], Any]], added: str) -> DataFrame:
    """Adds a column (``name type``) that a sequential rule gives to the rows of each key in turn.

    ``start`` begins a key; what it returns gets the key's rows batch by batch, in order, and gives one value per row. Only the
    rule's own state outlives a batch, so a key of any size costs time, not memory; null is a key.
    """
    name = added.split()[0]
    schema = ", ".join(f"`{c}` {t}" for c, t in [(key, dict(df.dtypes)[key]), *[(c, t) for c, t in df.dtypes if c != key]])

    def walk(batches):
        rule, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = []
            edges = run_edges(batch.column(0))
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                value = batch.column(0)[at].as_py()
                if rule is None or not (value == last or (value != value and last != last)):
                    rule, last = start(), value
                values.append(pa.array(rule(batch.slice(at, end - at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(values)], names=[*batch.schema.names, name])

    spread = df.select(key, *[c for c in df.columns if c != key]).repartition(F.col(f"`{key}`"))
    return spread.sortWithinPartitions(F.col(f"`{key}`"), *_sort_columns(order)).mapInArrow(walk, f"{schema}, {added}")


def gather_lists(
    df: DataFrame, keys: Sequence[str], order: Order, item: Column, name: str, limit: int = 10_000, rows: int | None = None
) -> DataFrame:
    """Ordered list of ``item`` per group, in segments of at most ``limit`` entries.

    A group that fits has one row with ``segment`` 0; a larger one has several rows, so
    no single row or task holds an unbounded group.
    """
    ranked = rank_within(df.withColumn("__item", item), keys, order, "__i", rows=rows)
    ranked = ranked.withColumn("segment", F.floor(F.col("__i") / limit).cast("int"))
    lists = ranked.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("__i", "__item"))).alias("__l"))
    return lists.select(*keys, "segment", F.col("__l.__item").alias(name))
