"""Rollout-batch algebra: a batch is a DataFrame whose dense ``row_idx`` is its row order."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.plans.scale import gather_lists, key_of, rank_within, seeded_key

IDX = "row_idx"


def with_row_idx(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Number the rows of a table by a unique order."""
    return rank_within(df, [], order, IDX, rows=rows)


def size(df: DataFrame) -> int:
    return df.count()


def check_consistency(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Fails at run time on a row whose token arrays differ in length."""
    first = arrays[0]
    for other in arrays[1:]:
        same = F.size(F.col(first)) == F.size(F.col(other))
        df = df.withColumn(other, F.when(same, F.col(other)).otherwise(
            F.raise_error(F.lit(f"{first} and {other} differ in length")).cast(df.schema[other].dataType)))
    return df


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(IDX, *[c for c in columns if c != IDX])


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the rest; both keep the row order."""
    return select(df, columns), df.drop(*columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def select_mask(df: DataFrame, mask: Column, order: bool = True) -> DataFrame:
    """Rows where the mask holds, renumbered."""
    kept = df.where(mask)
    return with_row_idx(kept.withColumnRenamed(IDX, "__old"), ["__old"]).drop("__old") if order else kept


def select_idxs(df: DataFrame, picks: DataFrame) -> DataFrame:
    """Gather by a table (pos, idx): repeats and order follow ``pos``."""
    joined = picks.join(df.withColumnRenamed(IDX, "idx"), "idx")
    return joined.drop("idx").withColumnRenamed("pos", IDX)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, n: int | None = None):
    """Python slice semantics on the row order; negative bounds count from the end."""
    n = size(df) if n is None else n
    picked = range(n)[slice(start, stop, step)]
    if not len(picked):
        return df.where(F.lit(False))
    lo, hi = min(picked[0], picked[-1]), max(picked[0], picked[-1])
    i = F.col(IDX)
    kept = df.where((i >= lo) & (i <= hi) & (F.pmod(i - picked[0], F.lit(abs(step))) == 0))
    return kept.withColumn(IDX, ((i - picked[0]) / step).cast("long"))


_FILL = {"int": 0, "bigint": 0, "smallint": 0, "tinyint": 0}


def concat(frames: Sequence[DataFrame], sizes: Sequence[int] | None = None) -> DataFrame:
    """Row union in order; a missing integer column is 0, a missing float NaN, anything else null."""
    sizes = [size(f) for f in frames] if sizes is None else list(sizes)
    kinds: dict[str, str] = {}
    for f in frames:
        kinds.update({c: t for c, t in f.dtypes if c not in kinds})
    parts, base = [], 0
    for f, n in zip(frames, sizes, strict=True):
        shifted = f.withColumn(IDX, F.col(IDX) + base)
        for c, kind in kinds.items():
            if c not in f.columns:
                filler = _FILL.get(kind, float("nan") if kind in ("double", "float") else None)
                shifted = shifted.withColumn(c, F.lit(filler).cast(kind))
        parts.append(shifted.select(*kinds))
        base += n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union(df: DataFrame, other: DataFrame) -> DataFrame:
    """Column union row by row; a shared column must hold equal values."""
    shared = [c for c in other.columns if c in df.columns and c != IDX]
    right = other.withColumnsRenamed({c: f"__{c}" for c in shared})
    joined = df.join(right, IDX)
    for c in shared:
        kind = df.schema[c].dataType
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"values of {c} differ")).cast(kind)))
    return joined.drop(*[f"__{c}" for c in shared])


def union_meta(a: Mapping, b: Mapping) -> dict:
    """Merged batch-level values; a key with two values is an error."""
    for key in set(a) & set(b):
        if a[key] != b[key]:
            raise ValueError(f"meta value {key} differs")
    return {**a, **b}


def chunk(df: DataFrame, k: int, n: int | None = None, auto_pad: bool = False) -> DataFrame:
    """``chunk_id`` of k equal contiguous parts; a remainder is an error unless padding is allowed."""
    n = size(df) if n is None else n
    if n % k and not auto_pad:
        raise ValueError(f"{n} rows do not divide into {k} chunks")
    per = max(1, math.ceil(n / k))
    return df.withColumn("chunk_id", F.floor(F.col(IDX) / per).cast("int"))


def split(df: DataFrame, rows: int) -> DataFrame:
    """``split_id`` of pieces of a fixed size; the last may be short."""
    return df.withColumn("split_id", F.floor(F.col(IDX) / rows))


def split_dataset(df: DataFrame, parts: int, n: int | None = None) -> list[DataFrame]:
    """Equal datasets with their own row order; a remainder is an error."""
    n = size(df) if n is None else n
    marked = chunk(df, parts, n)
    per = n // parts
    return [marked.where(F.col("chunk_id") == p).withColumn(IDX, F.col(IDX) - p * per).drop("chunk_id") for p in range(parts)]


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """Permute rows by a table (pos, idx): row ``idx`` moves to ``pos``."""
    return select_idxs(df, permutation)


def reverse_index(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("idx").alias("pos"), F.col("pos").alias("idx"))


def restore_order(df: DataFrame, permutation: DataFrame) -> DataFrame:
    return reorder(df, reverse_index(permutation))


def repeat(df: DataFrame, times: int, interleave: bool = True, n: int | None = None) -> DataFrame:
    """Every row ``times`` times in a row, or the whole batch ``times`` times."""
    copies = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        index = F.col(IDX) * times + F.col("__k")
    else:
        index = F.col("__k") * (size(df) if n is None else n) + F.col(IDX)
    return copies.withColumn(IDX, index.cast("long")).drop("__k")


def sample_level_repeat(df: DataFrame, times: str, rows: int | None = None) -> DataFrame:
    """Each row as often as its own count says; 0 drops it."""
    kept = df.where(F.col(times) > 0)
    copies = kept.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))
    numbered = rank_within(copies.withColumnRenamed(IDX, "__old"), [], ["__old", "__k"], IDX, rows=rows)
    return numbered.drop("__k", "__old")


def unfold_column_chunks(df: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Cut array columns into n equal pieces, one row each; other columns repeat."""
    piece = lambda c: F.slice(c, (F.col("__k") * F.size(c) / n).cast("int") + 1, (F.size(c) / n).cast("int"))
    out = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = out.withColumns({c: piece(c) for c in columns})
    return out.withColumn(IDX, F.col(IDX) * n + F.col("__k")).drop("__k")


def fold(df: DataFrame, m: int) -> DataFrame:
    """m consecutive rows to one row of arrays; the group size is m by construction."""
    rest = [c for c in df.columns if c != IDX]
    packed = df.groupBy(F.floor(F.col(IDX) / m).alias("__g")).agg(F.array_sort(F.collect_list(F.struct(IDX, *rest))).alias("__l"))
    return packed.select(F.col("__g").alias(IDX), *[F.col(f"__l.{c}").alias(c) for c in rest])


def unfold(df: DataFrame, m: int) -> DataFrame:
    rest = [c for c in df.columns if c != IDX]
    rows = df.select(F.col(IDX).alias("__g"), F.posexplode(F.arrays_zip(*rest)).alias("__k", "__e"))
    return rows.select((F.col("__g") * m + F.col("__k")).alias(IDX), *[F.col(f"__e.{c}").alias(c) for c in rest])


def pad_to_divisor(df: DataFrame, divisor: int, n: int | None = None) -> DataFrame:
    """Append copies of the head rows until divisible, flagged ``is_pad``."""
    n = size(df) if n is None else n
    missing = (-n) % divisor
    base = df.withColumn("is_pad", F.lit(False))
    if not missing or not n:
        return base
    rounds = F.floor((F.lit(missing - 1) - F.col(IDX)) / n)
    copies = df.where(F.col(IDX) < missing).withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), rounds.cast("long"))))
    copies = copies.withColumn(IDX, F.lit(n) + F.col("__r") * n + F.col(IDX)).drop("__r").withColumn("is_pad", F.lit(True))
    return base.unionByName(copies)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def pad_rows(df: DataFrame, k: int, which: str = "last", n: int | None = None) -> DataFrame:
    """Append k copies of the first or last row."""
    n = size(df) if n is None else n
    source = df.where(F.col(IDX) == (0 if which == "first" else n - 1))
    copies = source.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(IDX, F.lit(n) + F.col("__k"))
    return df.unionByName(copies.drop("__k")) if k else df


def minibatches(df: DataFrame, rows: int, epochs: int, seed: int = 0, n: int | None = None) -> DataFrame:
    """Seeded shuffle per epoch, cut into mini-batches: adds (epoch, batch_id)."""
    n = size(df) if n is None else n
    if n % rows:
        raise ValueError(f"{n} rows do not divide into mini-batches of {rows}")
    every = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    every = every.withColumn("__key", seeded_key(seed, "epoch", IDX))
    ranked = rank_within(every, ["epoch"], ["__key", IDX], "__i", rows=n * epochs)
    return ranked.withColumn("batch_id", F.floor(F.col("__i") / rows)).drop("__i", "__key")


def rows_to_columns(df: DataFrame, key: str, value: str, order: str, limit: int = 100_000) -> DataFrame:
    """Key to the ordered list of its values, in segments of bounded size."""
    return gather_lists(df, [key], [order], F.col(value), "values", limit)


def assign_uid(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Group id of a prompt: a digest of its key columns (or of its row number)."""
    return df.withColumn("uid", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (key or [IDX])])))


def with_rollout_n(df: DataFrame, uid: str, order: Sequence[str], rows: int | None = None) -> DataFrame:
    return rank_within(df, [uid], order, "rollout_n", rows=rows)


def flatten_trajectories(df: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row per step of the step arrays; scalars repeat."""
    rest = [c for c in df.columns if c not in steps]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(*steps)).alias("step_idx", "__e"))
    return rows.select(*rest, "step_idx", *[F.col(f"__e.{c}").alias(c) for c in steps])


def _bytes(name: str, kind: str) -> Column:
    widths = {"int": 4, "bigint": 8, "double": 8, "float": 4, "boolean": 1, "smallint": 2, "tinyint": 1, "timestamp": 8}
    if kind in widths:
        return F.when(F.col(name).isNotNull(), widths[kind]).otherwise(0)
    if kind.startswith("array<") and kind[6:-1] in widths:
        return F.coalesce(F.size(name) * widths[kind[6:-1]], F.lit(0))
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(name)), F.lit(0)) if kind.startswith(("struct", "array", "map")) else F.lit(0)


def batch_size_report(df: DataFrame) -> DataFrame:
    """Bytes and rows per column, in one aggregate."""
    sums = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(_bytes(c, t).cast("long")).alias(c) for c, t in df.dtypes])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("__rows").alias("rows"),
                              F.coalesce(F.col(c), F.lit(0)).alias("bytes")) for c, t in df.dtypes])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def deep_equal(a: DataFrame, b: DataFrame, key: Sequence[str] = (IDX,)) -> DataFrame:
    """One row: rows missing on a side and rows that differ; NaN equals NaN, and a null key is a key."""
    rest = [c for c in a.columns if c not in key]
    left = a.select(key_of(key).alias("__key"), F.struct(*rest).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(key_of(key).alias("__key"), F.struct(*rest).alias("__b"), F.lit(True).alias("__in_b"))
    joined = left.join(right, "__key", "full")
    both = F.col("__in_a") & F.col("__in_b")
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return joined.agg(flag(F.col("__in_b").isNull()).alias("only_left"), flag(F.col("__in_a").isNull()).alias("only_right"),
                      flag(F.coalesce(both & ~F.col("__a").eqNullSafe(F.col("__b")), F.lit(False))).alias("different"))


def from_columns(spark: SparkSession, data: Mapping[str, Sequence], schema: str) -> DataFrame:
    """A small batch from driver-side columns of equal length."""
    lengths = {len(v) for v in data.values()}
    if len(lengths) > 1:
        raise ValueError("columns differ in length")
    rows = [(i, *values) for i, values in enumerate(zip(*data.values(), strict=True))]
    return spark.createDataFrame(rows, f"{IDX} long, {schema}")
