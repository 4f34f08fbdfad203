"""Unions, differences and distinct keys of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rewardloom.plans.scale import union_all


def union_datasets(frames: Sequence[DataFrame]) -> DataFrame:
    return union_all(frames)


def union_missing(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union of tables with different columns; missing values are null (see ``batch.concat`` for typed fillers)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_validation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two validation tables as one; variables only one of them has are null in the other."""
    return union_missing([a, b])


def columns_to_pop(df: DataFrame, keep: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(keep)]


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()
