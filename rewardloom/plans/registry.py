"""User extension points: reward functions, reward jobs, datasets, group and table functions."""

from __future__ import annotations

import importlib
import importlib.util
import pickle
from collections.abc import Callable, Sequence
from functools import partial
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.operators import score as S
from rewardloom.operators.advantage import ESTIMATORS, estimator, register_advantage
from rewardloom.operators.objective import OBJECTIVES, objective, register_objective
from rewardloom.plans.scale import key_of, run_edges

__all__ = ["ESTIMATORS", "OBJECTIVES", "estimator", "objective", "register_advantage", "register_objective"]

REWARDS: dict[str, Callable[..., Column]] = {
    "hash_answer": S.score_hash_answer,
    "boxed": S.score_boxed,
    "exact_match": S.score_em,
    "format": S.check_format,
    "accuracy": S.score_accuracy,
}
JOBS: dict[str, Callable[..., DataFrame]] = {}
DATASETS: dict[str, Callable[..., DataFrame]] = {}


def _add(table: dict, kind: str, name: str):
    def add(fn):
        if table.get(name, fn) is not fn:
            raise ValueError(f"{kind} {name} is already registered")
        table[name] = fn
        return fn

    return add


def _get(table: dict, kind: str, name: str):
    if name not in table:
        raise ValueError(f"unknown {kind}: {name}; known: {sorted(table)}")
    return table[name]


def register_reward(name: str):
    """Reward as an expression over columns."""
    return _add(REWARDS, "reward", name)


def reward(name: str) -> Callable[..., Column]:
    return _get(REWARDS, "reward", name)


def register_job(name: str):
    """Scoring job: DataFrame to DataFrame with a score column."""
    return _add(JOBS, "scoring job", name)


def job(name: str) -> Callable[..., DataFrame]:
    return _get(JOBS, "scoring job", name)


def register_dataset(name: str):
    """Dataset, sampler or generator: (spark, options) to DataFrame."""
    return _add(DATASETS, "dataset", name)


def dataset(spark: SparkSession, name: str, **options) -> DataFrame:
    return _get(DATASETS, "dataset", name)(spark, **options)


def load_function(path: str, name: str, **bound) -> Callable:
    """A function of a module path or file, with extra arguments bound."""
    if path.endswith(".py"):
        spec = importlib.util.spec_from_file_location("rewardloom_user_module", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(path)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    fn = getattr(module, name)
    return partial(fn, **bound) if bound else fn


@register_job("rule")
def rule_job(df: DataFrame, reward_name: str, text: str = "response", truth: str = "ground_truth", **options) -> DataFrame:
    """One registered reward over response and truth; failures score 0."""
    value = reward(reward_name)(F.col(text), F.col(truth), **options)
    return S.score_with_default(df, value)


@register_job("overlong")
def overlong_job(df: DataFrame, reward_name: str, length: str, max_len: int, buffer: int, factor: float, **options):
    return S.with_overlong_penalty(rule_job(df, reward_name, **options), length, max_len, buffer, factor)


@register_job("routed")
def routed_job(df: DataFrame, routes: dict[str, str], route: str = "data_source", text: str = "response", truth: str = "ground_truth"):
    """Reward chosen by the exact name of the source; an unknown name is an error."""
    value = F.raise_error(F.concat(F.lit("no reward for source "), F.col(route))).cast("double")
    for source, name in routes.items():
        value = F.when(F.col(route) == source, reward(name)(F.col(text), F.col(truth))).otherwise(value)
    return S.score_with_default(df, value)


# Kinds of values that numpy holds as pandas would; the others go to pandas group by group.
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
# Kinds of keys whose equality Arrow knows as Spark does.
_KEYS = {"tinyint", "smallint", "int", "bigint", "string", "date", "timestamp", "boolean"}


def group_reduce(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.Series], float], value: str, out: str) -> DataFrame:
    """User aggregate over the values of a group. The values of one group meet in one task, so this
    is for groups of known size; large groups use the built-in aggregates.

    Groups of plain keys and numbers pass by in batches: a small group costs its call of ``fn``, not a transfer.
    """
    kinds = dict(df.dtypes)
    if not keys or kinds[value] not in _NUMBERS or any(kinds[k] not in _KEYS for k in keys):

        @F.pandas_udf("double")
        def run(v: pd.Series) -> float:
            return float(fn(v))

        return df.groupBy(*keys).agg(run(F.col(value)).alias(out))

    def reduced(parts: list[pa.Array]) -> float:
        values = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
        return float(fn(pd.Series(np.array(values.to_numpy(zero_copy_only=False)))))

    def walk(batches):
        last, held = None, []  # the key and values of a group that may go on in the next batch

        def row(key, results):
            return pa.record_batch([*key, pa.array(results, pa.float64(), from_pandas=True)], names=[*(f"k{i}" for i in range(len(keys))), "result"])

        for batch in batches:
            if not batch.num_rows:
                continue
            edges = sorted({e for i in range(len(keys)) for e in run_edges(batch.column(i))})
            values, first = batch.column(len(keys)), [batch.column(i).slice(0, 1) for i in range(len(keys))]
            starts = edges[:-1]
            if last is not None and [k.to_pylist() for k in last] != [k.to_pylist() for k in first]:
                yield row(last, [reduced(held)])
                held = []
            if len(starts) > 1:
                whole = values.to_numpy(zero_copy_only=False) if not values.null_count else None
                spans = list(zip(starts[:-1], starts[1:], strict=True))
                results = [reduced([*held, values.slice(0, spans[0][1])])]
                if whole is not None:
                    results += [float(fn(pd.Series(whole[a:b].copy()))) for a, b in spans[1:]]
                else:
                    results += [reduced([values.slice(a, b - a)]) for a, b in spans[1:]]
                at = pa.array(starts[:-1], pa.int64())
                yield row([batch.column(i).take(at) for i in range(len(keys))], results)
                held = []
            last = [batch.column(i).slice(starts[-1], 1) for i in range(len(keys))]
            held.append(values.slice(starts[-1]))
        if last is not None:
            yield row(last, [reduced(held)])

    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for n, k in zip(names, keys, strict=True)], F.col(f"`{value}`").alias("value"))
    schema = ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(names, keys, strict=True)), "result double"])
    result = rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(walk, schema)
    return result.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("result").alias(out))


class Fold(NamedTuple):
    """A user aggregate in parts: values of one batch to a state, two states to one, the last state to a number."""

    partial: Callable[[np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float]


def group_fold(df: DataFrame, keys: Sequence[str], fold: Fold, value: str, out: str, salts: int = 32) -> DataFrame:
    """User aggregate of any group, the largest included: a state per batch, merged first by key and salt and then by key.

    Null values are left out; rows with null keys are a group; a group without values gives null. No task holds more than one batch
    and one state.
    """
    none = pickle.dumps(None)

    def begun(batches):
        for batch in batches:
            code = pc.dictionary_encode(batch.column(0)).indices.to_numpy(zero_copy_only=False)
            values = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(order)] if len(order) else []
            parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            states = [pickle.dumps(fold.partial(values[p[known[p]]])) if known[p].any() else none for p in parts]
            at = pa.array([int(p[0]) for p in parts], pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(states, pa.binary())], names=["group", "key", "state"])

    def merged(batches):
        group = key = state = None

        def row():
            return pa.record_batch([pa.array([group], pa.string()), key, pa.array([pickle.dumps(state)], pa.binary())], names=["group", "key", "state"])

        for batch in batches:
            for i, (name, data) in enumerate(zip(batch.column("group").to_pylist(), batch.column("state").to_pylist(), strict=True)):
                other = pickle.loads(data)  # noqa: S301 - written by begun() above
                if name != group:
                    if group is not None:
                        yield row()
                    group, key, state = name, batch.column("key").slice(i, 1), other
                elif other is not None:
                    state = other if state is None else fold.merge(state, other)
        if group is not None:
            yield row()

    def finished(batches):
        for batch in batches:
            states = [pickle.loads(s) for s in batch.column("state").to_pylist()]  # noqa: S301
            results = [None if s is None else float(fold.finish(s)) for s in states]
            yield pa.record_batch([batch.column("key"), pa.array(results, pa.float64())], names=["key", "result"])

    rows = df.select(F.to_json(key_of(keys)).alias("group"), key_of(keys).alias("key"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("key", kind), T.StructField("state", T.BinaryType())])
    states = rows.mapInArrow(begun, schema).withColumn("salt", F.pmod(F.xxhash64("state"), F.lit(salts)))
    states = states.repartition("group", "salt").sortWithinPartitions("group", "salt").drop("salt").mapInArrow(merged, schema)
    states = states.repartition("group").sortWithinPartitions("group").mapInArrow(merged, schema)
    result = states.mapInArrow(finished, T.StructType([T.StructField("key", kind), T.StructField("result", T.DoubleType())]))
    return result.select(*[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)], F.col("result").alias(out))


def explode_with(df: DataFrame, items: Column, keep: Sequence[str], name: str = "item") -> DataFrame:
    """Row to many rows by an array expression; user code with state can be a ``udtf`` instead."""
    return df.select(*keep, F.posexplode(items).alias("position", name))
