"""Stateful operators over rollout streams.

Each keeps a bounded state per key in the state store, so a lost executor resumes from
the checkpointed state. Use ``with_rocksdb`` once per session before starting a query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _gather(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order; bounded by the trigger's rate limit."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class _Queue(StatefulProcessor):
    """First-in first-out queue that drops its oldest entry when full."""

    def __init__(self, capacity: int, order: str, take: str | None):
        self.capacity, self.order, self.take = capacity, order, take

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "item long")
        self.counts = handle.getValueState("counts", "produced long, consumed long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = [r[0] for r in self.items.get()] if self.items.exists() else []
        produced, consumed, dropped = self.counts.get() if self.counts.exists() else (0, 0, 0)
        out = []
        batch = _gather(rows, self.order)
        takes = batch[self.take].tolist() if self.take else [False] * len(batch)
        for item, is_take in zip(batch[self.order].tolist(), takes, strict=True):
            if is_take:
                if queue:
                    out.append((queue.pop(0), "consumed"))
                    consumed += 1
                continue
            produced += 1
            if len(queue) >= self.capacity:
                out.append((queue.pop(0), "dropped"))
                dropped += 1
            queue.append(int(item))
        if queue:
            self.items.put([(i,) for i in queue])
        elif self.items.exists():
            self.items.clear()
        self.counts.update((produced, consumed, dropped))
        frame = pd.DataFrame(out, columns=["item", "outcome"])
        frame.insert(0, "queue", [key[0]] * len(frame))
        frame["produced"], frame["consumed"], frame["dropped"], frame["size"] = produced, consumed, dropped, len(queue)
        total = pd.DataFrame([[key[0], None, "state", produced, consumed, dropped, len(queue)]], columns=frame.columns)
        yield pd.concat([frame, total], ignore_index=True) if len(frame) else total

    def close(self) -> None:
        pass


def bounded_queue(
    stream: DataFrame, queue: str, order: str, capacity: int, take: str | None = None, shards: int = 1
) -> DataFrame:
    """Drop-oldest queue per key: consumed and dropped items, and one ``state`` row per micro-batch.

    A queue is sequential; ``shards`` splits a busy one into parts with a share of the capacity.
    """
    name = F.concat_ws("-", F.col(queue).cast("string"), F.pmod(F.xxhash64(order), F.lit(shards)).cast("string")) if shards > 1 else F.col(queue).cast("string")
    columns = [name.alias("queue"), F.col(order).cast("long").alias(order)] + ([F.col(take)] if take else [])
    schema = "queue string, item long, outcome string, produced long, consumed long, dropped long, size long"
    keyed = stream.select(*columns).groupBy("queue")
    return keyed.transformWithStateInPandas(_Queue(max(1, capacity // shards), order, take), schema, "Append", "None")


class _Take(StatefulProcessor):
    """Deals items in order into steps of exactly n; the remainder waits."""

    def __init__(self, n: int, order: str):
        self.n, self.order = n, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "item long")
        self.step = handle.getValueState("step", "step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        queue += [int(i) for i in _gather(rows, self.order)[self.order]]
        step = self.step.get()[0] if self.step.exists() else 0
        full = len(queue) // self.n
        done, rest = queue[: full * self.n], queue[full * self.n :]
        if rest:
            self.waiting.put([(i,) for i in rest])
        elif self.waiting.exists():
            self.waiting.clear()
        self.step.update((step + full,))
        if done:
            yield pd.DataFrame({"queue": key[0], "step": [step + i // self.n for i in range(len(done))], "item": done})

    def close(self) -> None:
        pass


def take_required(stream: DataFrame, queue: str, order: str, n: int) -> DataFrame:
    """(queue, step, item): exactly n items per step, first in first out."""
    keyed = stream.select(F.col(queue).cast("string").alias("queue"), F.col(order).cast("long").alias(order)).groupBy("queue")
    return keyed.transformWithStateInPandas(_Take(n, order), "queue string, step long, item long", "Append", "None")


class _Groups(StatefulProcessor):
    """Collects the rollouts of a prompt until all arrived or its timer fires."""

    def __init__(self, n: int, wait_ms: int):
        self.n, self.wait_ms = n, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "rollout long", "score double")
        self.timer = handle.getValueState("timer", "at long")

    def _emit(self, key, complete: bool) -> pd.DataFrame:
        entries = sorted((k[0], v[0]) for k, v in self.seen.iterator())
        self.seen.clear()
        if self.timer.exists():
            if complete:
                self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        return pd.DataFrame({"uid": [key[0]], "n": [len(entries)], "complete": [complete],
                             "rollouts": [[k for k, _ in entries]], "scores": [[v for _, v in entries]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for pdf in rows:
            for rollout, score, ts in zip(pdf["rollout"], pdf["score"], pdf["ts"], strict=True):
                self.seen.updateValue((int(rollout),), (float(score),))
                latest = max(latest, int(pd.Timestamp(ts).timestamp() * 1000))
        if sum(1 for _ in self.seen.keys()) >= self.n:
            yield self._emit(key, True)
            return
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._emit(key, False)

    def close(self) -> None:
        pass


def complete_groups(
    stream: DataFrame, uid: str, rollout: str, score: str, ts: str, n: int, delay: str = "10 minutes", wait_seconds: int = 600
) -> DataFrame:
    """One row per prompt when its n rollouts arrived; what is missing after the wait is flushed as incomplete.

    A rollout delivered twice counts once.
    """
    rows = stream.select(F.col(uid).alias("uid"), F.col(rollout).cast("long").alias("rollout"), F.col(score).cast("double").alias("score"), F.col(ts).alias("ts"))
    kind = dict(rows.dtypes)["uid"]
    schema = f"uid {kind}, n long, complete boolean, rollouts array<long>, scores array<double>"
    keyed = rows.withWatermark("ts", delay).groupBy("uid")
    return keyed.transformWithStateInPandas(_Groups(n, wait_seconds * 1000), schema, "Append", "EventTime")


class _Bucket(StatefulProcessor):
    """Replays token buckets for requests and tokens of one client."""

    def __init__(self, rpm: float | None, tpm: float | None, burst: float):
        self.limits = [(rpm / 60.0, None) if rpm else None, (tpm / 60.0, None) if tpm else None]
        self.burst = burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "clock double, requests double, tokens double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _gather(rows, "at")
        caps = [x[0] * self.burst if x else 0.0 for x in self.limits]
        clock, *levels = self.level.get() if self.level.exists() else (None, *caps)
        out = []
        for request, at, tokens in zip(batch["request"], batch["at"], batch["tokens"], strict=True):
            start = at if clock is None else max(at, clock)
            levels = [min(c, v + (start - (clock if clock is not None else start)) * x[0]) if x else v
                      for c, v, x in zip(caps, levels, self.limits, strict=True)]
            needs = (1.0, float(tokens))
            wait = max([max(0.0, (need - v) / x[0]) for need, v, x in zip(needs, levels, self.limits, strict=True) if x] or [0.0])
            levels = [min(c, v + wait * x[0]) - need if x else v for c, v, need, x in zip(caps, levels, needs, self.limits, strict=True)]
            clock = start + wait
            out.append((key[0], int(request), (clock - at) <= 1e-9, clock - at))
        self.level.update((clock, *levels))
        yield pd.DataFrame(out, columns=["client", "request", "allowed", "wait_s"])

    def close(self) -> None:
        pass


def rate_audit(
    stream: DataFrame, client: str, request: str, ts: str, tokens: str, rpm: float | None = None, tpm: float | None = None,
    burst: float = 60.0,
) -> DataFrame:
    """(client, request, allowed, wait_s): how long each logged request would have waited.

    Buckets hold ``burst`` seconds of each rate; a wait delays the requests behind it.
    """
    rows = stream.select(F.col(client).cast("string").alias("client"), F.col(request).cast("long").alias("request"),
                         (F.unix_micros(ts) / 1e6).alias("at"), F.col(tokens).cast("double").alias("tokens"))
    schema = "client string, request long, allowed boolean, wait_s double"
    return rows.groupBy("client").transformWithStateInPandas(_Bucket(rpm, tpm, burst), schema, "Append", "None")


class _Ready(StatefulProcessor):
    """Remembers which fields of a row were written; announces each task's readiness once."""

    def __init__(self, tasks: dict[str, list[str]], keep_ms: int | None):
        self.tasks, self.keep_ms = tasks, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "seen boolean", self.keep_ms)
        self.told = handle.getMapState("told", "task string", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for field in pdf["field"]:
                self.fields.updateValue((str(field),), (True,))
        have = {k[0] for k in self.fields.keys()}
        ready = [t for t, need in self.tasks.items() if set(need) <= have and not self.told.containsKey((t,))]
        for task in ready:
            self.told.updateValue((task,), (True,))
        if ready:
            yield pd.DataFrame({"row": [key[0]] * len(ready), "task": ready})

    def close(self) -> None:
        pass


def field_readiness(stream: DataFrame, row: str, field: str, tasks: dict[str, Sequence[str]], keep_hours: float | None = None) -> DataFrame:
    """(row, task) once per task, when every field the task needs has been written.

    With ``keep_hours`` a row's fields are forgotten so long after they were written. Such a query runs on processing
    time, so it suits a stream that stays up and not one that stops when what is there has been read.
    """
    rows = stream.select(F.col(row).alias("row"), F.col(field).alias("field"))
    kind = dict(rows.dtypes)["row"]
    needs = {t: list(f) for t, f in tasks.items()}
    keep_ms = None if keep_hours is None else int(keep_hours * 3_600_000)
    return rows.groupBy("row").transformWithStateInPandas(_Ready(needs, keep_ms), f"row {kind}, task string", "Append", "None" if keep_ms is None else "ProcessingTime")


