"""TAR shards of samples as tables.

Shards are indexed in tasks: a walk from header to header, without payloads, cuts a large shard into ranges at the
borders of samples. Ranges are then read by as many tasks, each of which has whole samples. Payloads stay binary and are
never shuffled.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.plans.blocks import tasks

MEMBER_SCHEMA = "shard string, key string, ext string, payload binary"
SAMPLE_SCHEMA = "shard string, key string, json string, files array<struct<ext:string,payload:binary>>"
SPLIT_BYTES = 1 << 30
BATCH_BYTES = 16 << 20


def open_shared(path: str, write: bool = False):
    """A file on a local or remote file system, to seek in or to write."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "wb" if write else "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return system.open_output_stream(inner) if write else system.open_input_file(inner)


def _name(member: tarfile.TarInfo) -> tuple[str, str]:
    folder, _, name = member.name.rpartition("/")
    stem, _, ext = name.partition(".")
    return (f"{folder}/{stem}" if folder else stem), ext.lower()


def _index(split_bytes: int):
    """Shards to ranges (shard, start, end) of about ``split_bytes`` that begin where a sample does."""

    def cuts(shard: str) -> list[int]:
        with open_shared(shard) as f:
            f.seek(0, 2)
            if f.tell() <= split_bytes:
                return [0]
            f.seek(0)
            found, last = [0], None
            with tarfile.open(fileobj=f, mode="r:") as archive:
                for member in archive:
                    key = _name(member)[0]
                    if key != last and member.offset - found[-1] >= split_bytes:
                        found.append(member.offset)
                    last, archive.members = key, []
            return found

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                at = cuts(shard)
                yield pa.record_batch([pa.array([shard] * len(at)), pa.array(at, pa.int64()), pa.array([*at[1:], None], pa.int64())], names=["shard", "start", "end"])

    return run


def _members(shard: str, start: int, end: int | None) -> Iterator[tuple[str, str, bytes]]:
    with open_shared(shard) as f:
        f.seek(start)
        with tarfile.open(fileobj=f, mode="r|") as archive:
            for member in archive:
                if end is not None and start + member.offset >= end:
                    break
                if member.isfile():
                    yield *_name(member), archive.extractfile(member).read()


def _ranges(spark: SparkSession, paths: Sequence[str] | str, split_bytes: int) -> DataFrame:
    shards = list_shards(spark, [paths] if isinstance(paths, str) else list(paths))
    found = spark.createDataFrame([(s,) for s in shards], "shard string").repartition(max(1, len(shards)))
    index = found.mapInArrow(_index(split_bytes), "shard string, start long, end long")
    # An index row is small and its range is large: a task per range, up to a few times the cores; beyond that a task reads several in turn.
    index = index.checkpoint() if spark.sparkContext.getCheckpointDir() else index
    return index.repartition(tasks(spark, index.count()))


def _read(rows_of, kinds: list[tuple[str, pa.DataType]]):
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for shard, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row, n in rows_of(shard, start, end):
                    rows.append(row)
                    size += n
                    if size >= BATCH_BYTES:
                        yield _batch(rows, kinds)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, kinds)

    return run


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def list_shards(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """``.tar`` files under folders, by the file listing of Spark's binary reader; payloads are not read."""
    found = []
    for path in paths:
        if path.endswith(".tar"):
            found.append(path)
            continue
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", "true")
        found += [r.path for r in reader.load(path).select("path").collect()]
    return sorted(p.removeprefix("file:") if p.startswith("file:") else p for p in found)


def scan_tar_members(spark: SparkSession, paths: Sequence[str] | str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(shard, key, ext, payload) of every file in the shards."""

    def rows(shard, start, end):
        for key, ext, payload in _members(shard, start, end):
            yield (shard, key, ext, payload), len(payload) + 64

    kinds = [("shard", pa.string()), ("key", pa.string()), ("ext", pa.string()), ("payload", pa.binary())]
    return _ranges(spark, paths, split_bytes).mapInArrow(_read(rows, kinds), MEMBER_SCHEMA)


def members_to_samples(members: DataFrame, json_ext: str = "json") -> DataFrame:
    """One row per sample key: its JSON text and its other members in name order."""
    is_json = F.col("ext") == json_ext
    other = F.when(~is_json, F.struct("ext", "payload"))
    return members.groupBy("shard", "key").agg(
        F.max(F.when(is_json, F.decode("payload", "UTF-8"))).alias("json"),
        F.array_sort(F.collect_list(other)).alias("files"),
    )


def scan_tar_samples(spark: SparkSession, paths: Sequence[str] | str, split_bytes: int = SPLIT_BYTES, json_ext: str = "json") -> DataFrame:
    """One row per sample, as ``members_to_samples`` gives it, straight from the reader: neighbours with one key are a sample."""

    def rows(shard, start, end):
        last, text, files, size = None, None, [], 0
        for key, ext, payload in _members(shard, start, end):
            if key != last and last is not None:
                yield (shard, last, text, sorted(files, key=lambda f: (f["ext"], f["payload"]))), size
                text, files, size = None, [], 0
            last, size = key, size + len(payload) + 64
            if ext == json_ext:
                text = payload.decode("utf-8", "replace")
            else:
                files.append({"ext": ext, "payload": payload})
        if last is not None:
            yield (shard, last, text, sorted(files, key=lambda f: (f["ext"], f["payload"]))), size

    file = pa.struct([("ext", pa.string()), ("payload", pa.binary())])
    kinds = [("shard", pa.string()), ("key", pa.string()), ("json", pa.string()), ("files", pa.list_(file))]
    return _ranges(spark, paths, split_bytes).mapInArrow(_read(rows, kinds), SAMPLE_SCHEMA)
