"""Scans and sinks of prompts, generations and metrics on Spark file systems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENERATION_SCHEMA = "input string, output string, gts string, score double, step long"


def _listed(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def scan_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One or many Parquet datasets as one table; filters and projections reach the scan."""
    df = spark.read.parquet(*_listed(paths))
    return df.select(*columns) if columns else df


def scan_json(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(_listed(paths))


FORMATS = {".tar": "tar", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".arrow": "arrow"}


def detect_format(paths: str | Sequence[str]) -> str:
    """tar, parquet, json or arrow from the endings of paths or of the files inside folders, on any file system of Spark.

    Whatever has no known ending is listed by the file reader, of which only the path column is read.
    """
    ending_of = lambda p: next((FORMATS[e] for e in FORMATS if p.lower().rstrip("/").endswith(e)), None)
    named = {ending_of(p) for p in _listed(paths)} - {None}
    if not named:
        spark = SparkSession.active()
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_listed(paths)).select("path")
        except AnalysisException as missing:
            raise ValueError(f"no known data format at {_listed(paths)}") from missing
        ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
        named = {FORMATS[r[0]] for r in files.select(ending).where(ending.isin(*FORMATS)).distinct().collect()}  # at most one row per ending
    for kind in ("tar", "parquet", "json", "arrow"):
        if kind in named:
            return kind
    raise ValueError(f"no known data format at {_listed(paths)}")


def scan_arrow(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Arrow files or streams with a declared schema, a file per task at the least, its record batches one by one."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(wanted)
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                if data.slice(0, 6).to_pybytes() == b"ARROW1":
                    opened = pa.ipc.open_file(data)
                    found = (opened.get_batch(i) for i in range(opened.num_record_batches))
                else:
                    found = pa.ipc.open_stream(data)
                for part in found:
                    yield from pa.Table.from_batches([part]).select(wanted.names).cast(kinds).to_batches(max_chunksize=10_000)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_listed(paths)).select("content")
    return files.mapInArrow(read, wanted)


def scan(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """Read by detected format."""
    kind = detect_format(paths)
    if kind == "parquet":
        return scan_parquet(spark, paths)
    if kind == "json":
        return scan_json(spark, paths, schema) if schema else spark.read.json(_listed(paths))
    if kind == "tar":
        from rewardloom.sources.tar import scan_tar_members

        return scan_tar_members(spark, _listed(paths))
    if schema is None:
        raise ValueError("arrow files need a schema")
    return scan_arrow(spark, paths, schema)


def scan_rollout_dump(spark: SparkSession, path: str, schema: str = GENERATION_SCHEMA) -> DataFrame:
    """Dumped generations, partitioned by step; a filter on step reads only its folders."""
    return spark.read.schema(schema).json(path)


def write_generations(df: DataFrame, path: str, extras: Sequence[str] = (), mode: str = "error") -> None:
    """input, output, gts, score and extra columns as JSON lines per step."""
    df.select("input", "output", "gts", "score", "step", *extras).write.mode(mode).partitionBy("step").json(path)


def write_prompts(df: DataFrame, folder: str, split: str, mode: str = "error") -> str:
    path = f"{folder.rstrip('/')}/{split}.parquet"
    df.write.mode(mode).parquet(path)
    return path


def metric_lines(metrics: DataFrame) -> DataFrame:
    """METRICS rows to one ``{"step", "data"}`` JSON text per step."""
    data = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return metrics.groupBy("step").agg(data.alias("data")).select("step", F.to_json(F.struct("step", "data")).alias("value"))


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    metric_lines(metrics).select("value").write.mode(mode).text(path)


def flatten_params(nested: Mapping, prefix: str = "") -> dict:
    """Nested configuration to flat ``a/b/c`` keys."""
    flat: dict = {}
    for key, value in nested.items():
        name = f"{prefix}/{key}" if prefix else str(key)
        if isinstance(value, Mapping):
            flat.update(flatten_params(value, name))
        elif isinstance(value, (list, tuple)):
            flat.update(flatten_params(dict(enumerate(value)), name))
        else:
            flat[name] = value
    return flat


def flatten_struct(df: DataFrame, column: str, separator: str = "/") -> DataFrame:
    """A nested struct column to one column per leaf."""

    def leaves(kind: T.DataType, path: list[str]) -> list[tuple[str, list[str]]]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(f.dataType, [*path, f.name])]
        return [(separator.join(path), path)]

    def pick(path: list[str]) -> Column:
        out = F.col(column)
        for p in path:
            out = out[p]
        return out

    found = leaves(df.schema[column].dataType, [])
    return df.withColumns({name: pick(path) for name, path in found}).drop(column)


def rollout_cache(df: DataFrame, folder: str, key: str) -> DataFrame:
    """Rollouts of a key: read when they were written before, else written once and read back."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{key}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parse_metric_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``step:N - key:val - ...`` lines to (step, key, value)."""
    fields = F.split(F.col(column), " - ")
    pairs = F.transform(fields, lambda f: F.struct(
        F.trim(F.regexp_extract(f, r"^(.*):[^:]*$", 1)).alias("key"), F.trim(F.substring_index(f, ":", -1)).try_cast("double").alias("value")))
    step = F.regexp_extract(F.col(column), r"step:\s*([0-9]+)", 1).try_cast("long")
    rows = lines.select(step.alias("step"), pairs.alias("p")).where(F.col("step").isNotNull())
    rows = rows.select("step", F.explode("p").alias("p")).select("step", "p.key", "p.value")
    return rows.where((F.col("key") != "step") & (F.col("key") != "") & F.col("value").isNotNull())


def best_metric(metrics: DataFrame, key: str, target: float) -> DataFrame:
    """Best value of a key and whether it reached the target."""
    best = metrics.where(F.col("key") == key).agg(F.max("value").alias("best"))
    return best.withColumn("reached", F.coalesce(F.col("best") >= target, F.lit(False)))


def write_bucketed(df: DataFrame, table: str, key: str = "uid", buckets: int = 1024, mode: str = "overwrite") -> None:
    """Rollouts bucketed by group: group statistics and their join back then need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
