"""Token ids in binary files: one id array per file, document borders as Elias-Fano codes.

A file is ``LOOMEF1\\n``, then part, file and id width (u32 each), documents without id (u64), smallest doc_id (i64), the
doc_ids above it and the document ends as Elias-Fano codes, then the ids (little-endian, 16 bits). Documents
lie in ascending doc_id order inside a file, and files in the order of (part, file). A file is written under
another name and renamed, so a task that is run again leaves the same file once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm import elias_fano
from rewardloom.llm.common import shared_folder, small_batches, stored
from rewardloom.llm.tokens import encoder

MAGIC = b"LOOMEF1\n"
_HEAD = struct.Struct("<IIIQq")
FILE_IDS = 4 << 20  # a file ends with the document that reaches so many ids


def to_bytes(part: int, file: int, doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """``doc_ids`` ascending, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(d) for d in documents])
    apart = (known - least).astype(np.uint64)
    return b"".join([MAGIC, _HEAD.pack(part, file, 2, nulls, least), elias_fano.encode(apart), elias_fano.encode(ends),
                     *(d.astype("<u2").tobytes() for d in documents)])


class TokenFile:
    """One file in memory; borders are looked up in the codes."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(content)
        self.part, self.file, width, self.nulls, self.least = _HEAD.unpack_from(view, len(MAGIC))
        at = len(MAGIC) + _HEAD.size
        self.apart = elias_fano.Numbers(view[at:])
        at += self.apart.size
        self.ends = elias_fano.Numbers(view[at:])
        at += self.ends.size
        self.tokens = np.frombuffer(view, f"<u{width}", offset=at)

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.apart.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.tokens[lo:hi]


def _put(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    uri = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` to each, write files to ``folder`` (a URI all machines see).

    Returns one row per file: part, file, n_docs, n_ids. Documents are range-partitioned by doc_id, so a part's files
    follow those of the part before; repeated doc_ids stay together, ordered by text; null ids come first.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(path, spaced=True).ids
        end = np.array([end_id], np.uint16)
        ids, documents, held, file = [], [], 0, 0

        def close():
            content = to_bytes(part, file, ids, documents)
            _put(folder, f"part-{part:08d}-{file:06d}.tok", content)
            return pa.record_batch([pa.array([x], pa.int64()) for x in (part, file, len(ids), held)], names=["part", "file", "n_docs", "n_ids"])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.concatenate([encode(text or ""), end])
                ids.append(d)
                documents.append(one)
                held += len(one)
                if held >= file_ids:
                    yield close()
                    ids, documents, held, file = [], [], 0, file + 1
        if ids:
            yield close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "part long, file long, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held = TokenFile(content.as_buffer().to_pybytes())
                ends = held.ends.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                doc_ids = [None] * held.nulls + (held.apart.all() + held.least).tolist()
                crcs = [zlib.crc32(held.tokens[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64()),
                     pa.array(np.full(len(ends), held.part), pa.int64()), pa.array(np.full(len(ends), held.file), pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "file"],
                )

    # Files before: a running total over the parts (one row each) and one over the files of a part.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")
    base = files.join(parts.select("part", first.alias("_first")), "part").select("part", "file", (F.col("_first") + inside).alias("_base"))
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder).select("content")
    rows = raw.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part long, file long")
    return rows.join(base, ["part", "file"]).select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` (doc_id, text) to the shared folder and read every document back from the files."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, path, end_id), folder)
