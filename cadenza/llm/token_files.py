"""Token-ID output: Arrow files of equal-length sequences and masks, read back without copying.

Rows are cut by ranges of doc_id, one file a range, so files in name order hold the documents in
ascending doc_id order. A file's record batches hold, for each sequence, `ids`
(fixed-size list of unsigned integers), `mask` (fixed-size list of booleans, false on padding),
and the documents that begin in it: `doc_ids` and their `doc_starts`.

Null texts are empty; a document always has its end id. Null ids sort first. Rows that repeat a
doc_id are documents of their own, ordered by a hash of their text. An empty table gives no file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, scratch_path, texts_of
from cadenza.llm.tokens import encoder

MANIFEST = "shard int, path string, n_ids long, n_docs long, n_sequences long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Pieces of texts whose ids a worker keeps; each takes about 200 bytes.
KEEP = 800_000


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The Arrow file system of a URI or plain path, and the path in it."""
    if urlparse(uri).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), urlparse(uri).path
    return pyarrow.fs.FileSystem.from_uri(uri)


def file_schema(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            pa.field("ids", pa.list_(pa.field("item", id_type, False), length), False),
            pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False),
            pa.field("doc_ids", pa.list_(pa.int64()), False),
            pa.field("doc_starts", pa.list_(pa.int32()), False),
        ]
    )


class SequenceWriter:
    """Writes documents' ids, one after the other, as sequences of `length` ids."""

    def __init__(self, sink, length: int, id_type: pa.DataType, batch: int):
        self.schema, self.length, self.batch = file_schema(length, id_type), length, batch
        self.kind = np.dtype(id_type.to_pandas_dtype())
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []
        self.held = self.n_ids = self.n_docs = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.held))
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += 1
        if self.held >= self.length * self.batch:
            self._write(self.held // self.length)

    def _write(self, n: int, pad: int = 0) -> None:
        flat = np.concatenate([*self.parts, np.zeros(pad, self.kind)])
        used, rest = flat[: n * self.length], flat[n * self.length :]
        mask = np.ones(len(used), bool)
        if pad:
            mask[-pad:] = False
        k = next((i for i, d in enumerate(self.docs) if d[1] >= len(used)), len(self.docs))
        at = np.array([d[1] for d in self.docs[:k]], np.int64)
        offsets = pa.array(np.searchsorted(at, np.arange(n + 1) * self.length).astype(np.int32))
        ids = [d[0] for d in self.docs[:k]]
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(used), type=self.schema.field("ids").type),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type),
            pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array((at % self.length).astype(np.int32))),
        ]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.docs = [(d, p - len(used)) for d, p in self.docs[k:]]
        self.parts, self.held = ([rest] if len(rest) else []), len(rest)
        self.n_sequences += n

    def close(self) -> None:
        if self.held:
            n = -(-self.held // self.length)
            self._write(n, n * self.length - self.held)
        self.out.close()


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 0,
    tokenizer_path: str | None = None,
    id_type: str = "uint16",
    batch: int = 64,
) -> DataFrame:
    """Encode documents into Arrow files under out_dir; returns the manifest, a row for each file.

    A file is written under a name of its own and then renamed, so a task that runs again after a
    lost executor leaves the same files.
    """
    spark = docs.sparkSession
    kind = pa.type_for_alias(id_type)
    most = np.iinfo(kind.to_pandas_dtype()).max

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, top = filesystem(out_dir)
        writer = sink = None
        final = f"{top}/shard-{shard:08d}.arrow"
        own = f"{top}/.{uuid.uuid4().hex}.part"
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for a in range(0, len(ids), 256):
                for doc_id, blob in zip(ids[a : a + 256], encoder(tokenizer_path, KEEP).encode(texts.slice(a, 256).to_pylist()), strict=True):
                    if writer is None:
                        fs.create_dir(top, recursive=True)
                        sink = fs.open_output_stream(own)
                        writer = SequenceWriter(sink, length, kind, batch)
                    got = np.append(np.frombuffer(blob, "<u4"), np.uint32(end_id))
                    if len(got) and int(got.max()) > most:
                        raise ValueError(f"id {int(got.max())} does not fit {id_type}")
                    writer.add(doc_id, got)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, final)
            row = [shard, final if "://" not in out_dir or out_dir.startswith("file:") else f"{out_dir}/{os.path.basename(final)}", writer.n_ids, writer.n_docs, writer.n_sequences]
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("shard", "path", "n_ids", "n_docs", "n_sequences"), row, strict=True)}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("n_sequences", pa.int64())]))

    rows = texts_of(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = rows.select("doc_id", "text").mapInArrow(write, MANIFEST)
    # A row for each file, so the driver holds metadata only.
    return spark.createDataFrame(sorted(map(tuple, manifest.collect())), MANIFEST)


def open_sequences(path: str) -> pa.RecordBatchFileReader:
    """Random access to a file's batches; on a local or mounted path its pages are mapped, not copied."""
    if urlparse(path).scheme in ("", "file"):
        return pa.ipc.open_file(pa.memory_map(urlparse(path).path))
    fs, at = filesystem(path)
    return pa.ipc.open_file(fs.open_input_file(at))


def read_documents(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a file, in order."""
    source = open_sequences(path)
    doc_id, begun, parts = None, False, []
    for k in range(source.num_record_batches):
        b = source.get_batch(k)
        length = b.schema.field("ids").type.list_size
        flat = b.column(0).flatten().to_numpy()
        mask = b.column(1).flatten().to_numpy(zero_copy_only=False)
        end = len(flat) if mask[-1] else int(np.argmin(mask))
        counts = b.column(2).value_lengths().to_numpy()
        starts = np.repeat(np.arange(len(b)) * length, counts) + b.column(3).flatten().to_numpy()
        cuts = [*starts.tolist(), end]
        if begun:
            parts.append(flat[: cuts[0]])
        for i, d in enumerate(b.column(2).flatten().to_pylist()):
            if begun:
                yield doc_id, np.concatenate(parts)
            doc_id, begun, parts = d, True, [flat[cuts[i] : cuts[i + 1]]]
    if begun:
        yield doc_id, np.concatenate(parts)


def read_digest(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids."""
    spark = manifest.sparkSession
    rows = manifest.orderBy("shard").select("path", "n_ids").collect()
    if not rows:
        return spark.createDataFrame([], DIGEST)
    before = np.concatenate([[0], np.cumsum([r.n_ids for r in rows])]).tolist()
    files = spark.createDataFrame([(r.path, b) for r, b in zip(rows, before, strict=False)], "path string, before long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for doc_id, ids in read_documents(path):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return files.repartition(len(rows)).mapInArrow(read, DIGEST)


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write documents as Arrow token files in the shared folder and digest what is read back."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digest(write_token_files(docs, scratch_path(spark, "token-files")))
