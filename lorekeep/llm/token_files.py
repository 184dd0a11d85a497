"""Token ids in Arrow stream files of equal-length sequences.

A dataset is a folder on shared storage. Every range of document ids becomes two Arrow streams:

* ``tokens-NNNNNN.arrows``: batches of two fixed-size lists, ``ids`` (the narrowest unsigned type that holds the
  vocabulary) and ``mask`` (true where the id is real). The ids of the range's documents, each closed by the end
  id, follow each other in ascending document id; only the last sequence of a file is padded. All batches but
  the last hold BATCH sequences, so sequence i is row ``i % BATCH`` of batch ``i // BATCH``; over a memory map no
  byte is copied.
* ``index-NNNNNN.arrows``: doc_id, start (ids before it in this file), n_tokens.

Files are written under a task's own name and renamed, so a repeated task replaces them by the same content. A
table with a row per file (number, documents, tokens, sequences) is written last; a dataset without it is
incomplete.

Defined cases: null and empty texts have the end id alone; null document ids come first; rows of equal ids are
ordered by their ids; an empty table gives no files. Paths are opened by pyarrow's file systems.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.ordering import LEAST, boundaries, range_of
from lorekeep.llm.tokens import encoder

LENGTH = 2048
BATCH = 64
RANGE_BYTES = 64 << 20  # texts of a range of ids, which is a task and a file
ENCODED = "block int, key bigint, doc_id bigint, ids binary"
MANIFEST = "block int, documents bigint, tokens bigint, sequences bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def location(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class SequenceFile:
    """One pair of streams, written in order."""

    def __init__(self, folder: str, block: int, kind: str, length: int):
        self.files, self.folder = location(folder)
        self.block, self.kind, self.length = block, np.dtype(kind), length
        self.attempt = uuid.uuid4().hex
        self.files.create_dir(self.folder, recursive=True)
        self.lists = {
            "ids": pa.list_(pa.from_numpy_dtype(self.kind), length),
            "mask": pa.list_(pa.bool_(), length),
        }
        self.sink = self.files.open_output_stream(f"{self.folder}/_tokens-{self.attempt}")
        self.stream = pa.ipc.new_stream(self.sink, pa.schema(self.lists))
        self.index: list[tuple] = []
        self.waiting: list[np.ndarray] = []
        self.waiting_ids = self.tokens = self.sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.waiting_ids += len(ids)
        while self.waiting_ids >= BATCH * self.length:
            joined = np.concatenate(self.waiting)
            self.put(joined[: BATCH * self.length], BATCH * self.length)
            self.waiting = [joined[BATCH * self.length :]]
            self.waiting_ids = len(self.waiting[0])

    def put(self, ids: np.ndarray, real: int) -> None:
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(values, t.value_type), type=t)
            for values, t in ((ids, self.lists["ids"]), (np.arange(len(ids)) < real, self.lists["mask"]))
        ]
        self.stream.write_batch(pa.RecordBatch.from_arrays(arrays, ["ids", "mask"]))
        self.sequences += len(ids) // self.length

    def close(self) -> tuple[int, int, int, int]:
        if self.waiting_ids:
            rest = np.concatenate(self.waiting)
            full = np.zeros(-(-len(rest) // self.length) * self.length, dtype=self.kind)
            full[: len(rest)] = rest
            self.put(full, len(rest))
        self.stream.close()
        self.sink.close()
        columns = list(zip(*self.index)) or [[], [], []]
        table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "n_tokens"), columns)})
        with self.files.open_output_stream(f"{self.folder}/_index-{self.attempt}") as sink, pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        for name in ("tokens", "index"):
            self.files.move(f"{self.folder}/_{name}-{self.attempt}", f"{self.folder}/{name}-{self.block:06d}.arrows")
        return self.block, len(self.index), self.tokens, self.sequences


def open_stream(folder: str, name: str) -> pa.Table:
    """A stream file as a table; over a local folder the file is mapped, not read."""
    files, path = location(folder)
    if files.type_name == "local":
        return pa.ipc.open_stream(pa.memory_map(f"{path}/{name}")).read_all()
    with files.open_input_file(f"{path}/{name}") as source:
        return pa.ipc.open_stream(source).read_all()


def sequence(tokens: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of sequence i of a token file, ids without copying."""
    ids, mask = tokens.column("ids").chunk(i // BATCH), tokens.column("mask").chunk(i // BATCH)
    k, n = i % BATCH, ids.type.list_size
    return ids.values[k * n : (k + 1) * n].to_numpy(), mask.values[k * n : (k + 1) * n].to_numpy(zero_copy_only=False)


def encode_rows(path: str, end_id: int, cuts: list[int]) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        kind = width(ids_of.tokenizer.get_vocab_size())
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            docs, texts = (c.to_pylist() for c in batch.columns)
            rows = [ids_of.ids(t).astype(kind).tobytes() + end for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([range_of(d, cuts) for d in docs], pa.int32()),
                    pa.array([LEAST if d is None else d for d in docs], pa.int64()),
                    pa.array(docs, pa.int64()),
                    pa.array(rows, pa.binary()),
                ],
                ["block", "key", "doc_id", "ids"],
            )

    return encode


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Writes (doc_id, text) rows as a dataset into ``folder`` and returns its table of files."""
    from tokenizers import Tokenizer

    kind = width(Tokenizer.from_file(tokenizer).get_vocab_size())
    text_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cuts = boundaries(docs, "doc_id", per_partition=1, least=1 + text_bytes // RANGE_BYTES)
    encoded = docs.select("doc_id", "text").mapInArrow(encode_rows(tokenizer, end_id, cuts), ENCODED)
    streams = encoded.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions("block", "key", "ids")

    def write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            for block, _, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current.block != block:
                    if current is not None:
                        done.append(current.close())
                    current = SequenceFile(folder, block, kind, length)
                current.add(doc_id, np.frombuffer(ids, dtype=kind))
        if current is not None:
            done.append(current.close())
        columns = list(zip(*done)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "documents", "tokens", "sequences"])

    streams.mapInArrow(write_blocks, MANIFEST).write.parquet(f"{folder}/files.parquet")
    return files_of(docs.sparkSession, folder)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/files.parquet")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; start counts all ids before.

    The offsets of files are running sums over the table of files, a row per file.
    """
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    listed = files_of(spark, folder)
    files = listed.select("block", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), (F.row_number().over(Window.orderBy("block")) - 1).alias("place"))
    count = listed.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, base in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, index = open_stream(folder, f"tokens-{block:06d}.arrows"), open_stream(folder, f"index-{block:06d}.arrows")
                ids = [c.values.to_numpy() for c in tokens.column("ids").chunks]
                start, n = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                span = len(ids[0]) if ids else 1
                marks = []
                for a, b in zip(start.tolist(), (start + n).tolist()):
                    first, last = a // span, max(a, b - 1) // span
                    found = [ids[k][max(a - k * span, 0) : b - k * span] for k in range(first, last + 1)]
                    marks.append(crc(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays(
                    [index.column("doc_id").combine_chunks(), pa.array(start + base), index.column("n_tokens").combine_chunks(), pa.array(marks, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # A task reads a file.
    return files.repartitionById(max(1, count), F.col("place")).select("block", "base").mapInArrow(read, DOCUMENTS)
