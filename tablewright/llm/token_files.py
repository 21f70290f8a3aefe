"""Token ids as Arrow files of equal-length sequences, with masks, read back without a copy.

Texts are range-partitioned and sorted by document id, encoded in that order, each document closed by an end id, and
written as one long row of ids that is cut every ``LENGTH`` ids: a file a partition in Arrow's file format (the stream
format with a footer), whose batches hold two fixed-size lists, ``ids`` of 16 bits where the vocabulary allows, else of
32, and ``mask``, one bit an id, false on the padding that fills the last sequence of a file. Buffers are not
compressed, so sequence i is found by arithmetic and is a view of the mapped file (``TokenFile``). A second file
beside it lists the documents: id, place of the first id, number of ids.

A partition's files are written under names of the attempt and renamed at the end, and the manifest names only those
whose task ended, so a lost executor costs a repeated task. The manifest has a row a file; the place of a file's first
id among all is a running sum over these rows.

Null and empty texts are one end id. Null document ids come first; rows with equal ids are rows of their own, in any
order; other columns are ignored; an empty table gives no rows. A task holds a piece of text and the sequences of one
batch, however long the document or the file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.llm.batches import pieces, small_batches
from tablewright.llm.runs import shared_encoder
from tablewright.session import keep, remove_at_exit, shared_folder

#: Ids of a sequence (a multiple of eight, so that masks start on whole bytes); sequences of a batch.
LENGTH, BATCH_SEQUENCES = 2048, 256
END_ID = 0


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer:
    """Appends ids to one file, a batch of whole sequences at a time."""

    def __init__(self, sink: pa.NativeFile, dtype: str, length: int) -> None:
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.buffer = np.zeros(length * BATCH_SEQUENCES, self.dtype)
        self.filled = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.written += len(ids)
        while len(ids):
            some = ids[: len(self.buffer) - self.filled]
            self.buffer[self.filled : self.filled + len(some)] = some
            self.filled += len(some)
            ids = ids[len(some) :]
            if self.filled == len(self.buffer):
                self.flush()

    def flush(self) -> None:
        if not self.filled:
            return
        stop = -(-self.filled // self.length) * self.length
        self.buffer[self.filled : stop] = 0
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.buffer[:stop], np.arange(stop) < self.filled)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.filled = 0

    def close(self) -> None:
        self.flush()
        self.file.close()


class TokenFile:
    """One file of sequences, mapped into memory where its storage is local; views share the file's memory."""

    def __init__(self, path: str) -> None:
        system, name = _place(path)
        self.source = pa.memory_map(name) if system.type_name == "local" else system.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches

    def batch(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """All ids of a batch, and its mask, one after the other."""
        found = self.file.get_batch(number)
        return found.column("ids").flatten().to_numpy(zero_copy_only=True), found.column("mask").flatten()

    def __len__(self) -> int:
        return (self.batches - 1) * BATCH_SEQUENCES + self.file.get_batch(self.batches - 1).num_rows if self.batches else 0

    def __getitem__(self, sequence: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of one sequence."""
        if not 0 <= sequence < len(self):
            raise IndexError(sequence)
        ids, mask = self.batch(sequence // BATCH_SEQUENCES)
        start = sequence % BATCH_SEQUENCES * self.length
        return ids[start : start + self.length], mask.slice(start, self.length)

    def close(self) -> None:
        self.source.close()


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` under ``folder``; the manifest: (file, documents, part, n_docs, n_tokens, start) a file, in order of ``part``."""
    if length % 8:
        raise ValueError("the length of a sequence has to be a multiple of eight")
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = _place(folder)
        names = [f"{base}/part-{task.partitionId():06d}.{kind}.arrow" for kind in ("ids", "documents")]
        drafts = [f"{name}.{task.taskAttemptId()}" for name in names]
        encoder = shared_encoder(path)
        dtype, end = ("<u2" if encoder.size <= 1 << 16 else "<u4"), np.array([end_id], "<u4")
        index = pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with system.open_output_stream(drafts[0]) as sink, system.open_output_stream(drafts[1]) as listing:
            writer, lister = _Writer(sink, dtype, length), pa.ipc.new_file(listing, index)
            for batch in pieces(batches):
                first, sizes = [], []
                for ids in encoder.encode([text or "" for text in batch.column(1).to_pylist()]):
                    first.append(writer.written)
                    writer.add(np.frombuffer(ids, "<u4"))
                    writer.add(end)
                    sizes.append(writer.written - first[-1])
                lister.write_batch(pa.record_batch([batch.column(0).cast(id_type), pa.array(first, pa.int64()), pa.array(sizes, pa.int64())], schema=index))
                n_docs += batch.num_rows
            writer.close()
            lister.close()
        for draft, name in zip(drafts, names):
            if n_docs:
                system.move(draft, name)
            else:
                system.delete_file(draft)
        if n_docs:
            files = [f"{folder}/{name.rsplit('/', 1)[1]}" for name in names]
            yield pa.RecordBatch.from_pydict({"file": files[:1], "documents": files[1:], "part": [task.partitionId()], "n_docs": [n_docs], "n_tokens": [writer.written]})

    small_batches(docs.sparkSession)
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("seq"))
    ordered = rows.repartitionByRange("id", "seq").sortWithinPartitions("id", "seq").select("id", "text")
    written = keep(ordered.mapInArrow(run, "file string, documents string, part long, n_docs long, n_tokens long"))
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")  # a row a file
    return keep(written.withColumn("start", before))


def read(manifest: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files that ``manifest`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["file"])
                system, name = _place(row["documents"])
                at, ids, base = -1, np.zeros(0, np.uint16), 0
                with system.open_input_file(name) as source:
                    listing = pa.ipc.open_file(source)
                    for number in range(listing.num_record_batches):
                        some = listing.get_batch(number)
                        sums = []
                        for first, size in zip(some.column("first").to_pylist(), some.column("n_tokens").to_pylist()):
                            crc = 0
                            while size:
                                if first >= base + len(ids):
                                    base, at = base + len(ids), at + 1
                                    ids = tokens.batch(at)[0]
                                piece = ids[first - base : first - base + size]
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                                first, size = first + len(piece), size - len(piece)
                            sums.append(crc)
                        start = pa.array(some.column("first").to_numpy() + row["start"])
                        yield pa.RecordBatch.from_arrays([some.column("doc_id"), start, some.column("n_tokens"), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])
                tokens.close()

    # the manifest is a few rows a task of the writing, and each of its rows is a file of work
    spread = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return spread.mapInArrow(run, f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` written to the shared folder and read back; the files go when the program ends."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    return read(write(docs, path, folder, end_id, length, id_col, text_col), docs.schema[id_col].dataType.simpleString(), id_col)
