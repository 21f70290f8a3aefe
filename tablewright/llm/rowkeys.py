"""Keys of the rows of a table, and rows picked by key without shuffling the table.

A row of a Parquet table is known by its file and its place in it, whoever reads it and however often. A list of rows is
written by file; a task that reads a part of a file fetches that file's list from the shared folder, so whole rows, which
hold texts, stay where they are, whatever the length of the list.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.batches import give_back, small_batches
from tablewright.session import keep, remove_at_exit, shared_folder


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name`` (file, row); a table that does not come from files is written out first."""
    at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select("*", at.alias(name))
    except AnalysisException:
        return keep(docs).select("*", at.alias(name))


class RowLists:
    """Lists of row numbers by file, with other columns of whole numbers."""

    def __init__(self, keys: DataFrame) -> None:
        """``keys``: (file, row, ...), each file and row once."""
        spark = keys.sparkSession
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        keys.repartition("file").write.partitionBy("file").parquet(self.folder)
        remove_at_exit(spark, self.folder)

    def of(self, file: int) -> np.ndarray:
        """The sorted row numbers of a file."""
        return self.columns(file, [])[0]

    def columns(self, file: int, names: list[str]) -> list[np.ndarray]:
        """The sorted row numbers of a file, and the columns ``names`` in their order."""
        from pyarrow import fs, parquet

        system, base = fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = [f.path for f in system.get_file_info(fs.FileSelector(f"{base}/file={file}", allow_not_found=True)) if f.path.endswith(".parquet")]
        if not found:
            return [np.zeros(0, np.int64) for _ in ["row", *names]]
        table = pa.concat_tables(parquet.read_table(path, filesystem=system, columns=["row", *names], partitioning=None) for path in found)
        order = np.argsort(table.column("row").to_numpy())
        return [table.column(name).to_numpy()[order] for name in ["row", *names]]


def picked(keyed: DataFrame, name: str, keys: DataFrame, listed: bool = True) -> DataFrame:
    """The rows of ``keyed`` whose key ``name`` is (not) among ``keys`` (file, row), without that column."""
    lists = RowLists(keys)
    columns = [c for c in keyed.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            files, at = (batch.column(batch.num_columns - 1).field(k).to_numpy() for k in (0, 1))
            mask = np.zeros(len(files), bool)
            for file in np.unique(files).tolist():
                if file != now:
                    now, rows = file, lists.of(file)
                own = files == file
                mask[own] = np.isin(at[own], rows, assume_unique=False)
            rest = batch.select(list(range(batch.num_columns - 1)))
            yield rest.filter(pa.array(mask if listed else ~mask))
        give_back()

    small_batches(keyed.sparkSession)
    rows = keyed.select(*[F.col(f"`{c}`") for c in [*columns, name]])
    return rows.mapInArrow(run, rows.drop(name).schema)


def worked(keyed: DataFrame, name: str, lists: RowLists, more: list[str], work: Callable, schema: str) -> DataFrame:
    """``work`` over the Arrow batches of the rows of ``keyed`` whose key ``name`` is in ``lists``, which have the columns ``more`` of the lists for the key.

    Rows are looked up in the Python process that works on them, so a task has one.
    """

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, [np.zeros(0, np.int64)]
        for batch in batches:
            files, at = (batch.column(batch.num_columns - 1).field(k).to_numpy() for k in (0, 1))
            rest = batch.select(list(range(batch.num_columns - 1)))
            for file in np.unique(files).tolist():
                if file != now:
                    now, known = file, lists.columns(file, more)
                own = np.flatnonzero(files == file)
                own = own[np.isin(at[own], known[0])]
                found = np.searchsorted(known[0], at[own])
                taken = rest.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(column[found]) for column in known[1:])], names=[*rest.schema.names, *more])

    small_batches(keyed.sparkSession)
    rows = keyed.select(*[F.col(f"`{c}`") for c in [*(c for c in keyed.columns if c != name), name]])
    return rows.mapInArrow(lambda batches: work(looked_up(batches)), schema)
