"""Feather and NPZ files as data sources: ``spark.read.format("feather")`` and ``"npz"``, and the same to write.

A Feather file is one task a record batch, an NPZ file one task; only the columns of the schema are read.  Each task
writes files of its own, under names that no other attempt has, and files of a failed write are taken away again.
Folders are any that Arrow's file systems reach (local and shared paths, ``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

FILE_ROWS = 1 << 17


def _system(path: str) -> tuple[fs.FileSystem, str]:
    # Spark writes local paths with one slash behind the scheme, too
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(path: str, ending: str) -> list[str]:
    """The files with an ending of a folder and those below, in order of names; or the one file.  Hidden ones are left out."""
    system, at = _system(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(ending) and not f.base_name.startswith(("_", ".")))


@dataclass
class Piece(InputPartition):
    file: str
    batch: int = 0


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema


class FeatherReader(_Reader):
    def partitions(self) -> list[Piece]:
        out = []
        for file in _files(self.path, ".feather"):
            with _system(self.path)[0].open_input_file(file) as f:
                out += [Piece(file, b) for b in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # no file holds a row
            return
        want = to_arrow_schema(self.schema)
        with _system(self.path)[0].open_input_file(piece.file) as f:
            have = pa.ipc.open_file(f).schema
            options = pa.ipc.IpcReadOptions(included_fields=[have.get_field_index(n) for n in want.names])
            batch = pa.ipc.open_file(f, options=options).get_batch(piece.batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)).cast(want.field(n).type) for n in want.names], schema=want)


class NpzReader(_Reader):
    def partitions(self) -> list[Piece]:
        return [Piece(file) for file in _files(self.path, ".npz")]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        want = to_arrow_schema(self.schema)
        with _system(self.path)[0].open_input_file(piece.file) as f, np.load(f, allow_pickle=False) as arrays:
            taken = {n: arrays[n] for n in want.names}  # an array is read when it is asked for
        rows = {len(a) for a in taken.values()}
        if len(rows) > 1:
            raise ValueError(f"{piece.file}: arrays of {sorted(rows)} rows")
        for at in range(0, max(rows, default=0), 8192):
            yield pa.RecordBatch.from_arrays([_nested(taken[n][at : at + 8192]).cast(want.field(n).type) for n in want.names], schema=want)


def _nested(a: np.ndarray) -> pa.Array:
    """Rows of an array; further axes become lists."""
    flat = pa.array(np.ascontiguousarray(a).reshape(-1))
    for axis in range(a.ndim - 1, 0, -1):
        ends = np.arange(0, int(np.prod(a.shape[:axis])) * a.shape[axis] + 1, a.shape[axis]) if a.shape[axis] else np.zeros(int(np.prod(a.shape[:axis])) + 1, int)
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return flat


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.mark = path, overwrite, uuid.uuid4().hex

    def _new(self, ending: str) -> tuple[fs.FileSystem, str]:
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        return system, f"{at.rstrip('/')}/part-{self.mark}-{uuid.uuid4().hex}{ending}"

    def commit(self, messages: list[Written | None]) -> None:
        """Keep the files of the attempts that count; those of lost attempts, and with ``overwrite`` all older ones, go."""
        system, at = _system(self.path)
        kept = {f for m in messages if m is not None for f in m.files}
        for file in _files(self.path, self.ending) if system.get_file_info(at).type == fs.FileType.Directory else []:
            if file not in kept and (self.overwrite or self.mark in file):
                system.delete_file(file)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _system(self.path)
        for file in _files(self.path, self.ending) if system.get_file_info(at).type == fs.FileType.Directory else []:
            if self.mark in file:
                system.delete_file(file)


class FeatherWriter(_Writer):
    ending = ".feather"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, file, out = *self._new(self.ending), None
        for batch in batches:
            if out is None:
                stream = system.open_output_stream(file)
                out = pa.ipc.new_file(stream, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            out.write_batch(batch)
        if out is None:
            return Written([])
        out.close()
        stream.close()
        return Written([file])


class NpzWriter(_Writer):
    """Files of at most ``FILE_ROWS`` rows, an array a column; lists must be of one length, and no value NULL."""

    ending = ".npz"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        held, rows, files = [], 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, FILE_ROWS):
                piece = batch.slice(at, FILE_ROWS)
                if rows and rows + piece.num_rows > FILE_ROWS:
                    files.append(self._save(held))
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if rows:
            files.append(self._save(held))
        return Written(files)

    def _save(self, held: list[pa.RecordBatch]) -> str:
        system, file = self._new(self.ending)
        table = pa.Table.from_batches(held).combine_chunks()
        with system.open_output_stream(file) as f:
            np.savez_compressed(_Appended(f), **{n: _array(n, table.column(n).combine_chunks()) for n in table.column_names})
        return file


def _array(name: str, column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        raise ValueError(f"{name}: an array has no NULL")
    if pa.types.is_list(column.type):
        sizes = set(np.unique(np.diff(np.asarray(column.offsets))).tolist())
        if len(sizes) > 1:
            raise ValueError(f"{name}: lists of {sorted(sizes)} values")
        return _array(name, column.flatten()).reshape(len(column), *sizes or {0}, *([] if not pa.types.is_list(column.type.value_type) else [-1]))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


class _Appended:
    """A stream that ``zipfile`` can only append to, as Arrow's output streams do not seek."""

    def __init__(self, f):
        self.f = f

    def write(self, data) -> int:
        self.f.write(data)
        return len(data)

    def flush(self) -> None:
        self.f.flush()

    def read(self, *_):
        raise OSError("a stream to write to")


class FeatherSource(DataSource):
    reader_class, writer_class, ending = FeatherReader, FeatherWriter, ".feather"

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> T.StructType:
        """That of the first file."""
        files = _files(self.options["path"], self.ending)
        if not files:
            raise ValueError(f"no {self.ending} files in {self.options['path']}")
        with _system(self.options["path"])[0].open_input_file(files[0]) as f:
            return self.schema_of(f)

    def schema_of(self, f) -> T.StructType:
        return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return self.reader_class(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return self.writer_class(self.options["path"], overwrite)


class NpzSource(FeatherSource):
    reader_class, writer_class, ending = NpzReader, NpzWriter, ".npz"

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema_of(self, f) -> T.StructType:
        with np.load(f, allow_pickle=False) as arrays:
            return from_arrow_schema(pa.schema([(n, _nested(arrays[n][:1]).type) for n in arrays.files]))


def register(spark: SparkSession) -> None:
    for source in (FeatherSource, NpzSource):
        spark.dataSource.register(source)


def read_files(spark: SparkSession, kind: str, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Files of ``kind`` (feather or npz) of a folder; only ``columns`` are read, if given."""
    register(spark)
    if columns is None:
        return spark.read.format(kind).load(path)
    known = {"feather": FeatherSource, "npz": NpzSource}[kind]({"path": path}).schema()
    return spark.read.format(kind).schema(T.StructType([known[c] for c in columns])).load(path)


def write_files(df: DataFrame, kind: str, path: str, mode: str = "overwrite") -> None:
    register(df.sparkSession)
    df.write.format(kind).mode(mode).save(path)
