"""Matrix files (``.npy``) as a Spark data source.

A read plans row ranges from the file headers alone; each task reads its ranges
by offset through the store's file system, so a file of any size is split.  A
folder of files is one matrix, in the order of the names.  A write puts each
task's rows into files of bounded size, named by partition, which appear
together when the job commits.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "row bigint, vector array<double>"
#: Bytes that one task reads, that it holds at a time, and that one written file has at most.
SPLIT_BYTES, BATCH_BYTES, FILE_BYTES = 128 << 20, 4 << 20, 64 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    if path.startswith("file:"):  # Hadoop writes file:/folder
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class RowRange(InputPartition):
    path: str
    kind: str
    width: int
    offset: int
    start: int
    stop: int
    first: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _header(fs: pafs.FileSystem, path: str) -> tuple[int, int, np.dtype, int]:
    """(rows, width, type, bytes of the header) of a file."""
    with fs.open_input_file(path) as file:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(file)
        if len(shape) != 2 or fortran or kind.kind not in "fiu":
            raise ValueError(f"a matrix of numbers in row order is needed: {path} has {shape}, {kind}")
        return shape[0], shape[1], kind, file.tell()


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[RowRange]:
        fs, path = _opened(self.path)
        info = fs.get_file_info(path)
        names = [path]
        if info.type == pafs.FileType.Directory:
            names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".npy"))
        elif info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out, first = [], 0
        for name in names:
            rows, width, kind, offset = _header(fs, name)
            step = max(self.split // max(width * kind.itemsize, 1), 1)
            for start in range(0, rows, step):
                out.append(RowRange(name, kind.str, width, offset, start, min(start + step, rows), first + start))
            first += rows
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty matrix
            return
        fs, _ = _opened(self.path)
        size, width = np.dtype(partition.kind).itemsize, partition.width
        step = max(BATCH_BYTES // max(width * size, 1), 1)
        with fs.open_input_file(partition.path) as file:
            file.seek(partition.offset + partition.start * width * size)
            for start in range(partition.start, partition.stop, step):
                rows = min(step, partition.stop - start)
                data = file.read(rows * width * size)
                if len(data) < rows * width * size:
                    raise ValueError(f"{partition.path} ends before its last row")
                values = pa.array(np.frombuffer(data, partition.kind).astype(np.float64))
                vectors = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * np.int32(width), values)
                number = pa.array(np.arange(rows, dtype=np.int64) + partition.first + start - partition.start)
                yield pa.RecordBatch.from_arrays([number, vectors], ["row", "vector"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, size: int, overwrite: bool):
        self.path, self.kind, self.size, self.overwrite = path, kind, size, overwrite
        self.hidden = posixpath.join(path, f"_writing_{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, folder = _opened(self.hidden)
        fs.create_dir(folder, recursive=True)
        context, waiting, held, files = TaskContext.get(), [], 0, []

        def flush() -> None:
            nonlocal waiting, held
            name = f"part-{context.partitionId():06d}-{len(files):06d}.npy"
            attempt = f"{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(posixpath.join(folder, attempt)) as out:
                np.lib.format.write_array(out, np.concatenate(waiting), allow_pickle=False)
            files.append(attempt)
            waiting, held = [], 0

        for batch in iterator:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            lengths = np.diff(vectors.offsets.to_numpy())
            if vectors.null_count or len(set(lengths.tolist())) > 1:
                raise ValueError("all rows of a matrix need a vector of one width")
            if batch.num_rows:
                waiting.append(vectors.flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(batch.num_rows, -1))
                held += waiting[-1].nbytes
                if held >= self.size:
                    flush()
        if waiting:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _opened(self.path)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if old.path.endswith(".npy"):
                    fs.delete_file(old.path)
        hidden = _opened(self.hidden)[1]
        for name in (f for m in messages if m for f in m.files):
            fs.move(posixpath.join(hidden, name), posixpath.join(folder, name.rpartition(".")[0]))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, hidden = _opened(self.hidden)
        if fs.get_file_info(hidden).type != pafs.FileType.NotFound:
            fs.delete_dir(hidden)


class MatrixSource(DataSource):
    """Options: ``path``; ``split`` and ``file`` (bytes of a read split and of a written file), ``dtype``."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("dtype", "<f4"), int(self.options.get("file", FILE_BYTES)), overwrite)


def read_matrix(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(row, vector) of a matrix file or folder."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("split", split).load(path)


def write_matrix(df: DataFrame, path: str, order: str, vector: str = "vector", dtype: str = "<f4", file: int = FILE_BYTES) -> None:
    """The vectors in the order of a column, as a folder of matrix files; all need one width."""
    df.sparkSession.dataSource.register(MatrixSource)
    rows = df.orderBy(order).select(F.lit(0).cast("bigint").alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    rows.write.format("matrix").option("dtype", dtype).option("file", file).mode("overwrite").save(path)
