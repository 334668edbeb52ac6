"""NPZ archives as a Spark data source: `spark.read.format("npz")` and `df.write.format("npz")`, after `register(spark)`.

A path is an archive or a folder of archives. Each array is cut along its first axis into chunks of CHUNK_BYTES, each of which is a partition that seeks to its rows, so that an array of any size is read by many tasks. A row is one entry of the first axis: array (its name), index, shape (of one entry), values (flattened, row by row; of numbers) or texts (of strings). Arrays without dimensions are one entry.

A write makes an archive for each task, with the rows of each array side by side and their indices beside them as `<array>.index`; archives take their names when the whole write is done, and are deleted if it fails. Reading a folder gives the rows of all its archives. An entry's shape is that of its array, so within a task all entries of an array have one shape. Null values are NaN in an archive. A folder without archives has no rows."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "array STRING, index BIGINT, shape ARRAY<BIGINT>, values ARRAY<DOUBLE>, texts ARRAY<STRING>"
CHUNK_BYTES = 32 << 20
INDEX = ".index"


def located(path: str):
    """File system and path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    from pyarrow import fs

    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".npz"))


def header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](f)


@dataclass
class Chunk(InputPartition):
    file: str
    array: str
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Chunk]:
        """From the archives' headers alone."""
        system, _ = located(self.path)
        out = []
        for file in archives(self.path):
            with system.open_input_file(file) as raw, zipfile.ZipFile(raw) as z:
                for entry in z.namelist():
                    name = entry.removesuffix(".npy")
                    if name.endswith(INDEX):
                        continue
                    with z.open(entry) as f:
                        shape, column_first, kind = header(f)
                    n = shape[0] if shape else 1
                    each = n if column_first and len(shape) > 1 else max(1, CHUNK_BYTES // max(1, kind.itemsize * int(np.prod(shape[1:]))))
                    out += [Chunk(file, name, a, min(a + each, n)) for a in range(0, n, max(each, 1))]
        return out or [Chunk("", "", 0, 0)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.file) as raw, zipfile.ZipFile(raw) as z:
            x, shape = rows_of(z, partition.array, partition.start, partition.stop)
            index = np.arange(partition.start, partition.stop)
            if f"{partition.array}{INDEX}.npy" in z.namelist():
                index, _ = rows_of(z, f"{partition.array}{INDEX}", partition.start, partition.stop)
        n, flat = len(x), x.reshape(len(x), -1)
        offsets = np.arange(n + 1, dtype=np.int32) * flat.shape[1]
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v, t))
        words = x.dtype.kind in "US"
        values = pa.nulls(n, pa.list_(pa.float64())) if words else lists(flat.ravel().astype(float), pa.float64())
        texts = lists(flat.ravel().astype(str).tolist(), pa.string()) if words else pa.nulls(n, pa.list_(pa.string()))
        whole = pa.RecordBatch.from_arrays([pa.array([partition.array] * n), pa.array(index.astype(np.int64)), pa.array([list(shape)] * n, pa.list_(pa.int64())), values, texts], names=["array", "index", "shape", "values", "texts"])
        for a in range(0, n, 1024):
            yield whole.slice(a, 1024)


def rows_of(z: zipfile.ZipFile, name: str, start: int, stop: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """Entries start to stop of an array, and the shape of one."""
    with z.open(f"{name}.npy") as f:
        shape, column_first, kind = header(f)
        if column_first and len(shape) > 1:  # such an array is read as a whole
            f.seek(0)
            return np.lib.format.read_array(f, allow_pickle=False)[start:stop], shape[1:]
        size = kind.itemsize * int(np.prod(shape[1:]))
        f.seek(f.tell() + start * size)
        return np.frombuffer(f.read((stop - start) * size), dtype=kind).reshape((stop - start, *shape[1:])), shape[1:]


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held: dict[str, list] = {}
        for batch in iterator:
            for r in batch.to_pylist():
                held.setdefault(r["array"], []).append((r["index"], r["shape"], r["values"] if r["texts"] is None else r["texts"]))
        if not held:
            return Written(None)
        system, at = located(self.path)
        system.create_dir(at, recursive=True)
        file = posixpath.join(at, f"_{uuid.uuid4().hex}.tmp")
        arrays = {}
        for name, rows in held.items():
            shapes = {tuple(s or ()) for _, s, _ in rows}
            if len(shapes) > 1:
                raise ValueError(f"entries of {name} differ in shape")
            shape = next(iter(shapes))
            flat = [np.nan if v is None and not isinstance(x[0], str) else v for _, _, x in rows for v in x] if any(v is None for _, _, x in rows for v in x) else [v for _, _, x in rows for v in x]
            arrays[name] = np.array(flat).reshape((len(rows), *shape))
            arrays[name + INDEX] = np.array([i for i, _, _ in rows], dtype=np.int64)
        with system.open_output_stream(file) as out:
            body = io.BytesIO()
            np.savez(body, **arrays)
            out.write(body.getvalue())
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = located(self.path)
        if self.overwrite:
            for old in archives(self.path) if system.get_file_info(at).type.name == "Directory" else []:
                system.delete_file(old)
        for m in messages:
            if m and m.file:
                system.move(m.file, m.file.replace("/_", "/part-").removesuffix(".tmp") + ".npz")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(m.file)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)


def read_npz(spark: SparkSession, path: str, array: str | None = None) -> DataFrame:
    """Rows of all arrays, or of one, of an archive or a folder of them."""
    register(spark)
    df = spark.read.format("npz").load(path)
    return df if array is None else df.where(F.col("array") == array)


def write_npz(df: DataFrame, path: str, mode: str = "append") -> None:
    """df: array, index, shape, values, and texts if there are any."""
    register(df.sparkSession)
    if "texts" not in df.columns:
        df = df.withColumn("texts", F.lit(None).cast("array<string>"))
    df.select("array", F.col("index").cast("bigint").alias("index"), F.col("shape").cast("array<bigint>").alias("shape"), F.col("values").cast("array<double>").alias("values"), "texts").write.format("npz").mode(mode).save(path)


def entries(df: DataFrame, array: str | Column, index: str, x: str, dimensions: int) -> DataFrame:
    """Rows of write_npz from a column of nested arrays of so many dimensions; array: the name, or a column of names."""
    shape, inner = [], F.col(x)
    for _ in range(dimensions):
        shape.append(F.size(inner))
        inner = inner[0]
    flat = F.col(x)
    for _ in range(dimensions - 1):
        flat = F.flatten(flat)
    return df.select((F.lit(array) if isinstance(array, str) else array).alias("array"), F.col(index).cast("bigint").alias("index"), F.array(*shape).cast("array<bigint>").alias("shape"), F.transform(flat, lambda v: v.cast("double")).alias("values"))


def shaped(values, shape):
    """Two-dimensional nested arrays of values again."""
    return F.transform(F.sequence(F.lit(0), F.get(shape, F.lit(0)).cast("int") - 1), lambda i: F.slice(values, i * F.get(shape, F.lit(1)).cast("int") + 1, F.get(shape, F.lit(1)).cast("int")))
