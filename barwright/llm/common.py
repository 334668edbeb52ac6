"""Tables, shared-folder checkpoints and text batches that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that a Python worker handles at once; a longer single text is a batch of its own.
CHUNK_CHARS = 400_000
#: Bytes that Spark sends to a Python worker at once.
SENT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python of SENT_BYTES at most, as rows may be long texts. A lesser bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= SENT_BYTES:
        spark.conf.set(name, f"{SENT_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is set, as in tests, a local one will do if everything runs on one machine, and nothing else will."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read again. A lost executor costs nothing that is stored."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/barwright/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, what: str, key: str) -> tuple[DataFrame, str]:
    """As `stored`, in as many buckets by key as there are shuffle partitions, so that joins on the key don't move these rows; and the name of the table, to be dropped from the catalogue after its last use, which leaves the files."""
    spark = df.sparkSession
    bound_batches(spark)
    name = f"{what.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/barwright/{name}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet")
    writer.option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), name


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None]], chars: int = CHUNK_CHARS) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: make() runs once a task and gives what turns a batch, of about so many characters, into rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in by_chars(batch, chars):
                out = work(part)
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        give_back()

    return run


def give_back() -> None:
    """Lets the system have what a worker, which lives on for other tasks, has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_chars(batch: pa.RecordBatch, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a column named text of about so many bytes each; a batch without one as it is."""
    return by_bytes(batch, "text", chars) if "text" in batch.schema.names else iter([batch] if batch.num_rows else [])


def by_bytes(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes each in a column. No row is cut."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(name))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null reads as an empty text."""
    return [x or "" for x in batch.column(batch.schema.names.index(name)).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the filter in `sifted`; what is broadcast is a 64th as many rows, whatever the tables' sizes.
SIEVE_BITS = 1 << 23


def sifted(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two parts: rows whose id may be among ids (a column named id), and rows whose id is not. A join of the first part with ids gives what one of docs would, but moves fewer texts.

    The filter is one bit for each hash of an id; where it fills up, the second part is empty and nothing else changes."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(SIEVE_BITS))
    word, bits = fresh(docs, "_word"), fresh(docs, "_bits")
    at = ids.select(place("id").alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).alias(word)).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias(bits))
    marked = docs.join(F.broadcast(words), F.floor(place(id_col) / 64) == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place(id_col) % 64).cast("int"))) != 0, F.lit(False))
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
