"""Exact top-k search by a bit-sliced index (O'Neil and Quass, 1997).

Rows are indexed in blocks where they are read: a block's index has, for each attribute and each bit of its quantised value, a bitmap over the block's rows. A query adds the bitmaps that its own bits pick, by weight, with carry-save adders; the sums are again slices, and from the most significant one downward the best k rows are selected. Rows that tie at the boundary are resolved exactly, by the smaller id.

The index stays where it is: blocks of queries are broadcast past it, a bounded number at a time, and k rows for each query and index block are all that moves. Rows of equal vectors are indexed once, with their k + 1 smallest ids, as no more of them can be among a query's best.

Vectors that are null or hold null or non-finite components, or whose length differs from the most common one, take no part, nor do null ids. Of rows that repeat an id the one with the least vector counts. A component so large that a score might not fit in 64 bits stops the job with a message that says so. An empty table gives no rows; columns other than the id and the vector take no part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import stored, table

BLOCK_ROWS = 8_192
BLOCK_QUERIES = 256
#: Components of the queries that are broadcast at once.
SENT_COMPONENTS = 4_000_000


def usable(vectors: DataFrame, id_col: str, vec_col: str, kind: str = "double") -> DataFrame:
    """id and v (array of kind) of the vectors that take part, one for each id."""
    v = F.col(vec_col).cast(f"array<{kind}>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def usual_size(vectors: DataFrame) -> int:
    found = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return int(found["n"]) if found else 0


def classes(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of equal vectors as one: v and their k smallest ids. Only k rows of a vector leave a task, however many there are."""
    order = Window.partitionBy(key).orderBy("id")
    kept = vectors.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list("id")).alias("ids"))


# ---- bitmaps


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(attributes, bits, words): bitmaps of non-negative values (rows, attributes)."""
    n, d = values.shape
    words = -(-n // 64)
    padded = np.zeros((words * 64, d), dtype=np.int64)
    padded[:n] = values
    out = np.empty((d, bits, words), dtype=np.uint64)
    for j in range(bits):
        out[:, j] = np.packbits(np.ascontiguousarray(((padded >> j) & 1).astype(np.uint8).T), axis=1, bitorder="little").view(np.uint64)
    return out


def added(by_weight: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Slices, least significant first, of the sum of bitmaps (n, words) by weight: three of a weight become one of it and one of the next."""
    out, weight = [], 0
    while by_weight:
        maps = by_weight.pop(weight, None)
        if maps is None:
            out.append(None)
            weight += 1
            continue
        carries = []
        while len(maps) > 2:
            n = len(maps) // 3
            a, b, c = maps[:n], maps[n : 2 * n], maps[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            maps = np.concatenate([half ^ c, maps[3 * n :]])
        if len(maps) == 2:
            carries.append((maps[:1] & maps[1:]))
            maps = maps[:1] ^ maps[1:]
        out.append(maps[0])
        if carries:
            above = by_weight.get(weight + 1)
            by_weight[weight + 1] = np.concatenate([*carries, above] if above is not None else carries)
        weight += 1
    words = len(next(x for x in out if x is not None)) if out else 0
    return [x if x is not None else np.zeros(words, dtype=np.uint64) for x in out]


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows of `among` with the k largest sums, and of all that tie with the last."""
    sure, maybe = np.zeros_like(among), among.copy()
    for s in reversed(slices):
        high = maybe & s
        n = count(sure) + count(high)
        if n > k:
            maybe = high
        else:
            sure |= high
            maybe &= ~s
            if n == k:
                maybe[:] = 0
                break
    return np.flatnonzero(np.unpackbits((sure | maybe).view(np.uint8), bitorder="little"))


class Block:
    """The index of one block's rows."""

    def __init__(self, slices: np.ndarray, n: int, low: np.ndarray) -> None:
        self.slices, self.n, self.low = slices, n, low
        full = np.full(slices.shape[2], 2**64 - 1, dtype=np.uint64)
        if n % 64:
            full[-1] = np.uint64((1 << n % 64) - 1)
        self.full = full

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of q . v, less a constant, over the block. A negative q counts the complement of an attribute instead, which adds another constant."""
        d, bits, _ = self.slices.shape
        size = np.abs(q)
        top = (1 << bits) - 1
        constant = int((q * self.low).sum()) - int(size[q < 0].sum()) * top
        source = self.slices ^ np.where(q < 0, np.uint64(2**64 - 1), np.uint64(0))[:, None, None]
        by_weight: dict[int, list] = {}
        for i in range(int(size.max(initial=0)).bit_length()):
            some = np.flatnonzero((size >> i) & 1)
            for j in range(bits):
                by_weight.setdefault(i + j, []).append(source[some, j])
        return added({w: np.concatenate(x) for w, x in by_weight.items() if sum(map(len, x))}), constant

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, and of all that tie with the last."""
        slices, constant = self.sums(q)
        rows = top_rows(slices, self.full, k)
        score = np.full(len(rows), constant, dtype=np.int64)
        for j, s in enumerate(slices):
            score += ((s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
        return rows, score


# ---- jobs


def index_blocks(rows: DataFrame, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index of rows (q: array of bigint, ids): block, n, bits, low (least value of each attribute), slices, and the rows' ids. Blocks are cut from each task's rows in the order it reads them, so nothing moves."""

    def run(batches):
        task, nth, held = TaskContext.get().partitionId(), 0, []

        def block(part: pa.Table) -> pa.RecordBatch:
            nonlocal nth
            values = part.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            low = values.min(axis=0)
            bits = max(1, int((values - low).max()).bit_length())
            nth += 1
            columns = [[(task << 32) + nth], [len(values)], [bits], [low.tolist()], [slices_of(values - low, bits).tobytes()], [part.column("ids").to_pylist()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.int64()))), strict=True)], names=["block", "n", "bits", "low", "slices", "ids"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            whole = pa.concat_tables(held)
            while whole.num_rows >= block_rows:
                yield block(whole.slice(0, block_rows))
                whole = whole.slice(block_rows)
            held = [whole]
        if held and held[0].num_rows:
            yield block(held[0])

    return rows.select("q", "ids").mapInArrow(run, "block bigint, n int, bits int, low array<bigint>, slices binary, ids array<array<bigint>>")


def search(index: DataFrame, queries: DataFrame, size: int, k: int, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the index with the largest inner products with each of queries (id, q), without rows of the query's own id."""
    spark = index.sparkSession
    n_blocks, n_queries = index.count(), queries.count()
    groups = max(1, -(-n_queries // block_queries))
    at_once = max(1, SENT_COMPONENTS // (block_queries * size))
    asked = stored(queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("id", "q")).alias("asked")), "bitsliced-asked")  # about block_queries in each
    spread = index.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_blocks, 10_000)), "block")

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            for b in batch.to_pylist():
                block = Block(np.frombuffer(b["slices"], dtype=np.uint64).reshape(size, b["bits"], -1), b["n"], np.array(b["low"], dtype=np.int64))
                for own in b["asked"]:
                    # rows of one vector share a score, so the best k + 1 vectors hold the best k rows of another id
                    rows, score = block.best(np.array(own["q"], dtype=np.int64), k + 1)
                    found = sorted(((-s, i) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for i in b["ids"][r] if i != own["id"]))[:k]
                    out["query_id"] += [own["id"]] * len(found)
                    out["vec_id"] += [i for _, i in found]
                    out["score"] += [-s for s, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], names=list(out))

    found = None
    for first in range(0, groups, at_once):
        some = asked.where(F.col("group").between(first, first + at_once - 1)).select("asked")
        part = spread.crossJoin(F.broadcast(some)).mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every query row's k best other rows by the inner product of floor(scale * component)."""
    fine = stored(usable(vectors, id_col, vec_col), "vectors")
    size = usual_size(fine) or 1
    most = float(int((2**63 / size) ** 0.5) - 1)  # size products of it fit in 64 bits
    component = lambda x: F.when(F.abs(x) * scale < most, F.floor(F.lit(scale) * x).cast("bigint")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("bigint"))
    q = fine.where(F.size("v") == size).select("id", F.transform("v", component).alias("q"))
    rows = stored(classes(q, "q", k + 1), "bitsliced-classes")
    index = stored(index_blocks(rows.repartition(max(1, -(-rows.count() // BLOCK_ROWS))), size), "bitslices")
    queries = stored(q.where(is_query(F.col("id"))), "bitsliced-queries")
    return search(index, queries, size, k)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5, 256)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
