"""Packing of token ids into sequences of a fixed capacity.

The plan is made from how many pieces have each length, of which there are no more than the capacity, so it is as small for 100 TB as for a test; pieces find their places in it by (length, rank among that length). Ranks come from the stored pieces: each task numbers its own pieces of each length, and a running sum over tasks does the rest. No row passes through the driver.

Null and empty texts are a single id 0. A text longer than a sequence, however long, is cut into pieces. Repeated rows are packed as often as they occur; pieces of equal length are of equal rank to the plan, and which of them goes where is left open; an empty table gives no rows; columns other than the id and the text take no part."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import expand, per_batch, stored, table, texts_of
from barwright.llm.tokens import library_ids

END_ID = 0


# ---- pieces


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, keep_ids: bool = False, end_id: int = END_ID) -> DataFrame:
    """A document's ids and end_id after them, uncut up to the capacity, else in pieces of it, of which the first may be shorter.

    doc_id, piece, start, length, ids_crc32, and part and nth: the task and the number of the piece among its task's of that length. With keep_ids also ids, as little-endian integers of id_type(tokenizer)."""
    narrow = id_type(tokenizer)

    def make():
        encode, part, seen = library_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)

        def work(batch: pa.RecordBatch) -> pa.Table:
            ids, at = encode(texts_of(batch))
            n = np.diff(at) + 1
            flat = np.full(int(n.sum()), end_id, dtype="<u4")
            flat[expand(np.cumsum(n) - n, n - 1)] = ids
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = expand(np.zeros(len(n), dtype=np.int64), count)
            short = (n - (count - 1) * capacity)[doc]
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            length = np.where(piece == 0, short, capacity)
            order = np.argsort(length, kind="stable")
            of = length[order]
            nth = np.empty(len(of), dtype=np.int64)
            nth[order] = seen[of] + np.arange(len(of)) - np.searchsorted(of, of)
            seen[:] += np.bincount(length, minlength=capacity + 1)
            a = (np.cumsum(n) - n)[doc] + start
            raw = [flat[x:y].tobytes() for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
            columns = {"doc_id": batch.column(0).take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": pa.array(map(zlib.crc32, raw), pa.int64()), "part": np.full(len(doc), part, dtype=np.int32), "nth": nth}
            return pa.table(columns | ({"ids": pa.array([np.frombuffer(x, dtype="<u4").astype(narrow).tobytes() for x in raw], pa.binary())} if keep_ids else {}))

        return work

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids binary" * keep_ids
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(per_batch(make), schema)


def id_type(tokenizer: str) -> str:
    """Two bytes an id where the largest fits in them, so that half as much moves."""
    return "<u2" if library_ids(tokenizer).largest() < 1 << 16 else "<u4"


# ---- plans


class GapTree:
    """A segment tree over capacities: how many bins have each gap, and the least gap of a size or more."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.leaves, dtype=np.int64)

    def add(self, gap: int, bins: int) -> None:
        at = self.leaves + gap
        while at:
            self.count[at] += bins
            at //= 2

    def least(self, size: int) -> int | None:
        at = self.leaves + size
        if self.count[at]:
            return size
        while at > 1 and (at % 2 or not self.count[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


class Plan:
    """Rows (length, first rank, one past the last, first bin, items a bin, offset in it); bins of equal content are a range."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.rows = capacity, 0, []
        self.tree = GapTree(capacity)
        self.open: dict[int, list[tuple[int, int]]] = {}  # by gap, ranges of bins: first, how many
        self.used: dict[int, int] = {}

    def new(self, n: int) -> tuple[int, int]:
        self.bins += n
        return self.bins - n, n

    def give(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            self.open.setdefault(gap, []).append((first, n))
            self.tree.add(gap, n)

    def put(self, length: int, n: int, first: int, each: int, gap: int) -> None:
        """n items, `each` to a bin, into the bins from `first` on, whose gap that is; what is left of those gaps is not recorded."""
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, rank + n, first, each, self.capacity - gap))
        self.used[length] = rank + n

    def best_fit(self, length: int, n: int) -> None:
        """n items, one after another each into the least gap that holds it, or into a new bin. An item's bin stays the least gap for the next, so a bin takes as many as it holds."""
        while n:
            gap = self.tree.least(length)
            if gap is None:
                gap = self.capacity
                first, bins = self.new(-(-n // (gap // length)))
            else:
                first, bins = self.open[gap].pop()
                self.tree.add(gap, -bins)
            each = gap // length
            full, rest = divmod(min(n, bins * each), each)
            if full:
                self.put(length, full * each, first, each, gap)
                self.give(gap - each * length, first, full)
            if rest:
                self.put(length, rest, first + full, rest, gap)
                self.give(gap - rest * length, first + full, 1)
            left = bins - full - (rest > 0)
            self.give(gap, first + full + (rest > 0), left)
            n -= full * each + rest

    def array(self) -> np.ndarray:
        return np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 6)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(capacity)
    for length in sorted(counts, reverse=True):
        plan.best_fit(length, counts[length])
    return plan


def large_item_matching(counts: dict[int, int], capacity: int) -> Plan:
    """Items above a third of the capacity, of which a bin holds two at most, are matched greedily: the largest first, each with the largest that fits; the smaller ones fill the gaps by best fit, the largest first."""
    plan = Plan(capacity)
    left = {k: n for k, n in counts.items() if n and 3 * k > capacity}
    sizes = sorted(left)
    while sizes:
        a = sizes[-1]
        at = bisect.bisect_right(sizes, capacity - a) - 1
        b = sizes[at] if at >= 0 else None
        if b is None:
            n = left[a]
            first, _ = plan.new(n)
            plan.put(a, n, first, 1, capacity)
            plan.give(capacity - a, first, n)
            del left[a]
        elif a == b:
            n = left[a] // 2
            if n:
                first, _ = plan.new(n)
                plan.put(a, 2 * n, first, 2, capacity)
                plan.give(capacity - 2 * a, first, n)
            left[a] -= 2 * n
            if left[a] and at:  # one is left over and smaller ones remain
                b = sizes[at - 1]
                pair(plan, left, a, b, 1)
            elif left[a]:
                first, _ = plan.new(1)
                plan.put(a, 1, first, 1, capacity)
                plan.give(capacity - a, first, 1)
                left[a] = 0
        else:
            pair(plan, left, a, b, min(left[a], left[b]))
        for k in {a, b} & left.keys():
            if not left[k]:
                del left[k]
        sizes = [k for k in sizes if k in left]
    for length in sorted((k for k in counts if 3 * k <= capacity), reverse=True):
        plan.best_fit(length, counts[length])
    return plan


def pair(plan: Plan, left: dict[int, int], a: int, b: int, n: int) -> None:
    first, _ = plan.new(n)
    plan.put(a, n, first, 1, plan.capacity)
    plan.put(b, n, first, 1, plan.capacity - a)
    plan.give(plan.capacity - a - b, first, n)
    left[a] -= n
    left[b] -= n


# ---- places


def packed(pieces: DataFrame, capacity: int, planner=large_item_matching) -> tuple[DataFrame, int]:
    """pieces (as token_pieces has them, stored) with sequence_id and offset; how many sequences there are."""
    by_part = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).select(F.col("part").alias("_part"), F.col("length").alias("_length"), "first")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # a row for each length, no more than the capacity
    plan = planner(counts, capacity)
    rows = plan.array()
    names = pieces.columns

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(rows[:, 2].max()) + 1 if len(rows) else 1
        keys = rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(x)).to_numpy() for x in ("length", "rank"))
            row = rows[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(firsts, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).select(*names, (F.col("nth") + F.col("first")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint").drop("part", "nth"), plan.bins


#: Sequences of 2048 ids that a task of packed_matrix puts together.
TASK_SEQUENCES = 8_192


def packed_matrix(placed: DataFrame, sequences: int, capacity: int, narrow: str, pad_id: int = END_ID) -> DataFrame:
    """A row for each sequence: ids (capacity little-endian 32-bit integers, padded), cu_seqlens (where segments start, and the last ends), positions (which start anew in every segment, 32-bit), and each segment's doc_id and piece."""
    n = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sequences * capacity // (TASK_SEQUENCES * 2048)))
    ordered = placed.select("sequence_id", "offset", "doc_id", "piece", "length", "ids").repartition(n, "sequence_id").sortWithinPartitions("sequence_id", "offset")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and held[0]["sequence_id"] != r["sequence_id"]:
                    out.append(one(held))
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([one(held)], schema=SCHEMA)

    def one(segments: list[dict]) -> dict:
        n_tokens = sum(s["length"] for s in segments)
        positions = np.zeros(capacity, dtype="<u4")
        ends = np.cumsum([s["length"] for s in segments])
        for s, end in zip(segments, ends.tolist(), strict=True):
            positions[end - s["length"] : end] = np.arange(s["length"])
        pad = np.full(capacity - n_tokens, pad_id, dtype="<u4").tobytes()
        return {"sequence_id": segments[0]["sequence_id"], "n_tokens": n_tokens, "doc_ids": [s["doc_id"] for s in segments], "pieces": [s["piece"] for s in segments], "cu_seqlens": [0, *ends.tolist()], "ids": np.frombuffer(b"".join(s["ids"] for s in segments), dtype=narrow).astype("<u4").tobytes() + pad, "positions": positions.tobytes()}

    return ordered.mapInArrow(rows, "sequence_id bigint, n_tokens bigint, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary")


SCHEMA = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())])


def write_packed(matrix: DataFrame, path: str) -> None:
    """The sequences as Parquet, each id matrix row, segment table and position row in its own column."""
    matrix.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit_packing(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    pieces = stored(token_pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    return packed(pieces, capacity, large_item_matching)[0]


def token_output(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Best-fit-decreasing packing with the ids themselves: the rows of packed_matrix."""
    tokenizer = tokenizer or default_tokenizer()
    pieces = stored(token_pieces(docs, tokenizer, capacity, keep_ids=True), "pieces")
    return packed_matrix(*packed(pieces, capacity, best_fit_decreasing), capacity, id_type(tokenizer))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each packed sequence: its segments, and checksums of its id and position rows."""
    return token_output(table(spark, sf_dir, "documents")).select("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
