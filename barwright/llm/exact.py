"""Exact deduplication by Grace hashing.

Map tasks put their own records through an open-addressing table that compares whole contents, so that of equal texts in one task only one moves, with the least id and how many there are. What moves is partitioned by hash: into shuffle partitions first, then within each, where it needs more, into sub-buckets by Spark's external sort. A bucket goes through a table of bounded size. What a full table has no room for is written to the shared folder and partitioned again by other bits, until everything has found its equals. Every round places at least one content a bucket, so the rounds end.

A group of copies, however large, takes one entry of a table, and one record for each map task (or filling of its table) moves. No text passes through the driver; it sees the number of bytes of each round.

Texts are equal if they are after each run of [\\x20\\x09-\\x0D] has become one space. A null text is an empty one; empty texts are equal to each other. Null ids come after all others, so that such a row stays only if its group has no other id. Rows that repeat an id and a text count each, and one of them stays. A text of any length is one record. An empty table gives no rows. Columns other than the id and the text take no part, whatever their names."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import by_chars, give_back, stored, table

#: Bytes of content that a table holds; one content of any length fits into an empty one.
ROOM = 48 << 20
#: Bytes of content that a bucket should have.
BUCKET = 16 << 20
#: What an entry takes besides its content.
ENTRY = 128
#: A shuffle has no more partitions than this; more buckets are made within them.
MOST_PARTITIONS = 20_000
#: Bytes of content in a batch that goes back to Spark.
SENT = 2 << 20
#: Runs of white space that are not one space already.
UNEVEN = re.compile(rb"[\x09-\x0d][\x20\x09-\x0d]*|\x20[\x20\x09-\x0d]+")


class ContentTable:
    """Open addressing with linear probing. Entries are told apart by their whole contents; hashes only lead to them."""

    def __init__(self, room: int = ROOM) -> None:
        self.room, self.used, self.contents, self.hashes, self.slots = room, 0, [], array("q"), array("q", [-1]) * 1024

    def place(self, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and whether it is new; -1 if it has none and there is no room for one."""
        h = hash(content)
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        if self.contents and self.used + len(content) + ENTRY > self.room:
            return -1, False
        self.slots[at] = entry = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        self.used += len(content) + ENTRY
        if 2 * len(self.contents) > len(self.slots):
            self.grow()
        return entry, True

    def grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = array("q", [-1]) * (mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


# ---- in map tasks

#: A row of a document has part, rep, nth and doc_id; a row of a representative also has what comes after them, of all rows that it stands for.
LOCAL = pa.schema([("part", pa.int32()), ("rep", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("content", pa.binary())])


def after(a: int | None, b: int | None) -> bool:
    """Whether id a comes after b; nulls last."""
    return b is not None and (a is None or a > b)


def local_groups(room: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, seen = TaskContext.get().partitionId(), 0, 0
        found = ContentTable(room)
        least: list[tuple[int | None, int]] = []  # of each entry, the least id and its row
        count = array("q")

        def flush() -> Iterator[pa.RecordBatch]:
            for a, b in cuts(found.contents):
                some = found.contents[a:b]
                shas = [hashlib.sha256(x).digest() for x in some]
                yield pa.RecordBatch.from_arrays([pa.array([part] * (b - a), pa.int32()), pa.array(range(base + a, base + b), pa.int64()), pa.array([x[1] for x in least[a:b]], pa.int64()), pa.array([x[0] for x in least[a:b]], pa.int64()), pa.array([int.from_bytes(x[:8], "big", signed=True) for x in shas], pa.int64()), pa.array(count[a:b], pa.int64()), pa.array([len(x) for x in some], pa.int64()), pa.array(shas, pa.binary()), pa.array(some, pa.binary())], schema=LOCAL)

        for whole in batches:
            for batch in by_chars(whole):
                ids = batch.column("doc_id").to_pylist()
                reps = array("q")
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                first = seen
                for doc_id, text in zip(ids, texts, strict=True):
                    content = UNEVEN.sub(b" ", text) if text else b""
                    entry, new = found.place(content)
                    if entry < 0:
                        yield from flush()
                        base += len(found.contents)
                        found, least, count = ContentTable(room), [], array("q")
                        entry, new = found.place(content)
                    if new:
                        least.append((doc_id, seen))
                        count.append(1)
                    else:
                        count[entry] += 1
                        if after(least[entry][0], doc_id):
                            least[entry] = (doc_id, seen)
                    reps.append(base + entry)
                    seen += 1
                n, none = len(ids), pa.nulls
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(reps, pa.int64()), pa.array(range(first, seen), pa.int64()), pa.array(ids, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary())], schema=LOCAL)
        yield from flush()
        give_back()

    return run


def cuts(contents: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of about SENT bytes."""
    a = held = 0
    for i, x in enumerate(contents):
        held += len(x) + ENTRY
        if held > SENT:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(contents):
        yield a, len(contents)


# ---- in buckets

PLACED = pa.schema([*LOCAL, ("keep_id", pa.int64()), ("keep_part", pa.int32()), ("keep_nth", pa.int64()), ("group_size", pa.int64())])
#: Rows that a task sends back at once.
ROWS = 16_384


def bucket_groups(room: int):
    """Of records that come bucket by bucket: each one's group (group_size is null for what had no room, which has its content still)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, members, best, found, size = None, [], [], ContentTable(room), array("q")

        def flush() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(members), ROWS):
                some = members[a : a + ROWS]
                kept = [best[e] for e, *_ in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in some], pa.int32()), pa.array([x[2] for x in some], pa.int64()), *(pa.nulls(n, LOCAL.field(i).type) for i in range(2, 7)), pa.array([x[3] for x in some], pa.binary()), pa.nulls(n, pa.binary()), pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int32()), pa.array([x[2] for x in kept], pa.int64()), pa.array([size[e] for e, *_ in some], pa.int64())], schema=PLACED)

        for batch in batches:
            names = [f.name for f in LOCAL]
            left = []
            columns = [batch.column(x).to_pylist() for x in ("bucket", *names)]
            for i, (b, part, rep, nth, doc_id, _, n, _, sha, content) in enumerate(zip(*columns, strict=True)):
                if b != bucket:
                    yield from flush()
                    bucket, members, best, found, size = b, [], [], ContentTable(room), array("q")
                entry, new = found.place(content)
                if entry < 0:
                    left.append(i)
                    continue
                if new:
                    best.append((doc_id, part, nth))
                    size.append(0)
                elif after(best[entry][0], doc_id) or (best[entry][0] == doc_id and best[entry][1:] > (part, nth)):
                    best[entry] = (doc_id, part, nth)
                size[entry] += n
                members.append((entry, part, rep, sha))
            if left:
                some = batch.select(names).take(pa.array(left))
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.nulls(len(left), PLACED.field(i).type) for i in range(len(names), len(PLACED)))], schema=PLACED)
        yield from flush()
        give_back()

    return run


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def grace_groups(records: DataFrame, room: int = ROOM, bucket: int = BUCKET, most_partitions: int = MOST_PARTITIONS) -> list[DataFrame]:
    """part, rep, sha, keep_id, keep_part, keep_nth and group_size of every record, as a list of stored tables: one a round."""
    least = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, level = [], 0
    while True:
        total = records.agg(F.sum(F.col("n_bytes") + ENTRY)).first()[0]  # one number
        if not total:
            return placed
        wanted = max(least, -(-total // bucket))
        n = min(wanted, max(least, most_partitions))
        within = -(-wanted // n)
        by = lambda i, level=level: F.xxhash64("hash", F.lit(2 * level + i))
        dealt = records.withColumn("bucket", F.pmod(by(1), F.lit(within)).cast("int")).repartition(n, by(0))
        if within > 1:
            dealt = dealt.sortWithinPartitions("bucket")
        out = stored(dealt.mapInArrow(bucket_groups(room), ddl(PLACED)), f"exact-{level}")
        placed.append(out.where(F.col("group_size").isNotNull()).select("part", "rep", "sha", "keep_id", "keep_part", "keep_nth", "group_size"))
        records = out.where(F.col("group_size").isNull()).select(*LOCAL.names)
        level += 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, bucket: int = BUCKET, most_partitions: int = MOST_PARTITIONS) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    local = stored(texts.mapInArrow(local_groups(room), ddl(LOCAL)), "exact-local")
    rows = local.where(F.col("hash").isNull()).select("part", "rep", "nth", "doc_id")
    placed = grace_groups(local.where(F.col("hash").isNotNull()), room, bucket, most_partitions)
    if not placed:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string")
    groups = placed[0]
    for more in placed[1:]:
        groups = groups.union(more)
    stays = (F.col("part") == F.col("keep_part")) & (F.col("nth") == F.col("keep_nth"))
    return rows.join(groups, ["part", "rep"]).select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
