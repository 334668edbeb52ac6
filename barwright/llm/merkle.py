"""A Merkle manifest of a table: a leaf for each row, a tree of arity eight for each group, a tree over the groups' roots, and each row's proof.

Leaves are made next to the data by hash functions of Spark; from then on a row is its group, its id and its digests. Places in the order of a group come from ranges of all rows, so that a group of any size is many tasks. Runs of 8 ** depth leaves meet in one task each, which climbs to their node. Above that, nodes form a sparse forest: unresolved nodes keyed by group, level and run, where a run gives way to its parent as soon as it has all the nodes that the group's size says it has. Forests merge in any order to the same one (an associative, commutative operation with the empty forest as its identity), and treeReduce merges those of all partitions until one node a group is left. The driver gets the nodes at `depth` and above, which are UPPER for all rows together and one more for each group at most, however large the table (depth grows with it), and broadcasts them to the tasks that make the proofs.

A null in a column is part of the leaf. Rows of one group that repeat an id are ordered by their leaves; rows that repeat as a whole are leaves of their own, of equal digest. Null ids come first in a group, the null group first among groups; ids that are null are never tampered with in the query. Texts of any length are hashed where they are. An empty table gives no rows. Other columns take no part, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import give_back, stored, table

ARITY, BITS = 8, 3
#: Nodes at the depth where the forest begins, and the least and the most depth.
UPPER, LEAST_DEPTH, MOST_DEPTH = 1 << 17, 3, 7
#: Rows that an ordered range should have.
RANGE_ROWS = 1 << 20


def digest(*children: str) -> str:
    """H of digests as hexadecimal text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """sha256 of all columns: `-` for null, else the bytes' number, a colon and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


class Forest:
    """Unresolved nodes: digests by place in runs keyed by (group, level, run). sizes has each group's number of leaves.

    Adding a node that completes its run adds the run's parent instead. Complete runs stay in `complete`, where proofs look for them. No run is resolved at level `top`."""

    def __init__(self, sizes: dict[str, int], top: int | None = None) -> None:
        self.sizes, self.top = sizes, top
        self.open: dict[tuple[str, int, int], dict[int, str]] = {}
        self.complete: dict[tuple[str, int, int], tuple[str, ...]] = {}

    def width(self, group: str, level: int) -> int:
        """Nodes of a level."""
        return -(-self.sizes[group] // (1 << (BITS * level)))

    def add(self, group: str, level: int, index: int, node: str) -> None:
        while True:
            run, place = divmod(index, ARITY)
            width = self.width(group, level)
            here = self.open.setdefault((group, level, run), {})
            here[place] = node
            if level == self.top or width == 1 or len(here) < min(ARITY, width - ARITY * run):
                return
            del self.open[group, level, run]
            nodes = tuple(here[i] for i in range(len(here)))
            if self.top is None:
                self.complete[group, level, run] = nodes
            level, index, node = level + 1, run, digest(*nodes)

    def merge(self, other: Forest) -> Forest:
        self.complete.update(other.complete)
        for node in other.nodes():
            self.add(*node)
        return self

    def nodes(self) -> Iterator[tuple[str, int, int, str]]:
        for (group, level, run), here in self.open.items():
            for place, node in here.items():
                yield group, level, ARITY * run + place, node


def climbed(leaves: list[str], levels: int) -> list[list[str]]:
    """Nodes of each level from the leaves on, until one is left or so many levels are done."""
    out = [leaves]
    while len(out[-1]) > 1 and len(out) <= levels:
        below = out[-1]
        out.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def beside(nodes: tuple[str, ...] | list[str], place: int) -> tuple[str, str]:
    """What stands before a node in its run, and after it."""
    return "".join(nodes[:place]), "".join(nodes[place + 1 :])


def depth_for(sizes: Iterable[int]) -> int:
    sizes = list(sizes)
    for depth in range(LEAST_DEPTH, MOST_DEPTH):
        if sum(n >> (BITS * depth) for n in sizes) <= UPPER:
            return depth
    return MOST_DEPTH


def ordered_leaves(rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """rows (group, doc_id, leaf, seen) with idx, the place in the group's order, and each group's number of rows."""
    kept = stored(rows.withColumn("seq", F.monotonically_increasing_id()), "merkle-leaves")
    n = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // RANGE_ROWS))
    keys = ["group", "doc_id", "leaf", "seq"]  # seq parts rows that repeat as a whole
    ranged = stored(kept.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("seq"), "merkle-ordered")
    part = F.shiftright("at", 33).alias("part")
    runs = ranged.groupBy("group", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "merkle-runs")  # a row for each group and range
    sizes = {r["group"]: r["n"] for r in runs.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    placed = ranged.withColumn("part", part).join(runs, ["group", "part"]).withColumn("idx", F.col("base") + F.col("at") - F.col("first"))
    return placed.select("group", "doc_id", "leaf", "seen", "idx"), sizes


def in_blocks(placed: DataFrame, depth: int, sizes: dict[str, int]) -> DataFrame:
    """Each block of 8 ** depth leaves whole and in order in one task."""
    n = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // (4 << (BITS * MOST_DEPTH))))
    return placed.withColumn("block", F.shiftright("idx", BITS * depth)).repartition(n, "group", "block").sortWithinPartitions("group", "idx")


def fragments(sizes: dict[str, int], depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(sizes, top=depth)
        for batch in batches:
            for group, index, leaf in zip(batch.column("group").to_pylist(), batch.column("idx").to_pylist(), batch.column("leaf").to_pylist(), strict=True):
                forest.add(group, 0, index, leaf.hex())
        found = list(forest.nodes())
        if found:
            group, level, index, node = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.string()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(node, pa.string())], names=["group", "level", "idx", "node"])

    return run


PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
#: Rows that a task sends back at once.
ROWS = 8_192


class Upper:
    """What every proof needs of the tree above the blocks: complete runs of the forest, subroots and the runs above them."""

    def __init__(self, forest: Forest, depth: int) -> None:
        self.sizes, self.depth, self.complete = forest.sizes, depth, forest.complete
        self.subroots = {group: node for group, _, _, node in forest.nodes()}
        self.order = {group: i for i, group in enumerate(sorted(self.subroots, key=str.encode))}
        self.above = climbed([self.subroots[group] for group in self.order], 64)
        self.root = self.above[-1][0]

    def path(self, group: str, block: int) -> list[tuple[str, str]]:
        """What stands beside a block's node on its way to the subroot, and beside that on the way to the root."""
        out, level, index = [], self.depth, block
        while (run := self.complete.get((group, level, index // ARITY))) is not None:
            out.append(beside(run, index % ARITY))
            level, index = level + 1, index // ARITY
        index = self.order[group]
        for nodes in self.above[:-1]:
            start = index - index % ARITY
            out.append(beside(nodes[start : start + ARITY], index % ARITY))
            index //= ARITY
        return out

    def proofs(self, group: str, block: int, ids: list[int | None], leaves: list[str], seen: list[str]) -> Iterator[tuple]:
        whole = self.sizes[group]
        levels = 0  # of this tree that lie within blocks
        while levels < self.depth and -(-whole >> (BITS * levels)) > 1:
            levels += 1
        nodes = [leaves]
        for _ in range(levels):
            below = nodes[-1]
            nodes.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        above = self.path(group, block)
        for i, leaf in enumerate(leaves):
            way, index = [], i
            for level in range(levels):
                start = index - index % ARITY
                way.append(beside(nodes[level][start : start + ARITY], index % ARITY))
                index //= ARITY
            way += above
            folded = seen[i]
            for left, right in way:
                folded = digest(left, folded, right)
            yield ids[i], leaf, self.subroots[group], self.root, digest(*(x for both in way for x in both)), folded, folded == self.root


def proven(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper: Upper = shared.value
        at, held = None, ([], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if not held[0]:
                return
            rows = []
            for row in upper.proofs(*at, *held):
                rows.append(row)
                if len(rows) == ROWS:
                    yield sent(rows)
                    rows = []
            if rows:
                yield sent(rows)

        for batch in batches:
            names = ("group", "block", "doc_id", "leaf", "seen")
            for group, block, doc_id, leaf, seen in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if at != (group, block):
                    yield from flush()
                    at, held = (group, block), ([], [], [])
                held[0].append(doc_id)
                held[1].append(leaf.hex())
                held[2].append(held[1][-1] if seen is None else seen.hex())
        yield from flush()
        give_back()

    return run


def sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PROOF, strict=True)], schema=PROOF)


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", observed: dict[str, Column] | None = None, where_observed: Column | None = None) -> DataFrame:
    """Each row's leaf, its group's subroot, the root, its proof's digest, and whether the row as now observed, folded with its proof, leads to the root.

    observed: expressions for columns that may have changed since the manifest was made, for rows where where_observed holds; none: rows are as they were."""
    leaf = leaf_of(*(F.col(c) for c in columns))
    seen = F.lit(None).cast("binary")
    if observed:
        seen = F.unhex(leaf_of(*(observed.get(c, F.col(c)) for c in columns)))
        if where_observed is not None:
            seen = F.when(where_observed, seen)
    # the null group is the empty string, so that it comes first; others have a sign before them
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    placed, sizes = ordered_leaves(docs.select(group.alias("group"), F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(leaf).alias("leaf"), seen.alias("seen")))
    spark = docs.sparkSession
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not sizes:
        return spark.createDataFrame([], schema)
    depth = depth_for(sizes.values())
    blocks = in_blocks(placed, depth, sizes)
    parts = stored(blocks.select("group", "idx", "leaf").mapInArrow(fragments(sizes, depth), "`group` string, level int, idx bigint, node string"), "merkle-fragments")

    def forest(rows: Iterable) -> list[Forest]:
        out = Forest(sizes)
        for r in rows:
            out.add(r["group"], r["level"], r["idx"], r["node"])
        return [out]

    upper = Upper(parts.rdd.mapPartitions(forest).treeReduce(Forest.merge), depth)
    return blocks.mapInArrow(proven(spark.sparkContext.broadcast(upper)), schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, of which those whose id's crc32 is divisible by three are observed with lower-case letters."""
    capitals = "".join(map(chr, range(65, 91)))
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], observed={"text": F.translate("text", capitals, capitals.lower())}, where_observed=hit)
