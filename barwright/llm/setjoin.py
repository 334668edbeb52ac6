"""N-gram Jaccard join by chosen paths (Christiani, Pagh and Sivertsen: Scalable and robust set similarity join, 2018).

Texts are sets of word shingles (five words, lower case). In each run a set follows the shared random choice of about 1 / threshold of its shingles into buckets; buckets above a limit are split again by further shingles, so that only sets with all of a path's shingles meet. Small buckets are compared exactly. `runs` independent runs bring the expected recall at the threshold itself above 0.99, more above it; for two sets that share only buckets which are split twice it is 0.976 at the threshold and above 0.99 from a similarity of about 0.9.

Equal sets are one class with a size, so copies are never compared with each other. Sets whose buckets have the same least set are compared as one group, so that a set moves once however many buckets it is in; buckets that are not within a group are compared one by one. A pair that meets in several places is counted in the one with the least key that both are in. Pairs are counted inside the task that compares them, and only sums and a spanning forest of the links leave it. What is too large for one task is compared in blocks.

Texts of fewer than five words are one shingle of all their words; null and empty texts and rows without an id have no links and are their own class. Rows that repeat an id share the classes of its texts. Of a class the least id stands for it. Texts of any length are handled whole; the blocks that they are compared in have a bound by shingles. An empty table gives no rows; extra columns take no part."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm import textcodes
from barwright.llm.common import fresh, give_back, per_batch, sifted, stored, stored_by, table, texts_of

SHINGLE = 5
THRESHOLD = 0.8
RUNS = 8
#: Sets in a bucket above which it is split by one more shingle, at most DEPTH of them.
LIMIT = 4_096
DEPTH = 3
#: How many times more shingles than in a first choice are chosen where a bucket is split, as its sets have fewer chances left.
DEEPER = 1.5
#: Sets, and shingles of them, on one side of a comparison.
BLOCK = 2_048
BLOCK_SHINGLES = 2_000_000
#: How many times LIMIT sets, and BLOCK_SHINGLES shingles, a group of buckets may have that is compared as a whole.
GROUP = 4
#: Sets, counted as often as they are in a bucket, that a task compares.
TASK_SETS = 5_000
_COLUMNS = 4_096


def sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and where each text's start, and one more."""
    word, which, _, _ = textcodes.words(texts)
    hashes, at, _ = textcodes.shingles(word, which, len(texts), size)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def chosen(tokens: np.ndarray, n: np.ndarray, path: np.uint64 | np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are chosen on a path, about 1 / threshold of a set of n, and the paths that go on through them."""
    draw = textcodes.mixed(tokens ^ path)
    taken = draw.astype(np.float64) < 2.0**64 / (threshold * n)
    return taken, textcodes.mixed(draw[taken] + (path[taken] if isinstance(path, np.ndarray) else path))


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def signed(docs: DataFrame, threshold: float, runs: int, size: int) -> DataFrame:
    """doc_id, a key of 128 bits of the set, its size n, and its first paths."""
    seeds = textcodes.mixed(np.arange(1, runs + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, at = sets(texts_of(batch), size)
            n = np.diff(at)
            many = np.repeat(n, n)
            doc = np.repeat(np.arange(len(n)), n)
            where, paths = [], []
            for seed in seeds[2:]:
                taken, path = chosen(tokens, many, seed, threshold)
                where.append(doc[taken])
                paths.append(path)
            where, paths = np.concatenate(where), np.concatenate(paths)
            order = np.argsort(where, kind="stable")
            offsets = np.searchsorted(where[order], np.arange(len(n) + 1)).astype(np.int32)
            keys = [_sum(textcodes.mixed(tokens ^ s), at).view(np.int64) for s in seeds[:2]]
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, keys), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths[order].view(np.int64)))], names=["doc_id", "hi", "lo", "n", "paths"])

        return work

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(per_batch(make), "doc_id bigint, hi bigint, lo bigint, n bigint, paths array<bigint>")


def with_sets(members: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """rep and tokens: the set of the rep's text, what moves of the hash of each shingle. Of several texts under one id the one with the member's key counts."""
    texts, _ = sifted(docs.selectExpr("cast(doc_id AS bigint) AS _id", "text"), "_id", members.select(F.col("rep").alias("id")))
    joined = members.join(texts, F.col("rep") == F.col("_id")).select("rep", "hi", "lo", "text")
    seeds = textcodes.mixed(np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def make():
        def work(batch: pa.RecordBatch) -> pa.Table:
            tokens, at = sets(texts_of(batch), size)
            right = np.ones(batch.num_rows, dtype=bool)
            for i, s in ((1, seeds[0]), (2, seeds[1])):
                right &= _sum(textcodes.mixed(tokens ^ s), at).view(np.int64) == batch.column(i).to_numpy()
            rows = textcodes.to_move(tokens)
            raw = [rows[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            return pa.table({"rep": batch.column(0), "tokens": pa.array(raw, pa.binary())}).filter(pa.array(right))

        return work

    return joined.mapInArrow(per_batch(make), "rep bigint, tokens binary")


def grouped(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """rows (rep, path) of buckets with two sets or more, and their number; of buckets with the same sets only one stays. Buckets above `limit`, which are split and not compared, all stay: each one is an independent chance for its sets to stay together."""
    buckets = rows.groupBy("path").agg(F.count("*").alias("count"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")).where(F.col("count") > 1)
    split = F.when(F.col("count") > limit, F.col("path")) if limit is not None else F.lit(None).cast("bigint")
    kept = buckets.groupBy("count", "who", split.alias("split")).agg(F.min("path").alias("path")).select("path", "count")
    return rows.join(kept, "path").select("rep", "path", "count")


def deeper(big: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """rep, path one shingle further, of the buckets that are too large. Sets that are in none of these stay where they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, paths = [], []
            for rep, tokens, on in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = textcodes.moved(tokens)
                for p in on:
                    _, path = chosen(t, np.array(len(t)), np.uint64(p % (1 << 64)), threshold / DEEPER)
                    paths.append(path.view(np.int64))
                    reps.append(np.full(len(path), rep, dtype=np.int64))
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(paths))], names=["rep", "path"])

    on = big.groupBy("rep").agg(F.collect_list("path").alias("on"))
    some, _ = sifted(members, "rep", big.select(F.col("rep").alias("id")))
    return some.join(on, "rep").select("rep", "tokens", "on").mapInArrow(run, "rep bigint, path bigint")


# ---- comparison inside a bucket


def overlaps(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `left` with the sets `right`."""
    lengths = [len(t) for t in tokens]
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), lengths)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner = owner[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    if not len(owner):
        return out
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, int(column[-1]) + 1, _COLUMNS):
        a, b = np.searchsorted(column, (first, first + _COLUMNS))
        part = np.zeros((len(tokens), min(_COLUMNS, int(column[-1]) + 1 - first)), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part[left] @ part[right].T
    return out


def met_before(keys: list[np.ndarray], key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets of left and right share a bucket with a lesser key."""
    flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    less = flat < key
    flat, owner = flat[less], owner[less]
    if not len(flat):
        return np.zeros((len(left), len(right)), dtype=bool)
    _, column = np.unique(flat, return_inverse=True)
    part = np.zeros((len(keys), int(column.max()) + 1), dtype=np.float32)
    part[owner, column] = 1
    return part[left] @ part[right].T > 0


def compared(rep: np.ndarray, size: np.ndarray, key: int, blocks: np.ndarray, keys: list[np.ndarray], tokens: list[np.ndarray], threshold: float, within: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: each set's links (weighted by the other's class size) and a forest of the links, as arrays rep, other, links; other is -1 or a set that rep is linked with through others."""
    n = np.array([len(t) for t in tokens], dtype=np.float64)
    sides = np.unique(blocks)
    if len(sides) == 1 and not within:
        return (np.zeros(0, dtype=np.int64),) * 3
    left = np.flatnonzero(blocks == sides[0])
    right = np.flatnonzero(blocks == sides[-1])
    fresh = ~met_before(keys, key, left, right)
    if len(sides) == 1:
        np.fill_diagonal(fresh, False)
    rows, columns = fresh.any(axis=1), fresh.any(axis=0)
    if not rows.any():
        return (np.zeros(0, dtype=np.int64),) * 3
    left, right, fresh = left[rows], right[columns], fresh[np.ix_(rows, columns)]
    both = overlaps(tokens, left, right)
    linked = fresh & (both >= threshold * (n[left][:, None] + n[right][None, :] - both) - 1e-9)
    links = np.zeros(len(rep), dtype=np.int64)
    links[left] += linked @ size[right]
    if len(sides) > 1:
        links[right] += linked.T @ size[left]
    a, b = np.nonzero(linked)
    root = np.arange(len(rep))
    a, b = left[a], right[b]
    while True:  # each set takes the least root among those it is linked with
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    some = np.flatnonzero(links > 0)
    return rep[some], np.where(root[some] == some, -1, rep[root[some]]), links[some]


def compare_buckets(buckets: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """rep, other, links over all groups; buckets: g, block, within (both sides are one block), path, rep, size, keys, tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            if held is not None:
                whole = pa.concat_tables([held, whole])
            g = whole.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from groups(whole.slice(0, cut))
            held = whole.slice(cut)
        if held is not None and held.num_rows:
            yield from groups(held)
        give_back()

    def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        g, block, path, rep, size = (rows.column(x).to_numpy() for x in ("g", "block", "path", "rep", "size"))
        within = rows.column("within").to_numpy()
        keys, tokens = (rows.column(x).chunk(0) for x in ("keys", "tokens"))
        key_at, key_of = keys.offsets.to_numpy(), keys.values.to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]]).tolist()
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            out.append(compared(rep[a:b], size[a:b], path[a], block[a:b], [key_of[key_at[i] : key_at[i + 1]] for i in range(a, b)], [textcodes.moved(tokens[i].as_buffer()) for i in range(a, b)], threshold, bool(within[a])))
        if out:
            rep, other, links = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(rep):
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(other, mask=other < 0), pa.array(links)], names=["rep", "other", "links"])

    return buckets.repartition(partitions, "g").sortWithinPartitions("g", "rep").mapInArrow(run, "rep bigint, other bigint, links bigint")


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it is connected with) of undirected edges (a, b), by alternating large and small stars (Kiveris and others, 2014). Roots themselves are left out."""
    at = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = at.select("u", "v").union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        at = stored(small.where(F.col("u") != F.col("v")).distinct(), "stars")
        state = at.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if state == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


# ---- the join


def gathered(buckets: DataFrame, lengths: DataFrame, limit: int, block: int) -> DataFrame:
    """rep, path, blocks: the groups to be compared, of buckets (rep, path). A set's home is the least set of all that it shares a bucket with; sets with one home, GROUP * `limit` of them at most, are a group, and buckets of which all sets are in one such group are not compared again. blocks: how many parts a group is compared in."""
    heads = buckets.groupBy("path").agg(F.min("rep").alias("head"))
    homes = buckets.join(heads, "path").groupBy("rep").agg(F.min("head").alias("home"))
    homes = stored(lengths.join(homes, "rep"), "homes")
    small = homes.groupBy("home").agg(F.count("*").alias("count"), F.sum("n").alias("sum")).where(F.col("count").between(2, GROUP * limit) & (F.col("sum") <= GROUP * BLOCK_SHINGLES)).select(F.col("home").alias("small"))
    placed = homes.join(small, F.col("home") == F.col("small"), "left").select("rep", "n", "small")
    at = buckets.join(placed, "rep")
    covered = at.groupBy("path").agg((F.min("small").eqNullSafe(F.max("small")) & (F.count("small") == F.count("*"))).alias("covered"))
    own = at.join(covered, "path").where(~F.col("covered")).select("rep", "n", "path")
    groups = placed.where(F.col("small").isNotNull()).select("rep", "n", F.xxhash64(F.lit("group"), "small").alias("path")).union(own)
    sizes = groups.groupBy("path").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return groups.join(sizes, "path").select("rep", "path", "blocks")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, size: int = SHINGLE, limit: int = LIMIT, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (least id of those it is linked with, directly or through others), copy_id (least id with the same set), n_links (rows whose similarity with it is the threshold or more)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets_of = stored(signed(docs, threshold, runs, size), "signed")
    full = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = stored(sets_of.where(full).groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("paths").alias("paths")), "classes")
    by_rep = classes.groupBy("rep").agg(F.sum("size").alias("size"), F.max("n").alias("n"))
    level = stored(grouped(classes.select("rep", F.explode("paths").alias("path")), limit), "buckets-1")
    reps = level.select("rep").distinct()
    members, name = stored_by(with_sets(classes.select("rep", "hi", "lo").join(reps, "rep", "left_semi"), docs, size), "sets", "rep")
    final = level.where(F.col("count") <= limit)
    for d in range(2, depth + 1):
        big = level.where(F.col("count") > limit)
        if big.isEmpty():
            break
        level = stored(grouped(deeper(big, members, threshold), None if d == depth else limit), f"buckets-{d}")
        final = final.union(level if d == depth else level.where(F.col("count") <= limit))
    groups = stored(gathered(final.select("rep", "path"), by_rep.select("rep", "n").join(final.select("rep").distinct(), "rep", "left_semi"), limit, block), "groups")
    keys = groups.groupBy("rep").agg(F.sort_array(F.collect_set("path")).alias("keys"), F.collect_set(F.struct("path", "blocks")).alias("on"))
    rows = keys.join(by_rep.select("rep", "size"), "rep").join(members, "rep").select("rep", "size", "keys", "tokens", F.explode("on").alias("on"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("bigint"))
    rows = rows.select("rep", "size", "keys", "tokens", "on.path", "on.blocks").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    rows = rows.withColumn("g", F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))).withColumn("within", F.col("block") == F.col("other")).select("g", "block", "within", "path", "rep", "size", "keys", "tokens")
    compared_sets = groups.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    found = stored(compare_buckets(rows, threshold, max(parts, -(-compared_sets // TASK_SETS))), "links")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.select("hi", "lo", "rep", "size").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "rep", "size", "links", "root")
    linked = sets_of.where(full).select("doc_id", "hi", "lo").join(known, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")))
    alone = sets_of.where(~F.coalesce(full, F.lit(False))).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).union(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the near duplicates: of each class the row with the least id stays, the first by its text if that id repeats. Rows without an id stay."""
    other, gone, nth = (fresh(docs, x) for x in ("_same", "_gone", "_nth"))
    by_id = near_duplicates(docs, **options).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("c"))
    found = stored(by_id.where((F.col("doc_id") != F.col("c")) | (F.col("n") > 1)).select(F.col("doc_id").alias(other), (F.col("doc_id") != F.col("c")).alias(gone)), "gone")
    some, rest = sifted(docs, "doc_id", found.select(F.col(other).alias("id")))
    marked = some.join(found, F.col("doc_id").cast("bigint") == F.col(other), "left")
    marked = marked.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", other).orderBy("text")))
    return marked.where(F.col(other).isNull() | (~F.col(gone) & (F.col(nth) == 1))).select(*docs.columns).union(rest)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
