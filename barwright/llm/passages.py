"""Substring dedup by compact windows (after Wang, Zuo and Deng: near-duplicate text alignment with min-hash and compact windows).

A text's tokens are its word shingles (five words, lower case), each with a few independent hashes. For one hash, all subsequences with the same least token form a rectangle (l, c, r): they start in l..c and end in c..r, and (l, r) is the span of c's subtree in the Cartesian tree over the hashes. Windows of `min_words` words or more are keyed by their least hash, so two texts that share a passage share keys. Windows of a key are sorted over range partitions, which cut a key of any size.

Within a key, windows with the same shingles all around are one class: each is linked with the first of its class, and the firsts with each other. Where a key has many classes (a line that many texts share), each class is linked with the key's first and the one before it, and wherever the min-hashes of the shingles on its left or right differ from those of the first, it goes on into a narrower key of the old one and that min-hash, where it meets the classes with its own surroundings; narrower keys are treated alike, until all four min-hashes are used. Links of two texts are joined where their intervals overlap; those on which enough hashes agree are verified on the tokens themselves: the longest stretches with a Jaccard similarity of 0.8 or more.

Texts of fewer words than `min_words`, empty and null ones, and rows without an id hold no passages. Texts of any length are handled whole; of equal hashes the first in a text is a tree's root, and of equal windows the one with the least id is a class's first. Repeats within a text don't count, and rows that share an id count as one text. An empty table gives no rows; extra columns take no part."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm import textcodes
from barwright.llm.common import by_bytes, expand, fresh, give_back, per_batch, sifted, stored, table, texts_of

SHINGLE = 5
MIN_WORDS = 50
THRESHOLD = 0.8
HASHES = 5
#: Hashes that must agree on overlapping intervals.
AGREE = 2
#: Links of two texts whose places differ by less than this are taken together.
SHIFT = 32
#: Classes of a key that are each linked with all before them; a key with more is split.
FEW = 6
#: Shingles left and right of c whose min-hashes split a key: of a passage of 50 words around c, one side has as many.
BESIDE = 23
#: Min-hashes that split: two functions on either side.
SIDES = 4
#: Bytes of tokens, on one side, of the pairs that are verified at once.
PAIR_BYTES = 2 << 20
#: Documents, at least four a partition, that ranges are chosen by.
SAMPLED_DOCS = 5_000


def tree_windows(v: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the Cartesian trees' nodes over v (texts from at[i] to at[i + 1]) that span `least` tokens or more; of equal values the first is the root. A node next to an equal one on its left is left out."""
    n = len(v)
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    if n < least:
        return (np.zeros(0, dtype=np.int64),) * 3
    # place of the first least value in [i, i + span)
    place, span = np.arange(n), 1
    while span < least:
        step = min(span, least - span)
        a, b = place[: n - step], place[step:]
        place = np.concatenate([np.where(v[a] <= v[b], a, b), place[n - step :]])
        span += step
    whole = np.arange(n) + least <= at[1:][text]
    c = np.unique(place[whole])
    c = c[(c == 0) | (v[c] != v[c - 1]) | (text[c] != text[c - 1])]
    longest = int(size.max())
    levels = [v]
    while 1 << len(levels) <= longest:
        x, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.concatenate([np.minimum(x[: n - step], x[step:]), x[n - step :]]))
    first, last = at[:-1][text[c]], at[1:][text[c]]
    l, r = c.copy(), c + 1
    for j in range(len(levels) - 1, -1, -1):
        step = 1 << j
        can = l - step >= first
        can[can] = levels[j][l[can] - step] > v[c[can]]
        l[can] -= step
        can = r + step <= last
        can[can] = levels[j][r[can]] >= v[c[can]]
        r[can] += step
    return l, c, r - 1


def shingle_lists(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    word, which, _, _ = textcodes.words(texts)
    hashes, at, _ = textcodes.shingles(word, which, len(texts), size)
    return hashes, at


def run_minima(v: np.ndarray, size: int) -> np.ndarray:
    """The least of v[i : i + size], for i up to len(v) - size."""
    out, span = v, 1
    while span < size:
        step = min(span, size - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


class Ranges:
    """Which partition windows go to: between which of some windows, in order, they are. Only keys that are cut compare more than the key."""

    def __init__(self, cuts: pa.Table) -> None:
        order = np.lexsort([cuts.column(n).to_numpy() for n in ("d", "around", "key")])
        self.key, self.around, self.d = (cuts.column(n).to_numpy()[order] for n in ("key", "around", "d"))

    def __call__(self, key: np.ndarray, around: np.ndarray, d: np.ndarray) -> np.ndarray:
        out, upto = (np.searchsorted(self.key, key, side) for side in ("left", "right"))
        for k in np.unique(key[upto > out]).tolist():
            some = np.flatnonzero(key == k)
            for i in range(int(out[some[0]]), int(upto[some[0]])):
                out[some] += (self.around[i] < around[some]) | ((self.around[i] == around[some]) & (self.d[i] <= d[some]))
        return out.astype(np.int32)


def ranges(docs: DataFrame, min_words: int, hashes: int, size: int, partitions: int) -> Ranges:
    """Bounds of `partitions` ranges, from the windows of a sample of documents. They decide where windows are sorted and nothing else."""
    share = min(1.0, max(SAMPLED_DOCS, 4 * partitions) / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sampled = windows(some, min_words, hashes, size).where(F.pmod(F.xxhash64("key", "around", "d", "c"), F.lit(4)) == 0).select("key", "around", "d").toArrow()  # some hundred rows a partition
    order = np.lexsort([sampled.column(n).to_numpy() for n in ("d", "around", "key")])
    return Ranges(sampled.take(pa.array(order[np.arange(1, partitions) * len(order) // partitions] if len(order) else order)))


def windows(docs: DataFrame, min_words: int, hashes: int, size: int, ranges: Ranges | None = None) -> DataFrame:
    """key (its low three bits are the hash's number, the next three 0), d (id), c, l, r (shingle numbers), near (16 bits of each min-hash beside c, 0 where the text ends before) and around (a hash of all shingles at most `min_words` from c); with ranges also part, the one that a window is in."""
    least = min_words - size + 1
    seeds = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(hashes + SIDES // 2)]

    def make():
        def work(batch: pa.RecordBatch) -> pa.Table:
            tokens, at = shingle_lists(texts_of(batch), size)
            ids = batch.column(0).to_numpy()
            if len(tokens) < least:
                return None
            minima = [run_minima(textcodes.mixed(tokens + s), BESIDE) for s in seeds[hashes:]]
            out = []
            for k in range(hashes):
                v = textcodes.mixed(tokens + seeds[k])
                l, c, r = tree_windows(v, at, least)
                text = np.searchsorted(at, c, side="right") - 1
                base, end = at[text], at[text + 1]
                near = np.zeros(len(c), dtype=np.uint64)
                for i in range(SIDES):
                    p = c - BESIDE if i % 2 == 0 else c + 1
                    inside = (p >= base) & (p + BESIDE <= end)
                    near[inside] |= (textcodes.mixed(minima[i // 2][p[inside]]) >> np.uint64(48) | np.uint64(1)) << np.uint64(16 * i)
                around = textcodes.span_hash(tokens, np.maximum(c - min_words, base), np.minimum(c + min_words + 1, end))
                key = v[c] & np.uint64(2**64 - 64) | np.uint64(k)
                out.append(pa.table({"key": key.view(np.int64), "d": ids[text], "c": (c - base).astype(np.int32), "l": (l - base).astype(np.int32), "r": (r - base).astype(np.int32), "near": near.view(np.int64), "around": around.view(np.int64)}))
            rows = pa.concat_tables(out)
            return rows if ranges is None else rows.append_column("part", pa.array(ranges(*(rows.column(n).to_numpy() for n in ("key", "around", "d")))))

        return work

    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return some.mapInArrow(per_batch(make), "key bigint, d bigint, c int, l int, r int, near bigint, around bigint" + ", part int" * (ranges is not None))


LINK = "key bigint, xd bigint, xc int, xl int, xr int, yd bigint, yc int, yl int, yr int, near bigint, around bigint, todo int"


def linked(found: DataFrame) -> DataFrame:
    """found: windows in ranges by key, around and d, one a partition. Links of windows x and y with one key, x of the text with the larger id.

    Windows of a class (the same around) are linked with its first; the first FEW + 1 classes of a key with each other, later ones with the first and the one before. Where a partition cuts a key, its part's first window comes with no y, to be linked with the key's other parts. Classes that go on into narrower keys come with no y and with near, around and todo: a bit for each min-hash to split by."""
    names = ["d", "c", "l", "r"]

    def links(t: pa.Table, a: np.ndarray, b: np.ndarray | None, todo: np.ndarray | None = None) -> pa.RecordBatch:
        x = t.take(pa.array(a))
        y = t.take(pa.array(b)) if b is not None else None
        columns = [x.column("key").combine_chunks(), *(x.column(n).combine_chunks() for n in names)]
        columns += [y.column(n).combine_chunks() if y is not None else pa.nulls(len(a), t.schema.field(n).type) for n in names]
        columns += [x.column(n).combine_chunks() if todo is not None else pa.nulls(len(a), pa.int64()) for n in ("near", "around")]
        columns += [pa.array(todo, pa.int32()) if todo is not None else pa.nulls(len(a), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["key", *("x" + n for n in names), *("y" + n for n in names), "near", "around", "todo"])

    def split(t: pa.Table, x: np.ndarray, first: np.ndarray, whole: bool) -> pa.RecordBatch | None:
        """Classes x by those min-hashes, after the ones used, that differ from the first's; with whole, by all that there are."""
        key, near = (t.column(n).to_numpy() for n in ("key", "near"))
        todo = np.zeros(len(x), dtype=np.int32)
        for i in range(SIDES):
            own = near[x] >> (16 * i) & 0xFFFF
            goes = (own != 0) & ((key[x] >> 3 & 7) <= i)
            if not whole:
                goes &= own != (near[first] >> (16 * i) & 0xFFFF)
            todo |= goes.astype(np.int32) << i
        some = todo > 0
        return links(t, x[some], None, todo[some]) if some.any() else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # first windows of the classes of the key that goes on: all, or the first and last of more than FEW + 1
        n_held = 0  # how many classes held stands for
        cut = True  # whether its key is the partition's first
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            before = held.num_rows if held is not None else 0
            t = (new if held is None else pa.concat_tables([held, new])).combine_chunks()
            if held is None:
                yield links(t, np.array([0]), None)
                got = split(t, np.array([0]), np.array([0]), True)
                if got is not None:
                    yield got
            key, d, around = (t.column(n).to_numpy() for n in ("key", "d", "around"))
            start = np.ones(len(key), dtype=bool)
            start[1:] = key[1:] != key[:-1]
            opens = start.copy()
            opens[1:] |= around[1:] != around[:-1]
            at = np.arange(len(key))
            member = np.flatnonzero(~opens)
            pairs = [(member, np.maximum.accumulate(np.where(opens, at, 0))[member])]
            rep = np.flatnonzero(opens)
            which = np.cumsum(start[rep]) - 1  # key number of each class
            head = np.flatnonzero(start[rep])
            nth = np.arange(len(rep)) - head[which]
            many = n_held > FEW + 1
            if before and many:
                nth[(which == 0) & (nth > 0)] += n_held - before
            size = np.maximum.reduceat(nth, head)[which] + 1
            first = rep[head[which]]
            fresh_rep = rep >= before
            for lag in range(1, FEW + 1):
                y = np.flatnonzero(fresh_rep & (nth <= FEW) & (nth >= lag))
                pairs.append((rep[y], rep[y - lag]))
            late = np.flatnonzero(fresh_rep & (nth > FEW))
            pairs.append((rep[late], first[late]))
            pairs.append((rep[late], rep[late - 1]))
            a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
            other = d[a] != d[b]
            a, b = a[other], b[other]
            if len(a):
                yield links(t, np.where(d[a] > d[b], a, b), np.where(d[a] > d[b], b, a))
            goes = ((size > FEW + 1) | ((which == 0) & cut)) & (nth > 0)
            goes &= fresh_rep | ((which == 0) & (not many) & (not cut))  # those held so far have only now become many
            if goes.any():
                got = split(t, rep[goes], first[goes], False)
                if got is not None:
                    yield got
            last = np.flatnonzero(which == which[-1])
            n_held = int(nth[last[-1]]) + 1
            cut = cut and which[-1] == 0
            held = t.take(pa.array(rep[last] if n_held <= FEW + 1 else rep[last[[0, -1]]]))
        if held is not None and not cut:
            yield links(held, np.array([0]), None)
            got = [split(held, np.array([0]), np.array([0]), True)]
            if n_held <= FEW + 1:
                x = np.arange(1, held.num_rows)
                got.append(split(held, x, np.zeros(len(x), dtype=np.int64), False))
            yield from (g for g in got if g is not None)

    return found.sortWithinPartitions("key", "around", "d", "c").mapInArrow(run, LINK)


def narrower(links: DataFrame) -> DataFrame:
    """Classes to be split, once for each min-hash named in todo, under a key of the old one and that min-hash."""
    at = links.where(F.col("todo").isNotNull()).select("*", F.explode(F.array(*(F.lit(i) for i in range(SIDES)))).alias("i"))
    at = at.where(F.call_function("shiftright", "todo", F.col("i")).bitwiseAND(F.lit(1)) != 0)
    word = F.call_function("shiftright", F.col("near"), F.col("i") * 16).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    low = F.col("key").bitwiseAND(F.lit(7).cast("bigint")) + (F.col("i") + 1) * 8
    key = F.xxhash64("key", "i", word).bitwiseAND(F.lit(-64).cast("bigint")) + low
    return at.select(key.alias("key"), F.col("xd").alias("d"), F.col("xc").alias("c"), F.col("xl").alias("l"), F.col("xr").alias("r"), "near", "around")


def all_links(docs: DataFrame, min_words: int, hashes: int, size: int) -> DataFrame:
    """Links of windows over all keys and those that they are split into, stored."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = windows(docs, min_words, hashes, size, ranges(docs, min_words, hashes, size, partitions))
    level = out = stored(linked(found.repartitionById(partitions, "part").drop("part")), "window-links")
    for _ in range(SIDES):
        if level.where(F.col("todo").isNotNull()).isEmpty():
            break
        level = stored(linked(narrower(level).repartitionByRange(partitions, "key", "around", "d")), "window-links")
        out = out.union(level)
    return out.where(F.col("todo").isNull()).drop("near", "around", "todo")


def regions(links: DataFrame, min_words: int, size: int, agree: int) -> DataFrame:
    """xd, xlo, xhi, yd, ylo, yhi: where enough hashes' intervals of two texts overlap, in shingle numbers."""
    parts = links.where(F.col("yd").isNull()).select("key", "xd", "xc", "xl", "xr").distinct()
    firsts = parts.groupBy("key").agg(F.min(F.struct("xd", "xc", "xl", "xr")).alias("y"), F.count("*").alias("n")).where(F.col("n") > 1).select("key", "y")
    across = parts.join(firsts, "key").select("key", "xd", "xc", "xl", "xr", F.col("y.xd").alias("yd"), F.col("y.xc").alias("yc"), F.col("y.xl").alias("yl"), F.col("y.xr").alias("yr")).where(F.col("xd") != F.col("yd"))
    every = links.where(F.col("yd").isNotNull()).unionByName(across)
    a, b = F.least(F.col("xc") - F.col("xl"), F.col("yc") - F.col("yl")), F.least(F.col("xr") - F.col("xc"), F.col("yr") - F.col("yc"))
    aligned = every.withColumn("a", a).withColumn("b", b).where(F.col("a") + F.col("b") + size >= min_words)
    aligned = aligned.select(F.col("key").bitwiseAND(F.lit(7).cast("bigint")).cast("int").alias("k"), "xd", "yd", "xc", "yc", "a", "b")
    pair = Window.partitionBy("xd", "yd").orderBy("shift", "xc")
    upto = pair.rowsBetween(Window.unboundedPreceding, 0)
    shifted = aligned.withColumn("shift", F.col("xc") - F.col("yc")).withColumn("far", (F.col("shift") - F.lag("shift").over(pair) >= SHIFT).cast("int"))
    together = shifted.withColumn("cluster", F.coalesce(F.sum("far").over(upto), F.lit(0)))
    spans = together.select("k", "xd", "yd", "cluster", (F.col("xc") - F.col("a")).alias("xlo"), (F.col("xc") + F.col("b")).alias("xhi"), (F.col("yc") - F.col("a")).alias("ylo"), (F.col("yc") + F.col("b")).alias("yhi"))
    place = Window.partitionBy("xd", "yd", "cluster").orderBy("xlo", "xhi")
    new = F.coalesce(F.col("xlo") > F.max("xhi").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = spans.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("xd", "yd", "cluster", "island").agg(F.min("xlo").alias("xlo"), F.max("xhi").alias("xhi"), F.min("ylo").alias("ylo"), F.max("yhi").alias("yhi"), F.bit_count(F.expr("bit_or(shiftleft(1, k))")).alias("hashes"))
    wide = merged.where(F.col("hashes") >= agree)
    return wide.select("xd", "xlo", "xhi", "yd", (F.floor(F.col("ylo") / 32) * 32).cast("int").alias("ylo"), ((F.floor(F.col("yhi") / 32) + 1) * 32).cast("int").alias("yhi")).distinct()


def token_slices(asked: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """d, lo, hi, tokens (what moves of the hash of each shingle) of the asked parts of texts."""
    by_doc = asked.groupBy("d").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    some, _ = sifted(docs.selectExpr("cast(doc_id AS bigint) AS _id", "text"), "_id", asked.select(F.col("d").alias("id")))
    joined = some.join(by_doc, F.col("_id") == F.col("d")).select("d", "parts", "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.Table:
            tokens, at = shingle_lists(texts_of(batch), size)
            parts = batch.column(1)
            flat = parts.flatten()
            lo, hi = (flat.field(i).to_numpy() for i in range(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            a = np.minimum(at[row] + lo, at[row + 1])
            b = np.minimum(at[row] + hi + 1, at[row + 1])
            rows = textcodes.to_move(tokens)
            raw = [rows[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            return pa.table({"d": batch.column(0).take(pa.array(row)), "lo": lo, "hi": hi, "tokens": pa.array(raw, pa.binary())})

        return work

    return joined.mapInArrow(per_batch(make), "d bigint, lo int, hi int, tokens binary")


def longest_stretches(same: np.ndarray, at: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part same[at[i] : at[i + 1]], start and end in same of the longest stretch in which matches, at 1, outweigh misses, at miss[i]; it starts and ends with a match."""
    size, n = np.diff(at), len(at) - 1
    part = np.repeat(np.arange(n), size)
    total = np.zeros(len(same) + n)
    place = np.arange(len(same)) + part + 1  # each part has a place before its first
    total[place] = np.where(same, 1.0, -miss[part])
    first = at[:-1] + np.arange(n)
    total[first] = -float((size.max(initial=0) + 1) * (miss.max(initial=0) + 1) * 2)  # so that each part is below those before it
    total = np.cumsum(total)
    later = np.maximum.accumulate(total[::-1])[::-1]  # falls, so that the last place with as much as any start has is found by bisection
    ends = np.searchsorted(-later, -total, side="right") - 1
    longest = ends - np.arange(len(total))
    most = np.maximum.reduceat(longest, first)
    starts = np.flatnonzero(longest == np.repeat(most, size + 1))
    start = starts[np.searchsorted(starts, first)]
    a, b = start - np.arange(n), ends[start] - np.arange(n)
    hits = np.flatnonzero(same)
    x, y = np.searchsorted(hits, a), np.searchsorted(hits, b) - 1
    some = x <= y
    a[some], b[some] = hits[x[some]], hits[y[some]] + 1
    b[~some] = a[~some]
    return a, b


def verified_pairs(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """Of each pair of token lists, the stretches of both that are near duplicates, as rows: number of the pair, start and end in x, start and end in y.

    The longest stretch of x with enough of y's tokens comes first, then those beside it. The Jaccard similarity of the sets alone decides. As all misses may be on one side, a stretch is first chosen as if the other side had none; where it falls short, the purer ones in it are tried. All pairs are worked on at once, one stretch of each in a round."""
    sizes = np.diff(x_at), np.diff(y_at)
    n = len(sizes[0])
    _, short = np.unique(np.concatenate([x, y]), return_inverse=True)  # numbers of the tokens of this batch
    keys = np.concatenate([np.repeat(np.arange(n, dtype=np.uint64), s) for s in sizes]) << np.uint64(32) | short.astype(np.uint64)
    every, number = np.unique(keys, return_inverse=True)
    pair_of = (every >> np.uint64(32)).astype(np.int64)
    of_x, of_y = number[: len(x)], number[len(x) :]
    known = np.zeros(len(every), dtype=bool)
    known[of_y] = True
    known = known[of_x]
    miss = round(threshold / (1 - threshold), 9) if threshold < 1 else float(max([*sizes[0].tolist(), *sizes[1].tolist()], default=0) + 1)  # as many matches a miss make the similarity
    out: list[np.ndarray] = []
    todo = np.stack([np.arange(n, dtype=np.float64), x_at[:-1], x_at[1:], np.full(n, miss)], axis=1)
    while len(todo := todo[todo[:, 2] - todo[:, 1] >= least]):
        _, one = np.unique(todo[:, 0], return_index=True)  # of a pair one stretch in a round
        pair, lo, hi = todo[one, :3].astype(np.int64).T
        cost = todo[one, 3]
        rest = [np.delete(todo, one, axis=0)]
        a, b = longest_stretches(known[expand(lo, hi - lo)], np.concatenate([[0], np.cumsum(hi - lo)]), cost)
        move = lo - (np.cumsum(hi - lo) - (hi - lo))
        some = b - a >= least
        pair, lo, hi, cost, a, b = pair[some], lo[some], hi[some], cost[some], (a + move)[some], (b + move)[some]
        if not len(pair):
            todo = rest[0]
            continue
        rest += [np.stack([pair, lo, a, np.full(len(pair), miss)], axis=1), np.stack([pair, b, hi, np.full(len(pair), miss)], axis=1)]
        mine = np.zeros(len(every), dtype=bool)
        mine[of_x[expand(a, b - a)]] = True
        count = lambda marks: np.bincount(pair_of[marks], minlength=n)
        n_x = count(mine)
        open_ = np.arange(len(pair))
        for times in (1, 2, 4):
            p = pair[open_]
            begin = y_at[p]
            at = np.concatenate([[0], np.cumsum(sizes[1][p])])
            c, d = longest_stretches(mine[of_y[expand(begin, sizes[1][p])]], at, np.full(len(p), miss * times))
            c, d = c - at[:-1] + begin, d - at[:-1] + begin
            theirs = np.zeros(len(every), dtype=bool)
            theirs[of_y[expand(c, d - c)]] = True
            both = count(mine & theirs)[p]
            right = (d - c >= least) & (both >= threshold * (n_x[p] + count(theirs)[p] - both) - 1e-9)
            done = open_[right]
            out.append(np.stack([p[right], a[done] - x_at[p[right]], b[done] - x_at[p[right]], (c - y_at[p])[right], (d - y_at[p])[right]], axis=1))
            open_ = open_[~right]
            if not len(open_):
                break
        again = open_[cost[open_] <= (b - a)[open_]]
        rest.append(np.stack([pair[again], a[again], b[again], 2 * cost[again]], axis=1))
        todo = np.concatenate(rest)
    return np.concatenate(out) if out else np.zeros((0, 5), dtype=np.int64)


def verified(asked: DataFrame, docs: DataFrame, min_words: int, size: int, threshold: float) -> DataFrame:
    """xd, xlo, xhi, yd, ylo, yhi of near-duplicate passages, in words, ends exclusive."""
    parts = asked.select(F.col("xd").alias("d"), F.col("xlo").alias("lo"), F.col("xhi").alias("hi")).union(asked.select("yd", "ylo", "yhi")).distinct()
    slices = stored(token_slices(parts, docs, size), "slices")
    xs = slices.select(F.col("d").alias("xd"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"), F.col("tokens").alias("x"))
    ys = slices.select(F.col("d").alias("yd"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"), F.col("tokens").alias("y"))
    joined = asked.join(xs, ["xd", "xlo", "xhi"]).join(ys, ["yd", "ylo", "yhi"]).select("xd", "xlo", "yd", "ylo", "x", "y")
    least = min_words - size + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "x", PAIR_BYTES)):
            columns = [batch.column(i).to_numpy() for i in range(4)]
            tokens, offsets = [], []
            for i in (4, 5):
                raw = batch.column(i)
                at = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
                tokens.append(textcodes.moved(raw.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])) if len(raw) and at[-1] > at[0] else b""))
                offsets.append((at - at[0]) // textcodes.MOVED)
            out = verified_pairs(tokens[0], offsets[0], tokens[1], offsets[1], least, threshold)
            if len(out):
                i, a, b, c, d = out.T
                xd, xlo, yd, ylo = (z[i] for z in columns)
                yield pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip((xd, xlo + a, xlo + b + size - 1, yd, ylo + c, ylo + d + size - 1), (pa.int64(), pa.int32(), pa.int32()) * 2, strict=True)], names=["xd", "xlo", "xhi", "yd", "ylo", "yhi"])
        give_back()

    return joined.mapInArrow(run, "xd bigint, xlo int, xhi int, yd bigint, ylo int, yhi int")


def passage_links(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, hashes: int = HASHES, agree: int = AGREE, size: int = SHINGLE) -> DataFrame:
    """Verified pairs of near-duplicate passages of different texts, stored."""
    links = all_links(docs, min_words, hashes, size)
    asked = stored(regions(links, min_words, size, agree), "regions")
    return stored(verified(asked, docs, min_words, size, threshold), "passages")


#: Parts that a text's spans are first merged in, so that one that many texts repeat is many tasks' work.
_SALTS = 64


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, start, end, class_id of overlapping spans (d, lo, hi, with) taken together; first among those with partners of one remainder, then all."""

    def joined(spans: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("lo", "hi")
        new = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        islands = spans.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return islands.groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("with").alias("with")).drop("island")

    salted = joined(spans.withColumn("salt", F.pmod(F.xxhash64("with"), F.lit(_SALTS))), "d", "salt")
    return joined(salted.drop("salt"), "d").select(F.col("d").alias("doc_id"), F.col("lo").alias("start"), F.col("hi").alias("end"), F.least("with", "d").alias("class_id"))


def repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, end (words, end exclusive), n_words, class_id (the least id of a text found to hold the passage), for every passage that another text repeats."""
    found = passage_links(docs, **options)
    both = found.select(F.col("xd").alias("d"), F.col("xlo").alias("lo"), F.col("xhi").alias("hi"), F.col("yd").alias("with")).union(found.select("yd", "ylo", "yhi", "xd"))
    return merged(both).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "class_id")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs whose texts have lost the passages that a text with a smaller id holds, and n_chars, if there is one, as the new text has. A text that has nothing left goes; those without such passages stay as they are, and so do rows without an id."""
    found = passage_links(docs, **options)
    x_later = F.col("xd") > F.col("yd")
    gone = found.select(F.when(x_later, F.col("xd")).otherwise(F.col("yd")).alias("d"), F.when(x_later, F.col("xlo")).otherwise(F.col("ylo")).alias("lo"), F.when(x_later, F.col("xhi")).otherwise(F.col("yhi")).alias("hi"), F.when(x_later, F.col("yd")).otherwise(F.col("xd")).alias("with"))
    names, other, cut = docs.columns, fresh(docs, "_id"), fresh(docs, "_spans")
    spans = stored(merged(gone).groupBy(F.col("doc_id").alias(other)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut)), "spans")
    some, rest = sifted(docs, "doc_id", spans.select(F.col(other).alias("id")))
    joined = some.join(spans, F.col("doc_id") == F.col(other), "left").select(*names, cut)
    at = names.index("text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            spans = batch.column(len(names)).to_pylist()
            some = [i for i, s in enumerate(spans) if s and texts[i]]
            _, which, starts, ends = textcodes.words([texts[i] for i in some])
            first = np.searchsorted(which, np.arange(len(some) + 1))
            for k, i in enumerate(some):
                s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                out, done = [], 0
                for span in spans[i]:
                    a, b = min(span["start"], len(s)), min(span["end"], len(s))
                    if a < b:
                        out.append(texts[i][done : int(s[a])])
                        done = int(s[b]) if b < len(s) else int(e[b - 1])
                texts[i] = "".join([*out, texts[i][done:]])
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                old = batch.column(names.index("n_chars")).to_pylist()
                changed = set(some)
                columns[names.index("n_chars")] = pa.array([len(texts[i]) if i in changed else n for i, n in enumerate(old)], batch.schema.field("n_chars").type)
            emptied = {i for i in some if not texts[i].strip()}
            return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([i not in emptied for i in range(batch.num_rows)]))

        return work

    return joined.mapInArrow(per_batch(make), docs.schema).union(rest)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
