"""Grouping of spelling variants.

Words of all documents are counted, by batches of a task first. Counted words become compact tries: ranges of the sorted vocabulary, each cut into shards of bounded size, which are rows of a table. As many shards as ROUND bytes allow are broadcast at a time. In the tasks the distance-one Levenshtein automaton of each word is intersected with every shard, depth first: a trie node and the three automaton cells that can still be one or less make a state, so that each node is visited once for a word, and branches that have used up their edit are left. Shards are ranges, so that most end after a few letters. What a word accepts is reduced where it is found, and over rounds by word: the number of near words, and the best form. Chains of forms are followed level by level; counts at least double from a word to its form, so there are no more levels than bits in a count. No two words are paired by a join, and the driver sees one round's shards at most.

Null texts hold no words. Words are folded for A-Z only. The null id is written as nothing where ids take part in slips. Equal counts go to the lesser word by code points. Documents that repeat count each. A run of letters of any length is one word; a word longer than a shard is a shard of its own. An empty table gives no rows. Columns other than the id and the text take no part, whatever their names."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import by_chars, expand, give_back, stored, table

#: Maximal runs of the letters A-Z, a-z and U+00C0-U+00FF in UTF-8, which are lower-cased bytes of A-Z when they get here.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
#: Different words that a task holds before it sends their counts.
HELD = 200_000
#: Letters, and words, of a shard; a trie node takes nine bytes and there is one for each letter at most.
SHARD_LETTERS, SHARD_WORDS = 1 << 20, 50_000
#: Bytes of shards that are broadcast at once.
ROUND = 48 << 20
#: Words that are searched together, and states that are expanded together.
SEARCHED, STATES = 2_048, 1 << 16
DEAD = 2


# ---- words


def slipped(doc: bytes, words: Counter, every: int = 97) -> Iterator[tuple[bytes, int]]:
    """Words of one document with typing slips: where crc32 of `<doc_id>:<word>` is divisible by `every`, one letter is missing."""
    start = zlib.crc32(doc + b":")
    for word, n in words.items():
        h = zlib.crc32(word, start)
        if h % every == 0:
            letters = word.decode()
            at = h % len(letters)
            word = (letters[:at] + letters[at + 1 :]).encode()
        yield word, n


def as_they_are(doc: bytes, words: Counter) -> Iterable[tuple[bytes, int]]:
    return words.items()


def counted(each: Callable[[bytes, Counter], Iterable[tuple[bytes, int]]], least_letters: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for whole in batches:
            for batch in by_chars(whole):
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if not text:
                        continue
                    for word, n in each((doc or "").encode(), Counter(RUN.findall(text.lower()))):  # lower() of bytes is that of A-Z
                        if len(word) >= least_letters and (word.isascii() or len(word.decode()) >= least_letters):
                            total[word] += n
                if len(total) > HELD:
                    yield flush()
        if total:
            yield flush()
        give_back()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each=as_they_are, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """word and n: words of so many letters that occur so often in all of docs."""
    texts = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"))
    return texts.mapInArrow(counted(each, least_letters), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# ---- tries


class Trie:
    """Nodes in order of level, then of what leads to them, so that a node's children are a range: first[node] to first[node + 1]. word[node] is the word that ends there, or -1."""

    def __init__(self, label: np.ndarray, first: np.ndarray, word: np.ndarray, words: list[bytes], n: np.ndarray) -> None:
        self.label, self.first, self.word, self.words, self.n = label, first, word, words, n

    @staticmethod
    def of(words: list[bytes], n: np.ndarray) -> Trie:
        """words: sorted, different, a byte a letter (Latin-1)."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.cumsum(length) - length
        node = np.zeros(len(words), dtype=np.int64)
        labels, parents, ends = [np.zeros(1, np.uint8)], [], [(np.flatnonzero(length == 0), node[length == 0])]
        nodes, depth, alive = 1, 0, np.flatnonzero(length > 0)
        while len(alive):
            letter, parent = flat[start[alive] + depth], node[alive]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            node[alive] = nodes - 1 + np.cumsum(new)
            labels.append(letter[new])
            parents.append(parent[new])
            nodes += int(new.sum())
            depth += 1
            over = length[alive] == depth
            ends.append((alive[over], node[alive[over]]))
            alive = alive[~over]
        word = np.full(nodes, -1, dtype=np.int32)
        for which, at in ends:
            word[at] = which
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        first = (1 + np.searchsorted(parent, np.arange(nodes + 1))).astype(np.int32)
        return Trie(np.concatenate(labels), first, word, words, n)

    def row(self) -> dict:
        return {"label": self.label.tobytes(), "first": self.first.tobytes(), "word": self.word.tobytes(), "words": b"\n".join(self.words), "n": self.n.tobytes()}

    @staticmethod
    def read(row) -> Trie:
        return Trie(np.frombuffer(row["label"], np.uint8), np.frombuffer(row["first"], np.int32), np.frombuffer(row["word"], np.int32), bytes(row["words"]).split(b"\n"), np.frombuffer(row["n"], np.int64))


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of sorted words that come with their counts."""
    words, n, letters = [], [], 0

    def made() -> pa.RecordBatch:
        trie = Trie.of(words, np.array(n, dtype=np.int64)).row()
        return pa.RecordBatch.from_arrays([pa.array([words[0].decode("latin-1")]), pa.array([sum(map(len, trie.values()))], pa.int64()), *(pa.array([x], pa.binary()) for x in trie.values())], names=["least", "n_bytes", *trie])

    for batch in batches:
        for word, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if words and (len(words) >= SHARD_WORDS or letters + len(word) > SHARD_LETTERS):
                yield made()
                words, n, letters = [], [], 0
            words.append(word.encode("latin-1"))
            n.append(count)
            letters += len(word)
    if words:
        yield made()


# ---- search


class Automata:
    """The distance-one automata of many words. At depth d of a trie, cell j - d of a state is the least number of edits that turn the first j letters into what leads to the node; only j = d - 1, d, d + 1 can be one or less."""

    def __init__(self, words: list[bytes]) -> None:
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(words) + b"\x00", dtype=np.uint8)

    def letter(self, which: np.ndarray, j: int) -> np.ndarray:
        """The letter at j, 0 (no trie's letter) before the first and after the last."""
        inside = self.length[which] > j if j >= 0 else np.zeros(len(which), dtype=bool)
        return np.where(inside, self.flat[np.where(inside, self.start[which] + j, 0)], 0)

    def accepted(self, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word and a word of the trie that are one edit apart."""
        every = np.arange(len(self.length))
        dead = np.full(len(every), DEAD, dtype=np.uint8)
        stack = [(0, every, np.zeros(len(every), dtype=np.int64), dead, dead - DEAD, np.where(self.length > 0, 1, DEAD).astype(np.uint8))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while stack:
            depth, which, node, a, b, c = stack.pop()
            if len(which) > STATES:
                half = len(which) // 2
                stack += [(depth, which[half:], node[half:], a[half:], b[half:], c[half:]), (depth, which[:half], node[:half], a[:half], b[:half], c[:half])]
                continue
            before, here, after = (self.letter(which, depth + i) for i in (-1, 0, 1))
            children = (trie.first[node + 1] - trie.first[node]).astype(np.int64)
            up = np.repeat(np.arange(len(which)), children)
            child = expand(trie.first[node].astype(np.int64), children)
            letter = trie.label[child]
            which, a, b, c = which[up], a[up], b[up], c[up]
            beyond = self.length[which] - depth  # cells of more letters than the word has are dead
            x = np.minimum(b + 1, a + (before[up] != letter))
            x[beyond < 0] = DEAD
            y = np.minimum(np.minimum(c + 1, b + (here[up] != letter)), x + 1)
            y[beyond < 1] = DEAD
            z = np.minimum(c + (after[up] != letter), y + 1)
            z[beyond < 2] = DEAD
            at_end = np.where(beyond == 0, x, np.where(beyond == 1, y, np.where(beyond == 2, z, DEAD)))
            hit = (at_end == 1) & (trie.word[child] >= 0)
            if hit.any():
                found.append((which[hit], trie.word[child[hit]]))
            on = np.minimum(np.minimum(x, y), z) < DEAD
            if on.any():
                stack.append((depth + 1, which[on], child[on], x[on].astype(np.uint8), y[on].astype(np.uint8), z[on].astype(np.uint8)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).astype(np.int64)


def nearest(words: list[bytes], tries: list[Trie]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Of each word: how many near words, the most frequent one's count, and it (the least of equal ones)."""
    automata = Automata(words)
    near, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
    for trie in tries:
        which, other = automata.accepted(trie)
        if not len(which):
            continue
        near += np.bincount(which, minlength=len(words))
        order = np.lexsort((other, -trie.n[other], which))  # words of a trie are sorted
        which, other = which[order], other[order]
        for i in np.flatnonzero(np.diff(which, prepend=-1)).tolist():
            w, form, n = int(which[i]), trie.words[other[i]], int(trie.n[other[i]])
            if n > best_n[w] or (n == best_n[w] and form < best[w]):
                best_n[w], best[w] = n, form
    return near, best_n, best


def searched(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.read(x) for x in shared.value]
        for whole in batches:
            for a in range(0, whole.num_rows, SEARCHED):
                batch = whole.slice(a, SEARCHED)
                words = batch.column("word").to_pylist()
                near, n, best = nearest([x.encode("latin-1") for x in words], tries)
                hit = np.flatnonzero(near).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in hit], pa.string()), pa.array(near[hit], pa.int64()), pa.array(n[hit], pa.int64()), pa.array([best[i].decode("latin-1") for i in hit], pa.string())], names=["word", "n_near", "best_n", "best"])
        give_back()

    return run


def in_rounds(sizes: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Shards, in order, so many at a time as have `most` bytes together, one at least."""
    held, total = [], 0
    for least, n in sizes:
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(least)
        total += n
    if held:
        yield held


def near_words(words: DataFrame, round_bytes: int = ROUND) -> DataFrame:
    """word, n_near, best_n, best of every word (columns word and n, stored) that has a near one."""
    spark = words.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tries = stored(words.repartitionByRange(n, "word").sortWithinPartitions("word").mapInArrow(shards, "least string, n_bytes bigint, label binary, first binary, word binary, words binary, n binary"), "spelling-tries")
    sizes = sorted((r["least"], r["n_bytes"]) for r in tries.select("least", "n_bytes").collect())  # a row for each shard, of up to 50,000 words
    dealt = words.select("word").repartition(n)  # searches of equal number, not of equal range
    rounds = []
    for leasts in in_rounds(sizes, round_bytes):
        rows = tries.where(F.col("least").between(leasts[0], leasts[-1])).drop("n_bytes").collect()  # round_bytes at most, or one shard
        shared = spark.sparkContext.broadcast([r.asDict() for r in sorted(rows, key=lambda r: r["least"])])
        rounds.append(stored(dealt.mapInArrow(searched(shared), "word string, n_near bigint, best_n bigint, best string"), "spelling-near"))
        shared.unpersist()
    if not rounds:
        return spark.createDataFrame([], "word string, n_near bigint, best_n bigint, best string")
    found = rounds[0]
    for more in rounds[1:]:
        found = found.union(more)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))  # the most frequent, then the least
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ..., stored) with root: where the chain of forms from a word ends.

    Level by level from the ends: each level joins the words that are left with those that the level before has resolved. A form has as many words as there are edits of it, so that no key of these joins is hot."""
    done = [forms.where(F.col("form").isNull()).select("word", F.col("word").alias("root"))]
    left = forms.where(F.col("form").isNotNull()).select("word", "form")
    while True:
        level = stored(left.join(done[-1].select(F.col("word").alias("form"), "root"), "form", "left"), "spelling-roots")
        done.append(level.where(F.col("root").isNotNull()).select("word", "root"))
        left = level.where(F.col("root").isNull()).select("word", "form")
        if not left.take(1):
            break
    roots = done[0]
    for more in done[1:]:
        roots = roots.union(more)
    return forms.join(roots, "word")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each=as_they_are, least_letters: int = 5, least_n: int = 3, ratio: int = 2, round_bytes: int = ROUND) -> DataFrame:
    """A row for each word of docs that is frequent enough: its form (the most frequent word one edit away, if it is `ratio` times as frequent), the root of its chain of forms, its count, how many near words it has, and its form's count."""
    words = stored(vocabulary(docs, id_col, text_col, each, least_letters, least_n), "spelling-words")
    near = near_words(words, round_bytes)
    ok = F.col("best_n") >= ratio * F.col("n")
    only: Callable[[str], Column] = lambda c: F.when(ok, F.col(c))
    forms = stored(words.join(near, "word", "left").select("word", only("best").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), only("best_n").alias("form_n")), "spelling-forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), each=slipped)
