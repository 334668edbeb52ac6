"""Spelling groups against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barwright.llm import spelling

SCHEMA = "doc_id BIGINT, text STRING, word STRING, n STRING, form INT"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def want(counts, ratio=2):
    out, form = {}, {}
    for w, n in counts.items():
        beside = [x for x in counts if near(w, x)]
        best = min(beside, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = len(beside)
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], counts[form[w]] if form[w] else None))
    return sorted(rows)


def words_of(rows, slip):
    c = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = m.translate(low)
            if slip:
                x = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if x % 97 == 0:
                    w = w[: x % len(w)] + w[x % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if n >= 3 and len(w) >= 5}


@pytest.fixture(scope="module")
def rows():
    g = random.Random(4)
    base = ["".join(g.choice("abcdéÿÀ") for _ in range(g.randint(4, 8))) for _ in range(60)]
    many = [(i, " ".join(g.choice(base).upper() if g.random() < 0.2 else g.choice(base) for _ in range(200)) + "1,2") for i in range(40)]
    return many + [(None, "aaaaaaa bbbbbbb " * 4), (900, None), (901, ""), (902, "123 ..."), (903, "z" * 20_000 + " " + "z" * 19_999), (904, ("z" * 20_000 + " ") * 9), (905, ("z" * 19_999 + " ") * 3), (906, "aaaaa×÷ " * 5)]


@pytest.mark.parametrize(("slip", "small"), [(True, False), (False, True)])
def test_groups(spark, rows, monkeypatch, slip, small):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(4)
    each = spelling.slipped if slip else spelling.as_they_are
    out = spelling.spelling_groups(df, each=each, round_bytes=20_000 if small else spelling.ROUND)
    assert sorted((tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == sorted(want(words_of(rows, slip)), key=repr)


def test_no_rows(spark):
    df = spark.createDataFrame([(1, "aaaaaa " * 3, "x", "y", 1)], SCHEMA)
    assert spelling.spelling_groups(df.where("doc_id > 1")).count() == 0
    assert spelling.spelling_groups(df).collect()[0]["root"] == "aaaaaa"


def test_chains_are_followed_to_their_end(spark):
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96}
    df = spark.createDataFrame([(1, " ".join(" ".join([w] * n) for w, n in chain.items()), "x", "y", 1)], SCHEMA)
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_groups(df).collect()}
    assert got["aaaaa"] == ("aaaab", "bbbbb") and got["bbbbb"] == (None, "bbbbb") and {x[1] for x in got.values()} == {"bbbbb"}


def test_tries_hold_their_words():
    words = sorted({bytes(random.Random(i).choices(b"abc\xe9", k=random.Random(i).randint(1, 6))) for i in range(300)})
    trie = spelling.Trie.read(spelling.Trie.of(words, np.arange(len(words))).row())
    found = []

    def walk(node, so_far):
        if trie.word[node] >= 0:
            found.append((so_far, int(trie.word[node])))
        for child in range(trie.first[node], trie.first[node + 1]):
            walk(child, so_far + bytes([trie.label[child]]))

    walk(0, b"")
    assert sorted(found) == [(w, i) for i, w in enumerate(words)]


def test_automata_visit_each_node_once(monkeypatch):
    words = sorted({bytes(random.Random(i).choices(b"ab", k=random.Random(i).randint(1, 7))) for i in range(200)})
    trie = spelling.Trie.of(words, np.ones(len(words), dtype=np.int64))
    monkeypatch.setattr(spelling, "STATES", 16)
    which, other = spelling.Automata(words).accepted(trie)
    pairs = list(zip(which.tolist(), other.tolist()))
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_merkle_manifest", "op13_exact_dedup"])
def test_matches_sql(spark, name):
    import duckdb

    from barwright.llm import registry

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rows = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    out = registry.queries()[name](spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows.fetchall()))
