"""Merkle manifests against trees made whole in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barwright.llm import merkle

SCHEMA = "doc_id BIGINT, lang STRING, text STRING, leaf STRING, root STRING, `at` INT"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i - i % 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        i //= 8
    return out


def want(rows):
    groups = {}
    for i, g, t in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf(i, g, t), i, t))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for j, (_, _, own, i, t) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = way(trees[g], j) + way(top, k)
            seen = leaf(i, g, "changed") if i is not None and i % 5 == 0 else own
            for a, b in path:
                seen = h(a + seen + b)
            out.append((i, own, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), seen, seen == top[-1][0]))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(i, g, t, "x", "y", 1) for i, g, t in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, merkle.manifest(df, ["doc_id", "lang", "text"], observed={"text": F.lit("changed")}, where_observed=F.col("doc_id") % 5 == 0).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 700])
def test_one_group(spark, n):
    rows = [(i, "en", f"t{i}") for i in range(1, n + 1)]
    assert got(spark, rows) == want(rows)


def test_many_groups_nulls_ties_repeats(spark):
    g = random.Random(1)
    rows = [(g.choice([None, *range(400)]), g.choice([None, "", "a", "B", "é", "en", "-"]), g.choice([None, "", "x", "y" * 5000, "é"])) for _ in range(1500)] + [(7, "one of a kind", "z")]
    assert got(spark, rows) == want(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d", 1)], SCHEMA).where("doc_id > 1")
    assert merkle.manifest(df, ["doc_id", "text"]).count() == 0


def test_tampering_shows_in_its_row_alone(spark):
    rows = [(i, "en", f"t{i}") for i in range(1, 1200)]
    for r in got(spark, rows):
        assert r[6] == (r[0] % 5 != 0)


def test_forests_merge_in_any_order():
    g = random.Random(2)
    sizes = {"a": 700, "b": 1, "c": 64}
    nodes = [(k, 0, i, h(f"{k}{i}")) for k, n in sizes.items() for i in range(n)]
    roots = {k: tree([h(f"{k}{i}") for i in range(n)])[-1][0] for k, n in sizes.items()}
    for _ in range(3):
        g.shuffle(nodes)
        parts = []
        for at in range(0, len(nodes), 50):
            f = merkle.Forest(sizes)
            for x in nodes[at : at + 50]:
                f.add(*x)
            parts.append(f)
        while len(parts) > 1:  # any two at a time
            g.shuffle(parts)
            parts.append(parts.pop().merge(parts.pop()))
        assert {k: node for k, _, _, node in parts[0].nodes()} == roots
        assert parts[0].merge(merkle.Forest(sizes)).open == parts[0].open


def test_depth_bounds_what_the_driver_gets():
    for n in (1, 10**6, 10**9, 6 * 10**10):
        assert n >> (3 * merkle.depth_for([n])) <= merkle.UPPER
