"""Models against second computations in memory: boosting, kernel machine, perceptron, walk-forward votes, k-nearest information, matrices."""

import math

import numpy as np
import pandas as pd
import pytest

from barwright.operators import boosting, comoments, forward, gradient, learning, mutual, networks


@pytest.fixture(scope="module")
def table():
    g = np.random.default_rng(5)
    x = g.normal(size=(800, 4))
    x[:, 3] = np.round(x[:, 3])
    y = np.sin(x[:, 0]) + 0.5 * (x[:, 1] > 0.3) * x[:, 2] + 0.1 * g.normal(size=800)
    return pd.DataFrame(x, columns=list("abcd")).assign(y=y, up=(y > 0).astype(float), id=range(800))


# ---- boosting


def plain_margin(model, x, y):
    """Depth-first or best-first growth by trying every split of every leaf."""
    s = model.settings
    bins, margin = model.binned(list(x.T)).astype(int), np.full(len(y), model.base)
    for _ in range(s.trees):
        g, h = boosting.gradients(y, margin, s.task)
        score = lambda i: g[i].sum() ** 2 / (h[i].sum() + s.l2)  # noqa: E731, B023

        def best(i):
            out = (-1.0, None)
            for f in range(bins.shape[1]):
                for c in range(s.bins - 1):
                    a, b = i[bins[i, f] <= c], i[bins[i, f] > c]
                    if min(len(a), len(b)) >= max(1, s.least_rows) and min(h[a].sum(), h[b].sum()) >= s.least_hessian:  # noqa: B023
                        gain = (score(a) + score(b) - score(i)) / 2  # noqa: B023
                        if gain > out[0] + 1e-12:
                            out = (gain, (a, b))
            return out

        leaves = [(np.arange(len(y)), 0)]
        while True:
            tried = [best(i) if s.growth == "leaf" or d < s.depth else (-1.0, None) for i, d in leaves]
            k = max(range(len(leaves)), key=lambda j: tried[j][0])
            if tried[k][0] <= s.least_gain or (s.growth == "leaf" and len(leaves) >= s.leaves):
                break
            leaves[k : k + 1] = [(part, leaves[k][1] + 1) for part in tried[k][1]]
        for i, _ in leaves:
            margin[i] -= s.rate * g[i].sum() / (h[i].sum() + s.l2)
    return margin


@pytest.mark.parametrize(
    ("settings", "y"),
    [(boosting.Settings(trees=3, depth=3, bins=16, store_every=2), "y"), (boosting.Settings(trees=2, growth="leaf", leaves=6, bins=16, task="classification", least_rows=20), "up")],
)
def test_boosting(spark, table, settings, y):
    df = spark.createDataFrame(table).repartition(5)
    model = boosting.fit(df, list("abcd"), y, settings)
    got = boosting.predicted(model, df).toPandas().sort_values("id").prediction.to_numpy()
    margin = plain_margin(model, table[list("abcd")].to_numpy(), table[y].to_numpy())
    assert got == pytest.approx(margin if settings.task == "regression" else 1 / (1 + np.exp(-margin)), abs=1e-12)
    assert sum(r.importance for r in boosting.importances(model, df).collect()) == pytest.approx(1)


def test_boosting_without_rows_or_splits(spark, table):
    df = spark.createDataFrame(table)
    none = boosting.fit(df.where("id < 0"), ["a"], "y", boosting.Settings(trees=2))
    assert not none.trees and boosting.predicted(none, df.limit(3)).collect()[0].prediction == 0
    same = boosting.fit(df.selectExpr("1.0 AS a", "y"), ["a"], "y", boosting.Settings(trees=2))
    assert not same.trees
    with pytest.raises(ValueError):
        boosting.Settings(growth="sideways")


# ---- kernel machine


def exact_machine(x, y, c, gamma, rounds=60):
    """Coordinate ascent of the dual, with a bias as a constant part of the kernel."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)) + 1
    alpha, f = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(rounds):
        for i in range(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * f[i]) / k[i, i], 0), c)
            f += (new - alpha[i]) * y[i] * k[i]
            alpha[i] = new
    return lambda z: (np.exp(-gamma * ((z[:, None] - x[None]) ** 2).sum(axis=2)) + 1) @ (alpha * y)


def test_kernel_machine_is_as_good_as_the_exact_one(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(4000, 2))
    y = np.where((x**2).sum(axis=1) + 0.3 * g.normal(size=4000) < 1.4, 1.0, -1.0)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "i": range(4000)}))
    m = gradient.kernel_machine(df.where("i < 2000"), ["a", "b"], "y", size=256)
    got = gradient.kernel_scores(m, df.where("i >= 2000")).toPandas().sort_values("i").score.to_numpy()
    z = (x - x[:2000].mean(axis=0)) / x[:2000].std(axis=0)
    exact = exact_machine(z[:2000], y[:2000], 1.0, 0.5, 20)(z[2000:])
    right = lambda s: (np.sign(s) == y[2000:]).mean()
    assert abs(right(got) - right(exact)) <= 0.01 and right(got) > 0.85
    assert all(a >= b for a, b in zip(m.losses, m.losses[1:])) or len(m.losses) > len(gradient.ROUNDED)


def test_kernel_machine_of_one_class(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)] + [(None, 1.0)], "a DOUBLE, y DOUBLE")
    out = gradient.kernel_scores(gradient.kernel_machine(df, ["a"], "y", size=16), df).collect()
    assert all(r.score > 0 for r in out if r.a is not None) and [r.score for r in out if r.a is None] == [None]


# ---- perceptron


def test_perceptron_follows_the_same_curve_as_in_memory(spark, table):
    t = gradient.Training(hidden=(8, 4), epochs=4, batches=3, rate=0.01, patience=2)
    df = spark.createDataFrame(table).repartition(4)
    train, later = df.where("id < 600"), df.where("id >= 600")
    m = gradient.perceptron(train, later, list("abcd"), "y", ("id",), t)
    from pyspark.sql import functions as F

    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    key = table.id.map(keys).to_numpy(dtype=np.int64)
    raw, y = table[list("abcd")].to_numpy(), table.y.to_numpy()
    x = (raw - raw[:600].mean(axis=0)) / raw[:600].std(axis=0)
    layers, step = gradient.first_layers(4, t), 0
    curve = []
    params = [p.copy() for layer in layers for p in layer]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def forward_pass(a, masks):
        acts = [a]
        for i in range(3):
            a = a @ params[2 * i] + params[2 * i + 1]
            if i < 2:
                a = np.maximum(a, 0) * (masks[i] if masks else 1)
            acts.append(a)
        return acts

    for epoch in range(len(m.losses)):
        total = n = 0
        for number in range(t.batches):
            on = np.flatnonzero((gradient.batch_of(key[:600], epoch, t) == number))
            masks = [gradient.kept_units(key[on], u, step, i, t) for i, u in enumerate(t.hidden)]
            acts = forward_pass(x[on], masks)
            off = acts[3][:, 0] - y[on]
            total, n, step = total + off @ off, n + len(on), step + 1
            delta = (2 * off / len(on))[:, None]
            for i in (2, 1, 0):
                gw, gb = acts[i].T @ delta, delta.sum(axis=0)
                if i:
                    delta = delta @ params[2 * i].T * masks[i - 1] * (acts[i] > 0)
                for at, gr in ((2 * i, gw), (2 * i + 1, gb)):
                    one[at], two[at] = 0.9 * one[at] + 0.1 * gr, 0.999 * two[at] + 0.001 * gr**2
                    params[at] = params[at] - t.rate * (one[at] / (1 - 0.9**step)) / (np.sqrt(two[at] / (1 - 0.999**step)) + 1e-7)
        error = ((forward_pass(x[600:], None)[3][:, 0] - y[600:]) ** 2).mean()
        curve.append((epoch, total / n, error, t.rate))
    for a, b in zip(m.losses, curve, strict=True):
        assert a == pytest.approx(b, rel=1e-9)
    out = gradient.perceptron_predictions(m, later).toPandas()
    assert ((out.prediction - out.y) ** 2).mean() == pytest.approx(min(x[2] for x in m.losses))


# ---- matrices, walk-forward, information


def test_comoments_of_many_columns(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(600, 300)) * 10 ** g.uniform(-3, 6, 300)
    x[:, 7], x[5, 3] = 0.1, np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(300)]).assign(k=np.arange(600) % 2)).repartition(7)
    got = comoments.correlations(df, [f"c{i}" for i in range(300)], ["k"]).toPandas()
    for k, q in got.groupby("k"):
        part = x[np.arange(600) % 2 == k]
        part = part[~np.isnan(part).any(axis=1)]
        a, b = (q[c].str[1:].astype(int).to_numpy() for c in "ab")
        with np.errstate(invalid="ignore"):
            want = np.corrcoef(part.T)[a, b]
        assert len(q) == 300 * 299 // 2 and (a < b).all() and set(q.n) == {len(part)}
        assert q.r.isna().sum() == 299 and np.nanmax(np.abs(q.r.to_numpy(dtype=float) - want)) < 1e-12


def test_parts_of_matrices_come_back():
    g = np.random.default_rng(4)
    x = g.normal(size=(50, 3)) + 1e6
    all_, first = comoments.Moments.of(x), comoments.Moments.of(x[:20])
    rest = all_ - first
    assert rest.n == 30 and rest.mean == pytest.approx(x[20:].mean(axis=0)) and np.allclose(rest.product, comoments.Moments.of(x[20:]).product, atol=1e-3)
    assert np.allclose((first + comoments.Moments.of(x[20:])).product, all_.product)


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def test_neighbour_information_against_all_pairs(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=3000)
    y = 0.6 * x + g.normal(size=3000)
    parts = {"dependent": (x, y), "constant": (np.ones(3000), y), "steps": (g.integers(0, 5, 3000).astype(float), y), "few": (np.array([1.0, 2, 3]), np.array([1.0, 2, 4])), "ties": (g.integers(0, 4, 400).astype(float), g.integers(0, 4, 400).astype(float)), "same": (y, y)}
    rows = pd.concat([pd.DataFrame({"feature": f, "value": v, "target": t}) for f, (v, t) in parts.items()] + [pd.DataFrame({"feature": ["dependent"], "value": [np.nan], "target": [1.0]})])
    got = {r.feature: (r.n, r.mi) for r in mutual.neighbour_mutual_information(spark.createDataFrame(rows), ["feature"]).collect()}
    assert got["few"] == (3, None)
    for f, (v, t) in parts.items():
        if f == "few":
            continue
        a, b = (np.round(z / (z.std() or 1) * mutual.UNITS).astype(np.int64) for z in (v, t))
        total = 0.0
        for i in range(len(a)):
            da, db = np.abs(a - a[i]), np.abs(b - b[i])
            eps = np.partition(np.delete(np.maximum(da, db), i), 2)[2]
            total += digamma(max((da < eps).sum() - 1, 0) + 1) + digamma(max((db < eps).sum() - 1, 0) + 1)
        want = max(digamma(len(a)) + digamma(3) - total / len(a), 0)
        assert got[f][0] == len(a) and got[f][1] == pytest.approx(want, abs=1e-9), f


def test_walk_forward_takes_further_votes(spark):
    days = pd.date_range("2020-01-01", periods=400, freq="D")
    g = np.random.default_rng(6)
    f = pd.DataFrame(g.normal(size=(400, 3)), columns=["a", "b", "c"]).assign(ts=days)
    f["y"] = f.a + 0.1 * g.normal(size=400)
    df = spark.createDataFrame(f)
    windows, models = forward.walk_forward_models(df, ["a", "b", "c"], "y", 120, 30, 30, most=1, threshold=4, fallback=1)
    fallback = models.toPandas()
    assert set(fallback[fallback.selected].feature) == {"a"} and fallback.votes.max() == 3
    more = windows.selectExpr("window", "'a' AS feature")
    _, models = forward.walk_forward_models(df, ["a", "b", "c"], "y", 120, 30, 30, most=1, threshold=4, fallback=3, votes=more)
    voted = models.toPandas()
    assert set(voted[voted.selected].feature) == {"a"} and voted.votes.max() == 4
    out = forward.walk_forward_predictions(df, windows, models, ["a", "b", "c"], "y").toPandas()
    assert np.corrcoef(out.y_true, out.y_pred)[0, 1] > 0.98


def test_average_linkage_against_all_pairs():
    g = np.random.default_rng(8)
    for n in (1, 2, 5, 25):
        p = g.normal(size=(n, 3))
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        for k in {1, max(1, n // 3), n}:
            groups = [[i] for i in range(n)]
            while len(groups) > k:
                _, i, j = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
                groups[i] += groups.pop(j)
            found = learning.linked(d, k)
            assert {frozenset(x) for x in groups} == {frozenset(np.flatnonzero(found == c).tolist()) for c in set(found.tolist())}


def test_modularity_is_greedy_against_trying_all_mergers():
    g = np.random.default_rng(9)
    n = 22
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if g.random() < (0.6 if a // 8 == b // 8 else 0.08)]
    m, degree = len(edges), np.zeros(n)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1

    def modularity(group):
        return sum(group[a] == group[b] for a, b in edges) / m - sum((degree[[i for i in range(n) if group[i] == c]].sum() / (2 * m)) ** 2 for c in set(group))

    group = list(range(n))
    while True:
        now, best = modularity(group), None
        for u in sorted(set(group)):
            for v in sorted(set(group)):
                if u < v and any({group[a], group[b]} == {u, v} for a, b in edges):
                    gain = modularity([u if c == v else c for c in group]) - now
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, u, v)
        if best is None or best[0] < -1e-12:
            break
        group = [best[1] if c == best[2] else c for c in group]
    assert networks.merged_groups([f"{i:02d}" for i in range(n)], edges) == group
    assert networks.merged_groups(["a", "b"], []) == [0, 1]


def test_betweenness_of_known_graphs(spark):
    pairs = lambda edges, n: spark.createDataFrame([(f"{a:02d}", f"{b:02d}", 0.9 if (a, b) in edges else 0.1) for a in range(n) for b in range(a + 1, n)], "a STRING, b STRING, r DOUBLE")
    line = {r.node: r.betweenness for r in networks.betweenness(pairs({(i, i + 1) for i in range(4)}, 5)).collect()}
    assert [line[f"{i:02d}"] for i in range(5)] == pytest.approx([0, 3 / 6, 4 / 6, 3 / 6, 0])
    star = {r.node: r.betweenness for r in networks.betweenness(pairs({(0, i) for i in range(1, 6)}, 7)).collect()}
    assert star["00"] == pytest.approx(10 * 2 / 30) and sum(star.values()) == star["00"]
    assert {r.betweenness for r in networks.betweenness(pairs(set(), 2)).collect()} == {0.0}
    assert math.isclose(networks.network_summary(pairs({(0, 1)}, 3)).first().density, 1 / 3)


# ---- importances


def test_importances_of_planted_features(spark, table):
    """Trees find the features that y is made of; a permutation costs a linear model twice the variance that it explains by the feature."""
    df = spark.createDataFrame(table.assign(series="s", ts=pd.Timestamp("2024-01-01") + pd.to_timedelta(table.id, "h")))
    x = learning.assembled(df, list("abcd"), "y")
    for kind in ("forest", "boosting"):
        found = {r.feature: r.importance for r in learning.importances(spark, learning.trees(x, kind, size=10, depth=4), list("abcd")).collect()}
        assert sum(found.values()) == pytest.approx(1) and found["a"] > 0.5 > found["c"] > found["d"]
    model, _ = learning.linear(x, x, "ols")
    got = {r.feature: r.importance for r in learning.permutation_importance(model, x, list("abcd"), 10).collect()}
    w = np.linalg.lstsq(np.c_[table[list("abcd")], np.ones(800)], table.y, rcond=None)[0]
    for f, c in zip("abcd", w):
        assert got[f] == pytest.approx(2 * c * c * table[f].var(), rel=0.1, abs=0.01)
