import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.functions.ema import with_emas
from barwright.operators import align, backtest, consensus, costs, features, learning, normalise, processes, resampling, rules, stats
from barwright.sources import bars as B
from barwright.streaming.bars import streaming_bars

START = datetime(2024, 1, 1)


def one(spark, values, name="x"):
    rows = [("s", START + timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series STRING, ts TIMESTAMP, {name} DOUBLE")


def walk(spark, n=300, seed=42, series=("EUR_USD", "USD_JPY")):
    out = []
    for k, s in enumerate(series):
        g = np.random.default_rng(seed + k)
        close = 1.1 + np.cumsum(g.normal(0, 1e-3, n))
        open_ = np.concatenate([[1.1], close[:-1]])
        spread = np.abs(g.normal(0, 5e-4, n))
        for i in range(n):
            out.append((s, START + timedelta(hours=i), float(open_[i]), float(max(open_[i], close[i]) + spread[i]), float(min(open_[i], close[i]) - spread[i]), float(close[i]), float(g.integers(100, 1000))))
    return spark.createDataFrame(out, B.BAR)


def values(df, column):
    return [r[0] for r in df.orderBy("ts").select(column).collect()]


def test_golden_vectors(spark):
    w = R.series_window()
    df = one(spark, [1.0, 3.0, 2.0, 5.0])
    x = F.col("x")
    assert values(df, R.delta(x, 1, w)) == [None, 2.0, -1.0, 3.0]
    assert values(df, R.d1(x, w)) == [None, 2.0, -1.0, 3.0]
    assert values(df, R.d2(x, w)) == [None, None, -3.0, 4.0]
    assert values(df, R.mean(x, 2, w)) == [None, 2.0, 2.5, 3.5]
    assert values(df, R.sd(x, 1, w)) == [None] * 4
    assert values(df, R.rank(x, 3, w)) == [None, None, 2 / 3, 1.0]


def test_constant_windows_divide_by_epsilon(spark):
    w = R.series_window()
    df = one(spark, [2.0] * 5)
    assert values(df, R.zscore(F.col("x"), 3, w))[2:] == [0.0] * 3
    assert values(df, R.position(F.col("x"), 3, w))[2:] == [0.0] * 3
    assert values(df, R.rho(F.col("x"), F.col("x"), 3, w)) == [None] * 5


def test_percentile_bounds():
    with pytest.raises(ValueError):
        R.percentile(None, 101, 5, None)


@pytest.mark.parametrize("n", [1, 2, 5, 200])
def test_ema_is_the_recurrence_across_blocks(spark, n):
    g = np.random.default_rng(3)
    data = [None, *g.normal(1, 0.1, 1200).tolist()]
    data[500] = None
    got = values(with_emas(one(spark, data), {"e": ("x", n)}), "e")
    a, y = 2 / (n + 1), None
    for v, e in zip(data, got, strict=True):
        if v is not None:
            y = v if y is None else a * v + (1 - a) * y
        assert e == pytest.approx(y, rel=1e-9) if y is not None else e is None


def test_feature_counts():
    assert sum(features.theoretical_counts(1).values()) == 782
    assert len(set(features.FeaturePlan().names())) == 782


def test_admission_drops_degenerate_features(spark):
    df = features.add_features(walk(spark, 60, series=("a",)), features.FeaturePlan(windows=(1, 5), variables=("close",), levels=(1,)))
    kept = features.admission(df, [c for c in df.columns if "__" in c])
    assert "mean_5__close" in kept and not {"sd_1__close", "z_1__close", "pos_1__close", "rank_1__close"} & set(kept)


def test_no_feature_sees_the_future(spark):
    w = R.series_window()
    df = walk(spark, 60, series=("a",))
    at = START + timedelta(hours=40)
    for name, op in R.WINDOWED.items():
        assert not normalise.sees_the_future(lambda d, op=op: d.withColumn("f", op(F.col("close"), 5, w)), df, "ts", at, "close", "f"), name
    assert normalise.sees_the_future(lambda d: d.withColumn("f", F.lead("close", 1).over(w)), df, "ts", at, "close", "f")


def test_point_in_time_shift(spark):
    w = R.series_window()
    df = walk(spark, 60, series=("a",))
    a = values(df, normalise.pit_rank(F.col("close"), 10, w))
    b = values(df.withColumn("k", R.rank(F.col("close"), 10, w)), F.lag("k", 1).over(w))
    assert a == b


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="close"):
        features.add_features(one(spark, [1.0]))


def test_as_of_prefers_exact_matches_and_keeps_tolerance(spark):
    left = spark.createDataFrame([("s", START + timedelta(days=d)) for d in (0, 1, 5, 20)], "series STRING, ts TIMESTAMP")
    right = spark.createDataFrame([("s", START + timedelta(days=d), float(d)) for d in (1, 4)], "series STRING, ts TIMESTAMP, v DOUBLE")
    got = values(align.as_of(left, right, ["v"], "7 DAYS", "r_"), "r_v")
    assert got == [None, 1.0, 4.0, None]


def test_split_dates():
    assert align.split_dates("2019-01-01", "2023-12-31") == ("2021-11-30", "2022-11-30")


def test_backtest_adds_up(spark):
    bars = walk(spark, 400)
    out = backtest.run(bars, costs.spread_table(spark), backtest.Config(stop=1.0, take=1.5)).toPandas()
    for s, rows in out.groupby("series"):
        t, e = rows[rows.kind == "trade"].sort_values("id"), rows[rows.kind == "equity"]
        assert len(e) == 400 and set(t.exit_reason) <= {"SL", "TP", "TIMEOUT", "FIN_BACKTEST"}
        assert t.capital.iloc[-1] == pytest.approx(100_000 + t.net_pnl.sum())
        assert (t.size_frac <= 0.10 + 1e-12).all() and (t.bars_open <= 50).all()
        long = t.direction == "LONG"
        assert ((t.stop_loss < t.entry_price) == long).all() and ((t.take_profit > t.entry_price) == long).all()
        assert (e.n_positions <= 1).all()
    with pytest.raises(ValueError):
        backtest.Config(risk=0.5)


def test_swap_triples_once(spark):
    df = spark.createDataFrame([(0, 2), (0, 3), (2, 1), (3, 4), (0, 0)], "d INT, n INT")
    got = [r[0] for r in df.select(costs.swap(F.lit(-1.0), F.lit(1.0), F.col("n"), F.col("d"))).collect()]
    assert got == [-2.0, -5.0, -3.0, -4.0, 0.0]


def test_total_cost_ignores_swap_earned(spark):
    row = spark.range(1).select(costs.total_cost(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.5)), costs.total_cost(F.lit(1.0), F.lit(2.0), F.lit(-3.0), F.lit(0.5))).first()
    assert tuple(row) == (3.5, 6.5)


def test_rule_sql(spark):
    df = spark.createDataFrame([(2.0, 0.1)], "a DOUBLE, b DOUBLE")
    sql = rules.rule_sql([{"feature": "a", "operator": ">", "threshold": 1, "weight": 0.6, "signal": "Long"}, {"feature": "b", "operator": "<", "threshold": 1, "weight": 0.4, "signal": "Short"}])
    assert df.selectExpr(sql).first()[0] == pytest.approx(0.2)


def test_weights_of_nothing(spark):
    df = rules.weights(spark.createDataFrame([("a", 0.0, "Long"), ("b", 0.0, "Short")], "feature STRING, ic DOUBLE, signal STRING"))
    assert sorted(r.signed_weight for r in df.collect()) == [-0.5, 0.5]


def test_redundant_features(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("a", "c", 0.2), ("b", "c", -0.97)], "a STRING, b STRING, r DOUBLE")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.05), ("c", 0.2)], "feature STRING, score DOUBLE")
    assert {r.feature for r in stats.redundancy(pairs, scores).collect() if not r.kept} == {"b"}


def test_category_order(spark):
    df = spark.createDataFrame([("a", "weak"), ("b", "strong"), ("c", "very strong")], "feature STRING, category STRING")
    assert sorted(r.feature for r in consensus.at_least(df, "strong").collect()) == ["b", "c"]


def test_robust_selection_falls_back(spark):
    ic = spark.createDataFrame([(f"f{i}", 0.03 + i / 1000, 1e-5) for i in range(30)], "feature STRING, ic DOUBLE, p_value DOUBLE")
    mi = spark.createDataFrame([(f"f{i}", float(i)) for i in range(30)], "feature STRING, mi DOUBLE")
    assert consensus.robust_selection(ic, mi, most=5).count() == 5
    assert [r.feature for r in consensus.robust_selection(ic, mi, fallback_below=1).collect()] == ["f29", "f28", "f27"]


def test_bootstrap_is_repeatable_and_right(spark):
    g = np.random.default_rng(42)
    df = one(spark, g.normal(0.0015, 0.02, 500).tolist(), "r")
    a, b = (resampling.bootstrap(df, "r", ["ts"], 400).orderBy("metric").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    row = a[a.metric == "annual_return"].iloc[0]
    real = np.mean([r.r for r in df.collect()]) * 252 * 100
    assert row.low < real < row.high and row["mean"] == pytest.approx(real, rel=0.2)


def test_permutation_finds_skill(spark):
    g = np.random.default_rng(1)
    y = g.normal(0, 0.02, 500)
    rows = [("s", START + timedelta(hours=i), float(v), float(0.3 * v + 0.7 * e)) for i, (v, e) in enumerate(zip(y, g.normal(0, 0.005, 500), strict=True))]
    df = spark.createDataFrame(rows, "series STRING, ts TIMESTAMP, y DOUBLE, p DOUBLE")
    out = resampling.permutation(df, "p", "y", ["ts"], 300).where("metric = 'sharpe'").first()
    assert out.significant and out.p_value < 0.01


def test_every_series_is_resampled(spark):
    g = np.random.default_rng(7)
    rows = [(s, START + timedelta(hours=i), float(v)) for s, mean in (("a", 0.01), ("b", -0.01)) for i, v in enumerate(g.normal(mean, 0.02, 200))]
    df = spark.createDataFrame(rows, "series STRING, ts TIMESTAMP, r DOUBLE")
    got = {(r.series, r.metric): r for r in resampling.bootstrap(df, "r", ["ts"], 250, keys=["series"]).collect()}
    assert len(got) == 12 and got["a", "annual_return"].low > 0 > got["b", "annual_return"].high
    alone = {r.metric: r for r in resampling.bootstrap(df.where("series = 'b'"), "r", ["ts"], 250).collect()}
    assert all(got["b", m].low == alone[m].low and got["b", m].high == alone[m].high for m in alone)
    assert resampling.permutation(df, "r", "r", ["ts"], 50, keys=["series"]).count() == 12


def test_processes(spark):
    g = np.random.default_rng(5)
    x = [1.0]
    for _ in range(3000):
        x.append(x[-1] + 0.1 * (1.0 - x[-1]) + g.normal(0, 0.01))
    df = one(spark, x, "close")
    ou = processes.ornstein_uhlenbeck(df).first()
    assert ou.theta == pytest.approx(0.1, rel=0.3) and ou.mu == pytest.approx(1.0, abs=0.02) and ou.half_life == pytest.approx(math.log(2) / ou.theta)
    assert processes.random_walk(df).first().variance_ratio < 1.0


def test_models(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(800, 3))
    y = 0.5 * x[:, 0] - 0.3 * x[:, 1] + 0.01 * g.normal(size=800)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")
    train, test = learning.scaled(*learning.assembled(df, ["a", "b", "c"], "y").randomSplit([0.8, 0.2], 1))
    model, found = learning.linear(train, test)
    assert found["r2"] > 0.99
    lasso, _ = learning.linear(train, test, "lasso", 0.05)
    assert not learning.coefficients(spark, lasso, ["a", "b", "c"]).where("feature = 'c'").first().non_zero


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "EUR_USD_H1.csv").write_text("time,open,high,low,close,volume\n2024-01-01 00:00:00,1.0,1.2,0.9,1.1,10\n2024-01-01 01:00:00,1.1,NaN,1.0,1.2,12\n")
    df = B.read_ohlcv_csv(spark, str(tmp_path / "*.csv"), "H1")
    assert df.select("series", "timeframe").distinct().collect() == [("EUR_USD", "H1")]
    assert [r.high for r in df.orderBy("ts").collect()] == [1.2, None]
    B.write_features(df, str(tmp_path / "out"))
    assert B.read_features(spark, str(tmp_path / "out"), ["series", "close"]).count() == 2
    with pytest.raises(ValueError):
        B.read_features(spark, str(tmp_path / "x.npz"))
    (tmp_path / "macro.csv").write_text("series_id,category,frequency,date,value\nA,c,d,2024-01-01,1.5\nA,c,d,2024-01-02,.\n")
    assert [r["A"] for r in B.macro_wide(B.read_macro_csv(spark, str(tmp_path / "macro.csv")), ["A"]).collect()] == [1.5]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), (1 + F.col("value") / 100).alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("order"))
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    a = spark.table("bars_out").orderBy("series", "ts").toPandas()
    b = B.tick_bars(events, "4 hours", F.col("series"), F.col("price"), F.col("volume"), F.col("ts"), F.struct("ts", "order")).orderBy("series", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_emas_over_blocks_and_groups(spark, monkeypatch):
    import random
    from datetime import datetime, timedelta

    from barwright.functions import ema

    monkeypatch.setattr(ema, "BLOCK", 7)
    monkeypatch.setattr(ema, "GROUP", 3)
    g = random.Random(1)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=i), None if i < 4 or g.random() < 0.2 else g.random(), g.random()) for s in ("a", "b") for i in range(200)] + [("c", datetime(2024, 1, 1), None, 1.0)]
    df = spark.createDataFrame(rows, "series STRING, ts TIMESTAMP, x DOUBLE, y DOUBLE")
    specs = {"x1": ("x", 1), "x5": ("x", 5), "y20": ("y", 20)}
    got = {(r.series, r.ts): r for r in ema.with_emas(df, specs).collect()}
    assert len(got) == len(rows)
    for out, (name, n) in specs.items():
        held = {}
        for s, ts, x, y in rows:
            v, a = (x if name == "x" else y), 2 / (n + 1)
            if v is not None:
                held[s] = v if s not in held else a * v + (1 - a) * held[s]
            value = got[s, ts][out]
            assert value is None if s not in held else abs(value - held[s]) < 1e-9
