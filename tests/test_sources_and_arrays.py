"""NPZ archives, CSV readers, array kernels against the rolling algebra, and the event search of the backtest against a loop over bars."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions import arrays
from barwright.operators import backtest, costs, features
from barwright.sources import bars as B
from barwright.sources import npz

START = datetime(2024, 1, 1)


def walk(spark, n, series=("EUR_USD", "s"), seed=1):
    g, rows = random.Random(seed), []
    for s in series:
        p = 1.1
        for i in range(n):
            o, p = p, p * (1 + g.gauss(0, 0.004))
            rows.append((s, START + timedelta(hours=i), o, max(o, p) * 1.001, min(o, p) * 0.999, p, float(g.randint(1, 9))))
    return spark.createDataFrame(rows, "series STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE")


# ---- NPZ


def test_archives_of_numpy_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(npz, "CHUNK_BYTES", 100)
    x = np.arange(60, dtype=np.float32).reshape(5, 3, 4)
    np.savez(tmp_path / "a.npz", x=x, f=np.asfortranarray(x[:, :, 0]), names=np.array(["one", "two"]), single=np.float64(7), none=np.zeros((0, 3)))
    np.savez_compressed(tmp_path / "b.npz", z=np.arange(8))
    got = {}
    for r in npz.read_npz(spark, str(tmp_path)).collect():
        got.setdefault(r["array"], {})[r["index"]] = (tuple(r["shape"]), r["values"] if r["texts"] is None else r["texts"])
    assert {i: v for i, (_, v) in got["x"].items()} == {i: x[i].ravel().tolist() for i in range(5)} and got["x"][0][0] == (3, 4)
    assert {i: v for i, (_, v) in got["f"].items()} == {i: x[i, :, 0].tolist() for i in range(5)}
    assert [got["names"][i][1] for i in range(2)] == [["one"], ["two"]] and got["single"][0][1] == [7.0] and "none" not in got
    assert [got["z"][i][1] for i in range(8)] == [[float(i)] for i in range(8)]


def test_archives_round_trip(spark, tmp_path):
    rows = [("x", i, [2, 2], [float(i), None if i == 3 else 1.0, 2.0, 3.0], None) for i in range(20)] + [("w", i, [], None, [f"t{i}"]) for i in range(3)]
    df = spark.createDataFrame(rows, npz.SCHEMA).repartition(3)
    npz.write_npz(df, str(tmp_path / "out"))
    got = {(r["array"], r["index"]): r for r in npz.read_npz(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 23 and got["w", 2]["texts"] == ["t2"] and list(got["x", 7]["shape"]) == [2, 2] and got["x", 7]["values"] == [7.0, 1.0, 2.0, 3.0]
    assert np.isnan(got["x", 3]["values"][1])
    npz.write_npz(df.where("index = 1 AND array = 'x'"), str(tmp_path / "out"), "overwrite")
    assert npz.read_npz(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="differ in shape"):
        npz.write_npz(spark.createDataFrame([("x", 0, [1], [1.0], None), ("x", 1, [2], [1.0, 2.0], None)], npz.SCHEMA).coalesce(1), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.npz"))


# ---- CSV


def test_numbers_from_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("time,note,r\n2024-01-01 00:00:00,a,0.5\n2024-01-02 00:00:00,b,\n2024-01-03 00:00:00,c,NaN\n2024-01-04 00:00:00,d,-1.5\n")
    assert [r.r for r in B.returns_from_csv(spark, str(tmp_path / "r.csv"), time="time").orderBy("ts").collect()] == [0.5, -1.5]
    with pytest.raises(ValueError, match="y_pred"):
        B.predictions_from_csv(spark, str(tmp_path / "r.csv"), actual="r", time="time")


def test_features_with_target_keeps_common_times(spark, tmp_path):
    df = spark.createDataFrame([("s", START + timedelta(days=i), float(i)) for i in range(5)], "series STRING, ts TIMESTAMP, v DOUBLE")
    B.write_csv(df.withColumnRenamed("v", "f"), f"{tmp_path}/f.csv")
    B.write_csv(df.where("v > 1").withColumnRenamed("v", "target"), f"{tmp_path}/t.csv")
    out = B.features_with_target(spark, f"{tmp_path}/f.csv", f"{tmp_path}/t.csv", keys=("series",)).collect()
    assert sorted((r.f, r.target) for r in out) == [(2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]


# ---- arrays


def test_rows_of_features_are_the_columns(spark):
    bars = walk(spark, 130, ("a",)).withColumn("volume", F.when(F.col("volume") == 3, F.lit(None)).otherwise(F.col("volume")))
    flat = bars.withColumn("close", F.when(F.hour("ts") < 12, F.lit(1.0)).otherwise(F.col("close")))
    plan = features.FeaturePlan(windows=(1, 2, 5, 20), variables=("close", "volume"))
    want = features.add_features(flat, plan).toPandas().set_index("ts")
    got = features.feature_rows(flat, plan, block_rows=60).toPandas().pivot(index="ts", columns="feature", values="value")
    assert sorted(got.columns) == sorted(plan.names())
    for name in plan.names():
        a, b = got[name].to_numpy(dtype=float), want[name].to_numpy(dtype=float)
        assert (np.isnan(a) == np.isnan(b)).all() and np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-6, atol=1e-7), name


def test_registered_operators_have_no_array_form(spark):
    with pytest.raises(ValueError, match="no array form of twice"):
        features.feature_rows(walk(spark, 30), features.FeaturePlan(operators=("mean", "twice")))


def test_frames_of_any_length():
    x = np.array([1.0, np.nan, 2, 2, 2, 5])
    f = arrays.framed(x, 3, {"mean", "sd", "rank"})
    assert np.isnan(f["mean"][:4]).all() and f["mean"][4:].tolist() == [2, 3] and f["sd"][4] == 0 and f["rank"][4] == pytest.approx(2 / 3)
    assert np.isnan(arrays.framed(x, 9, {"max"})["max"]).all() and np.isnan(arrays.framed(x, 1, {"sd"})["sd"]).all()


# ---- backtest


def loop(bars, c):
    """The state machine, bar by bar."""
    capital, p, trades, curve = c.capital, None, [], []
    slip = lambda atr, usual: max(costs.SLIPPAGE_LOW, min(costs.SLIPPAGE_BASE * (1 + costs.SLIPPAGE_PER_VOLATILITY * ((atr / usual if usual > 0 and atr is not None and atr == atr else 1.0) - 1)), costs.SLIPPAGE_HIGH))
    leave = lambda b, price: price - p["side"] * (b.spread + slip(b.atr, p["atr"])) * b.pip

    def close(b, price, why):
        nonlocal capital, p
        units = capital * p["size"] / p["entry"]
        net = p["side"] * (leave(b, price) - p["entry"]) * units - c.swap_per_night * (p["age"] // c.bars_per_day) * capital * p["size"] / 100_000
        trades.append((p["n"], b.n, p["age"], why, net, capital + net))
        capital, p = capital + net, None

    for b in bars.itertuples():
        if p:
            p["age"] += 1
            long = p["side"] > 0
            if b.low <= p["sl"] if long else b.high >= p["sl"]:
                close(b, p["sl"], "SL")
            elif b.high >= p["tp"] if long else b.low <= p["tp"]:
                close(b, p["tp"], "TP")
            elif p["age"] >= c.timeout:
                close(b, b.close, "TIMEOUT")
        if p is None and b.signal and b.atr == b.atr and b.atr > 0:
            entry, stop = b.close + b.signal * (b.spread + 0.3) * b.pip, b.atr * c.stop
            if stop >= entry * 0.0001:
                p = {"n": b.n, "side": b.signal, "entry": entry, "sl": entry - b.signal * stop, "tp": entry + b.signal * b.atr * c.take, "atr": b.atr, "age": 0, "size": min(capital * c.risk / stop / entry, c.most)}
        curve.append(capital + (p["side"] * (leave(b, b.close) - p["entry"]) * capital * p["size"] / p["entry"] if p else 0))
    if p:
        close(b, b.close, "FIN_BACKTEST")
    return trades, curve


@pytest.mark.parametrize("block_rows", [50, 10_000])
def test_backtest_is_the_loop_over_bars(spark, block_rows):
    c = backtest.Config(stop=1.0, take=1.5, timeout=12, bars_per_day=24, risk=0.05, most=0.9)
    bars = walk(spark, 260)
    out = backtest.run(bars, costs.spread_table(spark), c, block_rows).toPandas()
    ready = backtest.prepared(bars, costs.spread_table(spark), c).toPandas()
    for s, rows in out.groupby("series"):
        trades, curve = loop(ready[ready.series == s].sort_values("ts"), c)
        t = rows[rows.kind == "trade"].sort_values("id")
        assert len(t) == len(trades) > 5 and t.bars_open.tolist() == [x[2] for x in trades] and t.exit_reason.tolist() == [x[3] for x in trades]
        assert t.net_pnl.to_numpy() == pytest.approx([x[4] for x in trades]) and t.capital.to_numpy() == pytest.approx([x[5] for x in trades])
        assert rows[rows.kind == "equity"].sort_values("ts").equity.to_numpy() == pytest.approx(curve)


def test_backtest_without_signals(spark):
    out = backtest.run(walk(spark, 15), costs.spread_table(spark))
    assert {r.kind for r in out.collect()} == {"equity"} and out.where("n_positions > 0").count() == 0
