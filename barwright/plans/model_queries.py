"""Queries of the backtest, resampling and models, each with the SQL that gives the same rows: the event loop is a recursive query, draws are integer hashes, and small linear systems are eliminated column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.operators import backtest, costs, features, learning, metrics, resampling, robustness, stats
from barwright.plans.analysis_queries import NAMES, RETURNS, WIDE, model_table, returns, wide
from barwright.plans.bar_queries import ADX_CTE, BARS, N, ROW, Query, W, bars, full, over, pos_sql, r9, s9, z_sql

# ---- backtest

CONFIG = backtest.Config(bars_per_day=6)
TRADE = ["pair", "id", "direction", "entry_time", "entry_price", "entry_spread", "entry_slippage", "size_frac", "at_risk", "stop_loss", "take_profit", "atr_entry", "bars_open", "exit_time", "exit_price", "exit_price_real", "exit_spread", "exit_slippage", "exit_reason", "gross_pnl", "cost_spread", "cost_slippage", "cost_swap", "net_pnl", "capital_after", "return_pct", "return_on_position"]


def result(spark: SparkSession, sf_dir: str, config: backtest.Config = CONFIG, block_rows: int = backtest.BLOCK_ROWS) -> DataFrame:
    return backtest.run(bars(spark, sf_dir), costs.spread_table(spark), config, block_rows)


def six(df: DataFrame) -> DataFrame:
    """Six decimals, and times without a zone."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes))


def s6(x: str) -> str:
    return f"(round({x}, 6) + 0)"


def slip_sql(atr: str, usual: str) -> str:
    return f"greatest({costs.SLIPPAGE_LOW}, least({costs.SLIPPAGE_BASE} * (1 + {costs.SLIPPAGE_PER_VOLATILITY} * (CASE WHEN {usual} > 0 AND {atr} IS NOT NULL THEN {atr} / {usual} ELSE 1 END - 1)), {costs.SLIPPAGE_HIGH}))"


def loop_sql(c: backtest.Config = CONFIG) -> str:
    """CTEs up to tr, the trades, and eq, the equity curve. st: a row for each bar, with the position after it (prefix p) and the trade that it closed."""
    held = ["n", "d", "t0", "entry", "spread0", "slip0", "size", "risk", "sl", "tp", "atr0", "age"]
    closed = ["x_price", "x_why", "x_slip", "x_real", "x_gross", "x_swap", "x_net"]
    kinds = {"n": "BIGINT", "d": "INTEGER", "t0": "TIMESTAMP", "age": "BIGINT", "x_why": "VARCHAR"}
    empty = ", ".join(f"CAST({'0' if k == 'n' else 'NULL'} AS {kinds.get(k, 'DOUBLE')}) AS {k}" for k in held + closed)
    old = ", ".join(f"CAST(NULL AS {kinds.get(k, 'DOUBLE')}) AS o_{k}" for k in held)
    return f"""{ADX_CTE}, g AS (SELECT series, ts, high, low, close, lag(atr, 1) {ROW} AS atr, row_number() {ROW} AS i, lag(close, 1) {ROW} / lag(close, 2) {ROW} - 1 AS r1, lag(close, 1) {ROW} / lag(close, 6) {ROW} - 1 AS r5 FROM a),
b AS (SELECT series, ts, i, high, low, close, atr, CAST({costs.DEFAULT_SPREAD} AS DOUBLE) AS spread, CAST(0.0001 AS DOUBLE) AS pip, CASE WHEN hour(ts) IN (21, 22, 23) OR (isodow(ts) = 5 AND hour(ts) >= 17) OR i <= 20 THEN 0 WHEN r1 > 0 AND r5 > 0 THEN 1 WHEN r1 < 0 AND r5 < 0 THEN -1 ELSE 0 END AS signal FROM g),
st AS (SELECT series, CAST(0 AS BIGINT) AS i, CAST({c.capital} AS DOUBLE) AS capital, false AS is_open, {empty}, {old} FROM (SELECT DISTINCT series FROM b)
UNION ALL
SELECT series, i, capital, is_open, CASE WHEN opens THEN n + 1 ELSE n END, {", ".join(f"CASE WHEN opens THEN {new} WHEN is_open THEN {k} END" for k, new in (("d", "signal"), ("t0", "ts"), ("entry", "e"), ("spread0", "spread"), ("slip0", "0.3::DOUBLE"), ("size", "sz"), ("risk", "capital * sz"), ("sl", f"e - signal * atr * {c.stop}"), ("tp", f"e + signal * atr * {c.take}"), ("atr0", "atr"), ("age", "0")))},
{", ".join(f"CASE WHEN shut THEN {k} END" for k in closed)}, {", ".join(f"CASE WHEN shut THEN {k} END" for k in held)} FROM (
SELECT *, (NOT is_open0 OR shut) AND signal <> 0 AND atr > 0 AND atr * {c.stop} >= e * 0.0001 AS opens, (is_open0 AND NOT shut) OR ((NOT is_open0 OR shut) AND signal <> 0 AND coalesce(atr, 0) > 0 AND coalesce(atr * {c.stop} >= e * 0.0001, false)) AS is_open, least(capital * {c.risk} / (atr * {c.stop}) / e, {c.most}) AS sz FROM (
SELECT *, close + signal * (spread + 0.3) * pip AS e, capital0 + CASE WHEN shut THEN x_net ELSE 0 END AS capital FROM (
SELECT *, x_gross - x_swap AS x_net FROM (
SELECT *, d * (x_real - entry) * risk / entry AS x_gross, {c.swap_per_night} * (age // {c.bars_per_day}) * risk / 100000 AS x_swap FROM (
SELECT *, x_price - d * (spread + x_slip) * pip AS x_real FROM (
SELECT *, x_why IS NOT NULL AS shut, CASE x_why WHEN 'SL' THEN sl WHEN 'TP' THEN tp WHEN 'TIMEOUT' THEN close END AS x_price, {slip_sql("atr", "atr0")} AS x_slip FROM (
SELECT b.*, s.capital AS capital0, s.is_open AS is_open0, s.n, s.d, s.t0, s.entry, s.spread0, s.slip0, s.size, s.risk, s.sl, s.tp, s.atr0, s.age + 1 AS age,
CASE WHEN NOT s.is_open THEN NULL WHEN CASE WHEN s.d = 1 THEN b.low <= s.sl ELSE b.high >= s.sl END THEN 'SL' WHEN CASE WHEN s.d = 1 THEN b.high >= s.tp ELSE b.low <= s.tp END THEN 'TP' WHEN s.age + 1 >= {c.timeout} THEN 'TIMEOUT' END AS x_why
FROM st s JOIN b ON b.series = s.series AND b.i = s.i + 1)))))))),
ends AS (SELECT s.*, b.ts, b.close, b.spread, b.pip, b.atr, {slip_sql("b.atr", "s.atr0")} AS l_slip FROM st s JOIN b USING (series, i) WHERE s.is_open QUALIFY s.i = max(s.i) OVER (PARTITION BY s.series) AND s.i = (SELECT max(i) FROM b WHERE b.series = s.series)),
fin AS (SELECT *, close - d * (spread + l_slip) * pip AS real, {c.swap_per_night} * (age // {c.bars_per_day}) * risk / 100000 AS sw FROM ends),
t0 AS (SELECT s.series, o_n AS n, o_d AS d, o_t0 AS t0, o_entry AS entry, o_spread0 AS spread0, o_slip0 AS slip0, o_size AS size, o_risk AS risk, o_sl AS sl, o_tp AS tp, o_atr0 AS atr0, o_age AS age, b.ts, x_price AS price, x_real AS real, b.spread, x_slip AS slip, x_why AS why, x_gross AS gross, x_swap AS sw, b.pip,
s.capital - 0 AS capital FROM st s JOIN b USING (series, i) WHERE x_why IS NOT NULL
UNION ALL SELECT series, n, d, t0, entry, spread0, slip0, size, risk, sl, tp, atr0, age, ts, close, real, spread, l_slip, 'FIN_BACKTEST', d * (real - entry) * risk / entry, sw, pip, capital + d * (real - entry) * risk / entry - sw FROM fin),
tr AS (SELECT series AS pair, n AS id, CASE WHEN d = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, t0 AS entry_time, entry AS entry_price, spread0 AS entry_spread, slip0 AS entry_slippage, size AS size_frac, risk AS at_risk, sl AS stop_loss, tp AS take_profit, atr0 AS atr_entry, age AS bars_open, ts AS exit_time, price AS exit_price, real AS exit_price_real, spread AS exit_spread, slip AS exit_slippage, why AS exit_reason, gross AS gross_pnl, (spread0 + spread) * pip * risk / entry AS cost_spread, (slip0 + slip) * pip * risk / entry AS cost_slippage, sw AS cost_swap, gross - sw AS net_pnl, capital AS capital_after, (gross - sw) / {c.capital} * 100 AS return_pct, (gross - sw) / risk * 100 AS return_on_position FROM t0),
eq AS (SELECT s.series AS pair, b.ts, s.capital, CASE WHEN s.is_open THEN s.d * (b.close - s.d * (b.spread + {slip_sql("b.atr", "s.atr0")}) * b.pip - s.entry) * s.risk / s.entry ELSE 0 END AS unrealized, CAST(s.is_open AS BIGINT) AS n_positions FROM st s JOIN b USING (series, i))"""


LOOP = loop_sql()
TRADES = f"WITH RECURSIVE {LOOP} SELECT " + ", ".join(c if c in ("pair", "id", "direction", "entry_time", "bars_open", "exit_time", "exit_reason") else f"{s6(c)} AS {c}" for c in TRADE) + " FROM tr"
EQUITY = f"WITH RECURSIVE {LOOP} SELECT pair, ts, {s6('capital')} AS capital, {s6('unrealized')} AS unrealized, {s6('capital + unrealized')} AS equity, n_positions FROM eq"
TRADE_METRICS = f"""WITH RECURSIVE {LOOP}, tp AS (SELECT *, return_pct / 100 AS r FROM tr),
mp AS (SELECT pair, count(*) AS n_trades, count(*) FILTER (net_pnl > 0) AS n_wins, count(*) FILTER (net_pnl < 0) AS n_losses, avg(CAST(net_pnl > 0 AS INTEGER)) * 100 AS win_rate, coalesce(sum(CASE WHEN net_pnl > 0 THEN net_pnl END), 0) AS won, abs(coalesce(sum(CASE WHEN net_pnl < 0 THEN net_pnl END), 0)) AS lost, sum(net_pnl) / 100000 * 100 AS total_return,
CASE WHEN stddev_pop(r) > 1e-10 THEN avg(r) / stddev_pop(r) * sqrt(24192) ELSE 0 END AS sharpe, coalesce(CASE WHEN sqrt(avg(CASE WHEN r < 0 THEN r * r END)) > 1e-10 THEN avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r END)) * sqrt(24192) END, 0) AS sortino, avg(CASE WHEN net_pnl > 0 THEN net_pnl END) AS avg_win, avg(CASE WHEN net_pnl < 0 THEN net_pnl END) AS avg_loss, sum(cost_spread) + sum(cost_slippage) + abs(sum(cost_swap)) AS total_costs FROM tp GROUP BY 1),
dp AS (SELECT *, (capital + unrealized) / max(capital + unrealized) OVER (PARTITION BY pair ORDER BY ts) - 1 AS dd FROM eq),
e AS (SELECT pair, abs(min(dd)) * 100 AS max_drawdown, abs(coalesce(avg(CASE WHEN dd < 0 THEN dd END), 0)) * 100 AS avg_drawdown, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / 365.25 AS years FROM dp GROUP BY 1),
f AS (SELECT *, coalesce(total_return / nullif(years, 0), 0) AS annual_return FROM mp JOIN e USING (pair))
SELECT pair, n_trades, n_wins, n_losses, {s6("win_rate")} AS win_rate, {s6("CASE WHEN lost > 1e-10 THEN won / lost WHEN won > 1e-10 THEN 999.99 ELSE 1 END")} AS profit_factor, {", ".join(f"{s6(c)} AS {c}" for c in ("total_return", "sharpe", "sortino", "avg_win", "avg_loss", "total_costs", "max_drawdown", "avg_drawdown", "annual_return"))}, {s6("CASE WHEN max_drawdown > 0.01 THEN annual_return / max_drawdown WHEN annual_return > 0 THEN 999.99 ELSE 0 END")} AS calmar FROM f"""


def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result(spark, sf_dir)
    return six(metrics.trade_metrics(backtest.trades(rows), backtest.equity(rows), 100_000.0))


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(robustness.trade_consistency(backtest.trades(result(spark, sf_dir)), 3))


CONSISTENCY = f"WITH RECURSIVE {LOOP} SELECT pair, count(*) AS n_trades, {s6('avg(return_pct)')} AS mean_return, {s6('avg(CAST(net_pnl > 0 AS INTEGER))')} AS win_rate, CAST(avg(return_pct) > 0 AS INTEGER) AS is_profitable FROM tr GROUP BY 1 HAVING count(*) >= 3"

WIDER = backtest.Config(bars_per_day=6, stop=3.0, take=4.0)


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(backtest.sweep(bars(spark, sf_dir), costs.spread_table(spark), {"usual": CONFIG, "wider": WIDER}))


def sweep_sql() -> str:
    one = lambda name, c: f"SELECT '{name}' AS config, * FROM (WITH RECURSIVE {loop_sql(c)} SELECT pair, id, exit_time, return_pct FROM tr)"
    side = lambda x: f"avg(CASE WHEN {x} THEN return_pct END) / nullif(stddev_pop(CASE WHEN {x} THEN return_pct END), 0)"
    return f"""WITH p AS ({one("usual", CONFIG)} UNION ALL {one("wider", WIDER)}), c AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY exit_time, pair, id) <= 0.6 * count(*) OVER (PARTITION BY config) AS early FROM p), s AS (SELECT config, {side("early")} AS a, {side("NOT early")} AS b FROM c GROUP BY 1)
SELECT config, {s6("a")} AS sharpe_early, {s6("b")} AS sharpe_late, CAST(abs((a - b) / nullif(a, 0)) < 0.3 AS INTEGER) AS is_robust FROM s"""


# ---- resampling


def mix_sql(x: str, to: str) -> str:
    """Select items that spread the 31 bits of x, one after another, to a column."""
    return f"xor({x}, {x} >> 16) AS {to}1, ({to}1 * 73244475) & 2147483647 AS {to}2, xor({to}2, {to}2 >> 16) AS {to}3, ({to}3 * 73244475) & 2147483647 AS {to}4, xor({to}4, {to}4 >> 16) AS {to}"


def draws_sql(replicates: int, seed: int = 42) -> str:
    """CTEs over v (series, i from 0, n and values): d has a hash h for each series, replicate b and place j."""
    return f"""q AS (SELECT range AS b, (range * 2654435 + {seed}) & 2147483647 AS x0, {mix_sql("x0", "own")} FROM range({replicates})), d AS (SELECT v.series, v.i AS j, v.n, q.b, (q.own + v.i * 40503) & 2147483647 AS y0, {mix_sql("y0", "h")} FROM v, q)"""


REPLICATE_METRICS = {
    "sharpe": "CASE WHEN stddev_samp(r) > 1e-10 THEN avg(r) * sqrt(252) / stddev_samp(r) ELSE 0 END",
    "profit_factor": "CASE WHEN abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)) > 1e-10 THEN sum(CASE WHEN r > 0 THEN r ELSE 0 END) / abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)) WHEN sum(CASE WHEN r > 0 THEN r ELSE 0 END) > 1e-10 THEN 999.99 ELSE 0 END",
    "win_rate": "avg(CAST(r > 0 AS INTEGER))",
    "max_drawdown": "min(exp(c) / exp(m) - 1) * 100",
    "total_return": "(exp(sum(ln(1 + r))) - 1) * 100",
    "annual_return": "avg(r) * 252 * 100",
}
REPLICATES = f"k AS (SELECT series, b, j, r, sum(ln(1 + r)) OVER (PARTITION BY series, b ORDER BY j) AS c FROM x), l AS (SELECT *, max(c) OVER (PARTITION BY series, b ORDER BY j) AS m FROM k), z AS (SELECT series, b, {', '.join(f'{v} AS {k}' for k, v in REPLICATE_METRICS.items())} FROM l GROUP BY 1, 2), u AS (UNPIVOT z ON {', '.join(REPLICATE_METRICS)} INTO NAME metric VALUE v)"


def mean_sql(v: str) -> str:
    """Win rates are whole numbers of n, and are added as such."""
    return f"CASE WHEN metric = 'win_rate' THEN CAST(sum(CAST(round({v} * n) AS BIGINT)) AS DOUBLE) / (max(n) * count(*)) ELSE avg({v}) END"


def bootstrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(resampling.bootstrap(returns(spark, sf_dir).withColumn("r", F.col("r") / 10), "r", ["ts"], keys=["series"]))


BOOTSTRAP = f"""WITH {RETURNS}, v AS (SELECT series, row_number() {ROW} - 1 AS i, count(*) OVER (PARTITION BY series) AS n, r / 10 AS r FROM r), {draws_sql(10_000)}, x AS (SELECT d.series, d.b, d.j, v.r FROM d JOIN v ON v.series = d.series AND v.i = d.h % d.n), {REPLICATES},
w AS (SELECT u.*, k.n FROM u JOIN (SELECT series, max(n) AS n FROM v GROUP BY 1) k USING (series)), a AS (SELECT series, metric, {mean_sql("v")} AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM w GROUP BY 1, 2)
SELECT series, metric, {s6("mean")} AS mean, {s6("sd")} AS sd, {s6("low")} AS low, {s6("high")} AS high, CAST(low > 0 OR high < 0 AS INTEGER) AS significant FROM a"""


def permutation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir).where(F.col("z").isNotNull() & F.col("target").isNotNull()).withColumn("target", F.col("target") / 100)
    return six(resampling.permutation(df, "z", "target", ["ts"], keys=["series"]))


PERMUTATION = f"""WITH {BARS}, y AS (SELECT series, ts, {z_sql("close", N)} AS z, (lead(close, 1) {ROW} / close - 1) / 100 AS y FROM bars), k0 AS (SELECT * FROM y WHERE z IS NOT NULL AND y IS NOT NULL), v AS (SELECT series, row_number() {ROW} - 1 AS i, count(*) OVER (PARTITION BY series) AS n, z, y FROM k0), {draws_sql(10_000)},
o AS (SELECT series, b, j, row_number() OVER (PARTITION BY series, b ORDER BY h, j) - 1 AS place FROM d), x AS (SELECT o.series, o.b, o.place AS j, sign(p.z) * a.y AS r FROM o JOIN v p ON p.series = o.series AND p.i = o.j JOIN v a ON a.series = o.series AND a.i = o.place UNION ALL SELECT series, -1, i, sign(z) * y FROM v), {REPLICATES},
w AS (SELECT u.series, metric, v, max(CASE WHEN b < 0 THEN v END) OVER (PARTITION BY u.series, metric) AS real, b, n FROM u JOIN (SELECT series, max(n) AS n FROM v GROUP BY 1) k USING (series)), g AS (SELECT series, metric, real, {mean_sql("v")} AS mean, stddev_samp(v) AS sd, avg(CAST(round(v, 9) >= round(real, 9) AS INTEGER)) AS above, avg(CAST(round(v, 9) <= round(real, 9) AS INTEGER)) AS below FROM w WHERE b >= 0 GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN real >= mean THEN above ELSE below END AS p FROM g)
SELECT series, metric, {s6("real")} AS real, {s6("mean")} AS mean, {s6("sd")} AS sd, {s6("(real - mean) / nullif(sd, 0)")} AS z, {s6("p")} AS p_value, CAST(p < 0.05 AS INTEGER) AS significant FROM p"""


# ---- models

TRAIN = f"""{BARS}, {WIDE.format("bars")}, c AS (SELECT series, ts, f_mean_ratio AS mean_ratio, f_z AS z, f_pos AS pos, f_ret AS ret, target FROM w WHERE f_mean_ratio IS NOT NULL AND f_z IS NOT NULL AND f_pos IS NOT NULL AND f_ret IS NOT NULL AND target IS NOT NULL),
sp AS (SELECT *, row_number() {ROW} <= floor(count(*) OVER (PARTITION BY series) * 0.8) AS is_train FROM c), tn AS (SELECT * FROM sp WHERE is_train)"""


def solved_sql(alpha: float) -> str:
    """Coefficients of the scaled features: normal equations, eliminated pivot by pivot."""
    k = len(NAMES)
    first = ", ".join([f"covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) * (count(*) - 1) + {alpha if a == b else 0} AS a{i}{j}" for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)] + [f"covar_samp({a}, target) / stddev_samp({a}) * (count(*) - 1) AS b{i}" for i, a in enumerate(NAMES)])
    steps, last = [f"e0 AS (SELECT {first} FROM tn)"], "e0"
    for p in range(k):
        rows = []
        for i in range(k):
            for j in [*range(k), None]:
                own, top = (f"a{i}{j}", f"a{p}{j}") if j is not None else (f"b{i}", f"b{p}")
                rows.append(f"{top} / a{p}{p} AS {own}" if i == p else f"{own} - a{i}{p} / a{p}{p} * {top} AS {own}")
        steps.append(f"e{p + 1} AS (SELECT {', '.join(rows)} FROM {last})")
        last = f"e{p + 1}"
    out = " UNION ALL ".join(f"SELECT '{f}' AS feature, b{i} AS coef FROM {last}" for i, f in enumerate(NAMES))
    return f"WITH {TRAIN}, {', '.join(steps)}, o AS ({out}) SELECT feature, {s6('coef')} AS coef, {s6('abs(coef)')} AS abs_coef, CAST(abs(coef) > 1e-10 AS INTEGER) AS non_zero FROM o"


def linear_rows(kind: str, alpha: float = 1.0):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = model_table(spark, sf_dir)
        return six(learning.coefficients(spark, learning.linear(train, test, kind, alpha)[0], NAMES))

    return query


def eigen_sql(sweeps: int = 8) -> str:
    """Shares of the correlation matrix's eigenvalues, by Jacobi rotations."""
    k = len(NAMES)
    name = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    steps, last, n = [f"j0 AS (SELECT {', '.join(f'covar_samp({NAMES[i]}, {NAMES[j]}) / (stddev_samp({NAMES[i]}) * stddev_samp({NAMES[j]})) AS {name(i, j)}' for i in range(k) for j in range(i, k))} FROM tn)"], "j0", 0
    for _ in range(sweeps):
        for p in range(k):
            for q in range(p + 1, k):
                n += 1
                pq = name(p, q)
                steps.append(f"k{n} AS (SELECT *, CASE WHEN abs({pq}) < 1e-300 THEN 0 ELSE atan2(2 * {pq}, {name(q, q)} - {name(p, p)}) / 2 END AS th FROM {last})")
                items = [f"cos(th) * cos(th) * {name(p, p)} - 2 * sin(th) * cos(th) * {pq} + sin(th) * sin(th) * {name(q, q)} AS {name(p, p)}", f"sin(th) * sin(th) * {name(p, p)} + 2 * sin(th) * cos(th) * {pq} + cos(th) * cos(th) * {name(q, q)} AS {name(q, q)}", f"CAST(0 AS DOUBLE) AS {pq}"]
                for r in range(k):
                    if r not in (p, q):
                        items += [f"cos(th) * {name(r, p)} - sin(th) * {name(r, q)} AS {name(r, p)}", f"sin(th) * {name(r, p)} + cos(th) * {name(r, q)} AS {name(r, q)}"]
                rest = [name(i, j) for i in range(k) for j in range(i, k) if p not in (i, j) and q not in (i, j)]
                last = f"j{n}"
                steps.append(f"{last} AS (SELECT {', '.join([*items, *rest])} FROM k{n})")
    values = " UNION ALL ".join(f"SELECT {name(i, i)} AS v FROM {last}" for i in range(k))
    return f"WITH {TRAIN}, {', '.join(steps)}, v AS ({values}), o AS (SELECT row_number() OVER (ORDER BY v DESC) AS component, v / sum(v) OVER () AS explained FROM v), pc AS (SELECT *, sum(explained) OVER (ORDER BY component) AS cumulative FROM o)"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.principal_components(model_table(spark, sf_dir)[0], 4)[1]


PCA = f"{eigen_sql()} SELECT component, {s6('explained')} AS explained, {s6('cumulative')} AS cumulative FROM pc"
PCA_N = f"{eigen_sql()} SELECT s.share, min(CASE WHEN cumulative >= s.share - 1e-12 THEN component END) AS n FROM pc, (VALUES (0.8::DOUBLE), (0.9), (0.95)) s(share) GROUP BY 1"


def lasso_sql(alpha: float, rounds: int = 400) -> str:
    """Coordinate descent over the correlations, one feature after another."""
    k = len(NAMES)
    gram = ", ".join([f"covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) * (count(*) - 1) / count(*) AS a{i}{j}" for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)] + [f"covar_samp({a}, target) / stddev_samp({a}) * (count(*) - 1) / count(*) AS b{i}" for i, a in enumerate(NAMES)])
    inner = "SELECT n, " + ", ".join(f"w{i}" for i in range(k)) + " FROM cd"
    for i in range(k):
        rest = " - ".join([f"b{i}", *(f"a{i}{j} * w{j}" for j in range(k) if j != i)])
        inner = f"SELECT n, {', '.join(f'w{j}' for j in range(k) if j != i)}, sign({rest}) * greatest(abs({rest}) - {alpha}, 0) / a{i}{i} AS w{i} FROM ({inner}), gm"
    out = " UNION ALL ".join(f"SELECT '{f}' AS feature, w{i} AS coef FROM fin" for i, f in enumerate(NAMES))
    return f"WITH RECURSIVE {TRAIN}, gm AS (SELECT {gram} FROM tn), cd AS (SELECT 0 AS n, {', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in range(k))} UNION ALL SELECT n + 1, {', '.join(f'w{i}' for i in range(k))} FROM ({inner}) WHERE n < {rounds}), fin AS (SELECT * FROM cd WHERE n = {rounds}), o AS ({out}) SELECT feature, round(coef, 5) + 0 AS coef, CAST(abs(coef) > 1e-10 AS INTEGER) AS non_zero FROM o"


def lasso_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = model_table(spark, sf_dir)
    out = learning.coefficients(spark, learning.linear(train, test, "lasso", 0.01)[0], NAMES)
    return out.select("feature", F.round("coef", 5).alias("coef"), F.col("non_zero").cast("int").alias("non_zero"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learning.feature_clusters(wide(spark, sf_dir), sorted(NAMES), 2)
    return out.select("feature", F.col("cluster").cast("bigint").alias("cluster"), F.col("is_representative").cast("int").alias("is_representative"))


def clusters_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
    rows = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, 1 - abs(covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b}))) AS d FROM cc" for a, b in pairs)
    steps, last = [], "l0"
    for n in (1, 2):  # from four groups to two
        steps.append(f"m{n} AS (SELECT least(x.g, y.g) AS u, greatest(x.g, y.g) AS v FROM dd JOIN {last} x ON dd.a = x.feature JOIN {last} y ON dd.b = y.feature WHERE x.g <> y.g GROUP BY 1, 2 ORDER BY avg(d), 1, 2 LIMIT 1), l{n} AS (SELECT feature, CASE WHEN g = v THEN u ELSE g END AS g FROM {last}, m{n})")
        last = f"l{n}"
    variance = " UNION ALL ".join(f"SELECT '{f}' AS feature, var_pop({f}) AS s FROM cc" for f in NAMES)
    return f"""WITH {BARS}, {WIDE.format("bars")}, cc AS (SELECT f_mean_ratio AS mean_ratio, f_z AS z, f_pos AS pos, f_ret AS ret FROM w WHERE f_mean_ratio IS NOT NULL AND f_z IS NOT NULL AND f_pos IS NOT NULL AND f_ret IS NOT NULL), dd AS ({rows}), l0 AS (SELECT feature, row_number() OVER (ORDER BY feature) AS g FROM (VALUES {", ".join(f"('{f}')" for f in NAMES)}) t(feature)), {", ".join(steps)}, va AS ({variance})
SELECT feature, dense_rank() OVER (ORDER BY g) AS cluster, CAST(row_number() OVER (PARTITION BY g ORDER BY s DESC, feature DESC) = 1 AS INTEGER) AS is_representative FROM {last} JOIN va USING (feature)"""


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much an OLS model loses by each feature."""
    train, test = model_table(spark, sf_dir)
    model, _ = learning.linear(train, test, "ols")
    return learning.permutation_importance(model, train, NAMES, 10).select("feature", "importance")


# ---- feature levels

OPS = {
    "delta": lambda x, n: f"{x} - lag({x}, {n}) {ROW}",
    "ret": lambda x, n: f"{x} / nullif(lag({x}, {n}) {ROW}, 0) - 1",
    "logret": lambda x, n: f"ln({x} / nullif(lag({x}, {n}) {ROW}, 0))",
    "mean": lambda x, n: full(n, f"avg({x}) {over(n)}", x),
    "sd": lambda x, n: full(n, f"stddev_samp({x}) {over(n)}", x),
    "max": lambda x, n: full(n, f"max({x}) {over(n)}", x),
    "min": lambda x, n: full(n, f"min({x}) {over(n)}", x),
    "z": lambda x, n: z_sql(x, n),
    "pos": lambda x, n: pos_sql(x, n),
}


def level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level of close and volume over all windows, as a long table."""
    plan = features.FeaturePlan(variables=("close", "volume"), levels=(1,), operators=tuple(OPS))
    names = [f"{op}_{n}__{x}" for x in plan.variables for op in OPS for n in plan.windows]
    return stats.long(features.add_features(bars(spark, sf_dir), plan), names, ["series", "ts"]).select("series", "ts", "feature", F.round("value", 7).alias("value"))


LEVEL1_NAMES = {f"{op}_{n}__{x}": sql(x, n) for x in ("close", "volume") for op, sql in OPS.items() for n in features.WINDOWS}
LEVEL1 = f"WITH {BARS}, w AS (SELECT series, ts, {', '.join(f'{v} AS {k}' for k, v in LEVEL1_NAMES.items())} FROM bars) SELECT series, ts, feature, round(value, 7) + 0 AS value FROM (FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(LEVEL1_NAMES)})))"


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir)
    made = df.withColumns({f"rank_{n}": R.rank(F.col("close"), n, W()) for n in features.WINDOWS})
    return stats.long(made, [f"rank_{n}" for n in features.WINDOWS], ["series", "ts"]).select("series", "ts", "feature", r9("value").alias("value"))


RANKS = f"""WITH {BARS}, l AS (SELECT series, ts, close, {", ".join(f"list(close) {over(n)} AS v{n}" for n in features.WINDOWS)} FROM bars), w AS (SELECT series, ts, {", ".join(f"CASE WHEN len(v{n}) = {n} THEN (len(list_filter(v{n}, lambda x: x < close)) + (len(list_filter(v{n}, lambda x: x = close)) + 1) / 2.0) / {n} END AS rank_{n}" for n in features.WINDOWS)} FROM l)
SELECT series, ts, feature, {s9("value")} AS value FROM (FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(f"rank_{n}" for n in features.WINDOWS)})))"""

COMBOS = {"c_o_ratio": "close / open", "h_l_ratio": "high / low", "c_h_ratio": "close / high", "c_l_ratio": "close / low", "h_l_diff": "high - low", "c_o_diff": "close - open", "h_c_diff": "high - close", "c_l_diff": "close - low", "hl2": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "ohlc4": "(open + high + low + close) / 4"} | {k: f"CASE WHEN high - low <> 0 THEN ({x}) / (high - low) ELSE 0 END" for k, x in (("cl_hl_ratio", "close - low"), ("hc_hl_ratio", "high - close"), ("co_hl_ratio", "close - open"))}


def level2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{op}_{n}__{x}" for x in COMBOS for op in features.KEY_OPERATORS for n in features.KEY_WINDOWS]
    return stats.long(features.add_features(bars(spark, sf_dir), features.FeaturePlan(levels=(2,))), names, ["series", "ts"]).select("series", "ts", "feature", F.round("value", 8).alias("value"))


LEVEL2_NAMES = {f"{op}_{n}__{x}": OPS[op](x, n) for x in COMBOS for op in features.KEY_OPERATORS for n in features.KEY_WINDOWS}
LEVEL2 = f"WITH {BARS}, k AS (SELECT series, ts, {', '.join(f'{v} AS {c}' for c, v in COMBOS.items())} FROM bars), w AS (SELECT series, ts, {', '.join(f'{v} AS {c}' for c, v in LEVEL2_NAMES.items())} FROM k) SELECT series, ts, feature, round(value, 8) + 0 AS value FROM (FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(LEVEL2_NAMES)})))"


def ema_cte(windows: list[int]) -> str:
    return f"b AS (SELECT series, ts, close, row_number() {ROW} AS i FROM bars), e AS (SELECT series, ts, i, {', '.join(f'close AS e{n}' for n in windows)} FROM b WHERE i = 1 UNION ALL SELECT b.series, b.ts, b.i, {', '.join(f'({2 / (n + 1)!r}::DOUBLE) * b.close + (1 - {2 / (n + 1)!r}::DOUBLE) * e.e{n}' for n in windows)} FROM e JOIN b ON b.series = e.series AND b.i = e.i + 1)"


def level4(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = features.FeaturePlan(levels=(4,))
    return stats.long(features.add_features(bars(spark, sf_dir), plan), plan.level4(), ["series", "ts"]).select("series", "ts", "feature", F.round("value", 7).alias("value"))


_ALL = sorted({n for p in features.FAST_SLOW for n in p})
LEVEL4_NAMES = {}
for _m, _n in features.FAST_SLOW:
    LEVEL4_NAMES |= {f"mean_{_m}_mean_{_n}_ratio": f"m{_m} / m{_n}", f"mean_{_m}_mean_{_n}_diff": f"m{_m} - m{_n}", f"sd_{_m}_sd_{_n}_ratio": f"s{_m} / (s{_n} + 1e-10)", f"ema_{_m}_ema_{_n}_ratio": f"e{_m} / e{_n}"}
LEVEL4 = f"""WITH RECURSIVE {BARS}, {ema_cte(_ALL)}, k AS (SELECT series, ts, {", ".join(f"{OPS['mean']('close', n)} AS m{n}, {OPS['sd']('close', n)} AS s{n}" for n in _ALL)} FROM bars), w AS (SELECT series, ts, {", ".join(f"{v} AS {c}" for c, v in LEVEL4_NAMES.items())} FROM k JOIN e USING (series, ts))
SELECT series, ts, feature, round(value, 7) + 0 AS value FROM (FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(LEVEL4_NAMES)})))"""


def emas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As single-precision numbers: halves of prices lie on the ties of every decimal rounding."""
    from barwright.functions.ema import with_emas

    df = with_emas(bars(spark, sf_dir), {f"ema_{n}": ("close", n) for n in features.WINDOWS})
    return stats.long(df, [f"ema_{n}" for n in features.WINDOWS], ["series", "ts"]).select("series", "ts", "feature", F.col("value").cast("float").cast("double").alias("value"))


EMAS = f"WITH RECURSIVE {BARS}, {ema_cte(list(features.WINDOWS))} SELECT series, ts, feature, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM (SELECT series, ts, {', '.join(f'e{n} AS ema_{n}' for n in features.WINDOWS)} FROM e) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(f'ema_{n}' for n in features.WINDOWS)}))"


def level3(spark: SparkSession, sf_dir: str, block_rows: int | None = None) -> DataFrame:
    plan = features.FeaturePlan(levels=(3,))
    return stats.long(features.add_features(bars(spark, sf_dir), plan, block_rows), plan.level3(), ["series", "ts"]).select("series", "ts", "feature", F.round("value", 7).alias("value"))


def level3_sql() -> str:
    inner, outer = {}, {}
    one = lambda op, x, n: f"{x} - lag({x}, 1) {ROW}" if op == "d1" else f"{x} - 2 * lag({x}, 1) {ROW} + lag({x}, 2) {ROW}" if op == "d2" else OPS[op](x, n)
    for a, n, b, m in features.COMPOSITIONS:
        inner[f"{b}_{m}"] = f"e{m}" if b == "ema" else OPS[b]("close", m)
        outer[features.feature_name(a, n, f"{b}_{m}__close")] = one(a, f"{b}_{m}", n)
    return f"WITH RECURSIVE {BARS}, {ema_cte([20])}, be AS (SELECT bars.*, e20 FROM bars JOIN e USING (series, ts)), k AS (SELECT series, ts, {', '.join(f'{v} AS {c}' for c, v in inner.items())} FROM be), w AS (SELECT series, ts, {', '.join(f'{v} AS {c}' for c, v in outer.items())} FROM k) SELECT series, ts, feature, round(value, 7) + 0 AS value FROM (FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(outer)})))"


def every_feature(spark: SparkSession, sf_dir: str, block_rows: int = features.BLOCK_ROWS) -> DataFrame:
    """All five levels with all windows of all variables, as rows; averages that halves make lie on the ties of a rounding, and are single-precision numbers."""
    out = features.feature_rows(bars(spark, sf_dir), block_rows=block_rows)
    single = F.col("feature").rlike("^ema_[0-9]+__") | F.col("feature").rlike("(sin|cos)$")
    candles = F.col("feature").rlike(f"(^|__)({'|'.join(COMBOS)})$")  # means of fours and twenties need a digit more
    return out.select("series", "ts", "feature", F.when(single, F.col("value").cast("float").cast("double")).when(candles, F.round("value", 8)).otherwise(F.round("value", 7)).alias("value"))


def every_sql() -> str:
    rank = lambda x, n: f"CASE WHEN len(list({x}) {over(n)}) = {n} THEN (len(list_filter(list({x}) {over(n)}, lambda v: v < {x})) + (len(list_filter(list({x}) {over(n)}, lambda v: v = {x})) + 1) / 2.0) / {n} END"
    five = ("open", "high", "low", "close", "volume")
    one = {f"{op}_{n}__{x}": sql(x, n) for x in five for op, sql in (OPS | {"rank": rank}).items() for n in features.WINDOWS}
    one |= {f"d1__{x}": f"{x} - lag({x}, 1) {ROW}" for x in five} | {f"d2__{x}": f"{x} - 2 * lag({x}, 1) {ROW} + lag({x}, 2) {ROW}" for x in five}
    angles = {f"{k}_{f}": f"{f}({v} * (2 * pi()) / {p})" for k, v, p in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 5), ("month", "month(ts)", 12)) for f in ("sin", "cos")}
    flags = {"is_monday": "isodow(ts) = 1", "is_friday": "isodow(ts) = 5", "is_month_start": "day(ts) <= 5", "is_month_end": "day(ts) >= 25"}
    averages = ", ".join(f"(2 / ({n} + 1.0::DOUBLE)) * b.{x} + (1 - 2 / ({n} + 1.0::DOUBLE)) * e.ema_{n}__{x} AS ema_{n}__{x}" for x in five for n in features.WINDOWS)
    starts = ", ".join(f"{x} AS ema_{n}__{x}" for x in five for n in features.WINDOWS)
    rows = lambda names, source, value="round(value, 7) + 0": f"SELECT series, ts, feature, {value} AS value FROM (FROM {source} UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(names)})))"
    emas = [f"ema_{n}__{x}" for x in five for n in features.WINDOWS]
    parts = [
        rows(one, f"(SELECT series, ts, {', '.join(f'{v} AS {k}' for k, v in one.items())} FROM bars)"),
        rows(emas, f"(WITH RECURSIVE b AS (SELECT *, row_number() {ROW} AS i FROM bars), e AS (SELECT series, ts, i, {starts} FROM b WHERE i = 1 UNION ALL SELECT b.series, b.ts, b.i, {averages} FROM e JOIN b ON b.series = e.series AND b.i = e.i + 1) SELECT series, ts, {', '.join(emas)} FROM e)", "CAST(CAST(value AS FLOAT) AS DOUBLE)"),
        rows([*COMBOS, *LEVEL2_NAMES], f"(SELECT series, ts, {', '.join([*COMBOS, *(f'{v} AS {c}' for c, v in LEVEL2_NAMES.items())])} FROM (SELECT series, ts, {', '.join(f'{v} AS {c}' for c, v in COMBOS.items())} FROM bars))", "round(value, 8) + 0"),
        level3_sql(),
        LEVEL4,
        rows(angles, f"(SELECT series, ts, {', '.join(f'{v} AS {k}' for k, v in angles.items())} FROM bars)", "CAST(CAST(value AS FLOAT) AS DOUBLE)"),
        rows(flags, f"(SELECT series, ts, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in flags.items())} FROM bars)"),
    ]
    return f"WITH {BARS} " + " UNION ALL ".join(f"SELECT series, ts, feature, value FROM ({p})" for p in parts)


QUERIES: dict[str, Query] = {
    "all_features": (every_feature, every_sql()),
    "all_features_blocked": (lambda s, d: every_feature(s, d, 220), every_sql()),
    "backtest_trades": (lambda s, d: six(backtest.trades(result(s, d)).select(*TRADE)), TRADES),
    "backtest_trades_blocked": (lambda s, d: six(backtest.trades(result(s, d, block_rows=60)).select(*TRADE)), TRADES),
    "backtest_equity_blocked": (lambda s, d: six(backtest.equity(result(s, d, block_rows=60))), EQUITY),
    "backtest_equity": (lambda s, d: six(backtest.equity(result(s, d))), EQUITY),
    "backtest_metrics": (trade_metrics, TRADE_METRICS),
    "trade_consistency": (consistency, CONSISTENCY),
    "backtest_sweep": (swept, sweep_sql()),
    "bootstrap_ci": (bootstrap_rows, BOOTSTRAP),
    "permutation_p": (permutation_rows, PERMUTATION),
    "ols": (linear_rows("ols"), solved_sql(0.0)),
    "ridge": (linear_rows("ridge"), solved_sql(1.0)),
    "lasso": (lasso_rows, lasso_sql(0.01)),
    "pca": (lambda s, d: six(components(s, d)), PCA),
    "pca_components": (lambda s, d: six(learning.components_for(components(s, d))), PCA_N),
    "feature_clusters": (clusters, clusters_sql()),
    "permutation_importance": (importance, None),
    "level1_all": (level1, LEVEL1),
    "level1_ranks": (ranks, RANKS),
    "level1_emas": (emas, EMAS),
    "level2_all": (level2, LEVEL2),
    "level3_all": (level3, level3_sql()),
    "level3_blocked": (lambda s, d: level3(s, d, 128), level3_sql()),
    "level4_all": (level4, LEVEL4),
}
