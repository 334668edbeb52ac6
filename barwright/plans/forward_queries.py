"""Queries of co-moments, neighbour mutual information, walk-forward validation and cross-validated lasso, with their SQL: small systems are eliminated pivot by pivot for all windows at once, coordinate descent is a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.operators import comoments, features, forward, metrics, mutual, robustness, stats
from barwright.plans.analysis_queries import NAMES, WIDE, long_sql, screened
from barwright.plans.bar_queries import BARS, DAILY, N, ROW, Query, W, bars, daily, r9, s9
from barwright.plans.model_queries import OPS

# ---- co-moments of many columns

MANY = [f"{op}_{n}__{x}" for x in ("close", "volume") for op in OPS for n in (2, 3, 4, 5, 10, 20)]


def corr_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of 108 features of the first level, by series."""
    plan = features.FeaturePlan(variables=("close", "volume"), levels=(1,), operators=tuple(OPS), windows=(2, 3, 4, 5, 10, 20))
    out = comoments.correlations(features.add_features(bars(spark, sf_dir), plan), MANY, ["series"])
    return out.select("series", "a", "b", "n", F.round("r", 6).alias("r"))


_MANY_SQL = {f"{op}_{n}__{x}": OPS[op](x, n) for x in ("close", "volume") for op in OPS for n in (2, 3, 4, 5, 10, 20)}
CORR_WIDE = f"""WITH {BARS}, w AS (SELECT series, ts, {", ".join(f"{v} AS {k}" for k, v in _MANY_SQL.items())} FROM bars), c AS (SELECT * FROM w WHERE {" AND ".join(f"{k} IS NOT NULL" for k in MANY)}),
l AS (SELECT series, ts, feature, value, list_position([{", ".join(f"'{k}'" for k in MANY)}], feature) AS p FROM (FROM c UNPIVOT (value FOR feature IN ({", ".join(MANY)}))))
SELECT x.series, x.feature AS a, y.feature AS b, count(*) AS n, round(covar_samp(x.value, y.value) / nullif(stddev_samp(x.value) * stddev_samp(y.value), 0), 6) + 0 AS r FROM l x JOIN l y ON x.series = y.series AND x.ts = y.ts AND x.p < y.p GROUP BY 1, 2, 3"""

# ---- mutual information by neighbours


def psi_sql(n: str) -> str:
    x = f"({n} + 6.0)"
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} * {x}) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6)) + 1 / (240 * pow({x}, 8)) - {' - '.join(f'1 / ({n} + {i}.0)' for i in range(6))})"


def neighbour_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mutual.neighbour_mutual_information(screened(bars(spark, sf_dir), []), ["feature"])
    return out.select("feature", "n", r9("mi").alias("mi"))


NEIGHBOUR_MI = f"""WITH {BARS}, {long_sql("bars", "series, ts")}, g AS (SELECT feature, stddev_pop(value) AS a, stddev_pop(target) AS b, count(*) AS n FROM l GROUP BY 1),
u AS (SELECT feature, n, row_number() OVER (ORDER BY feature, series, ts) AS id, CAST(round(value / CASE WHEN a > 0 THEN a ELSE 1 END * 1e9) AS BIGINT) AS x, CAST(round(target / CASE WHEN b > 0 THEN b ELSE 1 END * 1e9) AS BIGINT) AS y FROM l JOIN g USING (feature)),
e AS (SELECT p.feature, p.n, p.id, p.x, p.y, min(greatest(abs(p.x - q.x), abs(p.y - q.y)), 3) AS near FROM u p JOIN u q ON p.feature = q.feature AND p.id <> q.id GROUP BY ALL),
c AS (SELECT e.feature, e.n, e.id, count(*) FILTER (abs(e.x - q.x) < near[3]) AS nx, count(*) FILTER (abs(e.y - q.y) < near[3]) AS ny FROM e JOIN u q ON e.feature = q.feature AND e.id <> q.id GROUP BY ALL)
SELECT feature, n, {s9(f"greatest({psi_sql('n')} + {psi_sql('3')} - avg({psi_sql('(nx + 1)')} + {psi_sql('(ny + 1)')}), 0)")} AS mi FROM c WHERE n > 3 GROUP BY feature, n"""

# ---- walk-forward

TRAIN_DAYS, TEST_DAYS, STEP_DAYS = 730, 182, 91
ALPHA, LASSO, MOST, THRESHOLD, FALLBACK = 1.0, 0.01, 2, 3, 2


def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = F.col("close"), W()
    return daily(spark, sf_dir).withColumns({"mean_ratio": F.try_divide(R.mean(x, 5, w), R.mean(x, N, w)), "z": R.zscore(x, N, w), "pos": R.position(x, N, w), "ret": R.ret(x, 5, w), "target": features.target(x, 1, "return", w)})


def forward_models(spark: SparkSession, sf_dir: str):
    df = daily_features(spark, sf_dir)
    return df, *forward.walk_forward_models(df, NAMES, "target", TRAIN_DAYS, TEST_DAYS, STEP_DAYS, ["series"], ALPHA, LASSO, MOST, THRESHOLD, FALLBACK)


def walk_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = forward_models(spark, sf_dir)[2]
    return models.select("series", F.col("window").cast("bigint").alias("window"), "feature", F.col("votes").cast("bigint").alias("votes"), F.col("selected").cast("int").alias("selected"), *(F.round(c, 8).alias(c) for c in ("mean", "sd", "coef", "offset")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, windows, models = forward_models(spark, sf_dir)
    return forward.walk_forward_predictions(df, windows, models, NAMES, "target", ["series"])


def walk_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("series", F.col("window").cast("bigint").alias("window"), F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.round(c, 8).alias(c) for c in ("y_true", "y_pred")))


def walk_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether predictions hold in all windows, and whether they get worse."""
    by_window = metrics.prediction_metrics(predictions(spark, sf_dir), "y_pred", "y_true", ["series", "window"])
    out = robustness.forward_verdict(by_window, ["series"]).join(robustness.degradation(by_window, ["series"]).drop("n_windows"), "series")
    return out.select("series", "n_windows", *(F.round(c, 7).alias(c) for c in ("ic_mean", "ic_sd", "share_positive", "slope", "recent")), "verdict", F.col("last_two_negative").cast("int").alias("last_two_negative"), F.col("is_declining").cast("int").alias("is_declining"))


K = range(len(NAMES))
_CELLS = [f"a{i}{j}" for i in K for j in K] + [f"b{i}" for i in K]


def eliminated(start: str, name: str, keep: str) -> str:
    """CTEs name0 .. nameK that solve the systems a, b of every row of `start`; the last one's b{i} are the solutions."""
    steps, last = [], start
    for p in K:
        cells = []
        for i in K:
            for j in [*K, None]:
                own, top = (f"a{i}{j}", f"a{p}{j}") if j is not None else (f"b{i}", f"b{p}")
                cells.append(f"{top} / a{p}{p} AS {own}" if i == p else f"{own} - a{i}{p} / a{p}{p} * {top} AS {own}")
        steps.append(f"{name}{p} AS (SELECT {keep}, {', '.join(cells)} FROM {last})")
        last = f"{name}{p}"
    return ", ".join(steps)


def descent(alpha: str) -> str:
    """The next w0 .. of each row of `one` (with a and b), a feature after the other."""
    inner = "SELECT * FROM one"
    for i in K:
        rest = " - ".join([f"b{i}", *(f"a{i}{j} * w{j}" for j in K if j != i)])
        inner = f"SELECT * REPLACE (sign({rest}) * greatest(abs({rest}) - {alpha}, 0) / a{i}{i} AS w{i}) FROM ({inner})"
    return inner


def walk_ctes(rounds: int = 300) -> str:
    grams = [f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS a{i}{j}" for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)] + [f"covar_pop({a}, target) / stddev_pop({a}) AS b{i}" for i, a in enumerate(NAMES)]
    scale = [f"avg({a}) AS m{i}, stddev_pop({a}) AS s{i}" for i, a in enumerate(NAMES)]
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in K)
    penal = ", ".join(f"a{i}{j} * n + {ALPHA if i == j else 0} AS a{i}{j}" for i in K for j in K) + ", " + ", ".join(f"b{i} * n AS b{i}" for i in K)
    last = f"ra{len(NAMES) - 1}"
    scores = " UNION ALL ".join(f"SELECT series, w, '{m}' AS method, '{f}' AS feature, {x} AS score FROM {t}" for i, f in enumerate(NAMES) for m, t, x in (("IC", "gm", f"abs(b{i} / sy)"), ("Ridge", last, f"abs(b{i})"), ("Lasso", "fin", f"abs(w{i})")))
    flags = ", ".join(f"coalesce(max(CASE WHEN feature = '{f}' THEN k END), 0) AS k{i}, coalesce(max(CASE WHEN feature = '{f}' THEN v END), 0) AS v{i}" for i, f in enumerate(NAMES))
    masked = ", ".join(f"a{i}{j} * n * k{i} * k{j} + {f'CASE WHEN k{i} = 1 THEN {ALPHA} ELSE 1 END' if i == j else '0'} AS a{i}{j}" for i in K for j in K) + ", " + ", ".join(f"b{i} * n * k{i} AS b{i}" for i in K)
    return f"""{DAILY}, {WIDE.format("daily")}, c AS (SELECT series, ts, CAST(ts AS DATE) AS day, {", ".join(f"f_{f} AS {f}" for f in NAMES)}, target FROM w WHERE {" AND ".join(f"f_{f} IS NOT NULL" for f in NAMES)} AND target IS NOT NULL),
dd AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM daily GROUP BY 1), sp AS (SELECT min(day) AS a, max(day) AS b FROM dd), kk AS (SELECT a, unnest(generate_series(0, CAST(greatest(floor((b - a - {TRAIN_DAYS}) / {STEP_DAYS}), 0) AS BIGINT))) AS w FROM sp),
v0 AS (SELECT w, a + CAST(w * {STEP_DAYS} AS INTEGER) AS t0, a + CAST(w * {STEP_DAYS} + {TRAIN_DAYS} AS INTEGER) AS t1, a + CAST(w * {STEP_DAYS} + {TRAIN_DAYS + TEST_DAYS} AS INTEGER) AS t2 FROM kk),
v AS (SELECT w, t0, t1, t2 FROM dd JOIN v0 ON day >= t0 AND day < t2 GROUP BY ALL HAVING coalesce(sum(CASE WHEN day < t1 THEN n END), 0) >= 100 AND coalesce(sum(CASE WHEN day >= t1 THEN n END), 0) >= 20),
gm AS (SELECT series, w, count(*) AS n, avg(target) AS my, stddev_pop(target) AS sy, {", ".join(scale)}, {", ".join(grams)} FROM c JOIN v ON day >= t0 AND day < t1 GROUP BY ALL),
ra AS (SELECT series, w, {penal} FROM gm), {eliminated("ra", "ra", "series, w")},
cd AS (SELECT series, w, 0 AS it, {zero}, {", ".join(_CELLS)} FROM gm UNION ALL SELECT series, w, it + 1, {", ".join(f"w{i}" for i in K)}, {", ".join(_CELLS)} FROM ({descent(str(LASSO)).replace("FROM one", "FROM cd")}) WHERE it < {rounds}), fin AS (SELECT * FROM cd WHERE it = {rounds}),
sc AS ({scores}), rk AS (SELECT *, row_number() OVER (PARTITION BY series, w, method ORDER BY score DESC, feature) AS r FROM sc WHERE score > 0),
vt AS (SELECT series, w, feature, count(*) FILTER (r <= {MOST}) AS v, min(CASE WHEN method = 'IC' THEN r END) AS ic_rank FROM rk GROUP BY ALL), an AS (SELECT *, max(v) OVER (PARTITION BY series, w) >= {THRESHOLD} AS agreed FROM vt),
kf AS (SELECT series, w, feature, v, CAST(CASE WHEN agreed THEN v >= {THRESHOLD} ELSE ic_rank <= {FALLBACK} END AS INTEGER) AS k FROM an), pk AS (SELECT series, w, {flags} FROM kf GROUP BY ALL),
rs AS (SELECT series, w, my, {", ".join(f"m{i}, s{i}, k{i}, v{i}" for i in K)}, {masked} FROM gm JOIN pk USING (series, w)), {eliminated("rs", "rs", f"series, w, my, {', '.join(f'm{i}, s{i}, k{i}, v{i}' for i in K)}")}, md AS (SELECT * FROM rs{len(NAMES) - 1})"""


_WALK = walk_ctes()
WALK_MODELS = f"WITH RECURSIVE {_WALK} " + " UNION ALL ".join(f"""SELECT series, w AS "window", '{f}' AS feature, v{i} AS votes, k{i} AS selected, round(m{i}, 8) + 0 AS mean, round(s{i}, 8) + 0 AS sd, round(b{i}, 8) + 0 AS coef, round(my, 8) + 0 AS "offset" FROM md""" for i, f in enumerate(NAMES))
_PRED = f"{_WALK}, pr AS (SELECT c.series, md.w, c.ts, c.target AS y_true, my + {' + '.join(f'({f} - m{i}) / s{i} * b{i}' for i, f in enumerate(NAMES))} AS y_pred FROM c JOIN v ON day >= t1 AND day < t2 JOIN md ON md.series = c.series AND md.w = v.w)"
WALK_PREDICTIONS = f'WITH RECURSIVE {_PRED} SELECT series, w AS "window", ts, round(y_true, 8) + 0 AS y_true, round(y_pred, 8) + 0 AS y_pred FROM pr'
WALK_VERDICT = f"""WITH RECURSIVE {_PRED}, ic AS (SELECT series, w, covar_samp(y_pred, y_true) / nullif(stddev_samp(y_pred) * stddev_samp(y_true), 0) AS ic, row_number() OVER (PARTITION BY series ORDER BY w DESC) AS back FROM pr GROUP BY 1, 2),
o AS (SELECT series, count(ic) AS n_windows, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd, avg(CAST(ic > 0 AS INTEGER)) AS share_positive, regr_slope(ic, w) AS slope, avg(CASE WHEN back <= 3 THEN ic END) AS recent, coalesce(bool_and(CASE WHEN back <= 2 THEN ic < 0 END), false) AS last_two FROM ic GROUP BY 1)
SELECT series, n_windows, {", ".join(f"round({c}, 7) + 0 AS {c}" for c in ("ic_mean", "ic_sd", "share_positive", "slope", "recent"))}, CASE WHEN share_positive = 1 THEN 'real' WHEN share_positive > 0 THEN 'unstable' ELSE 'overfitted' END AS verdict, CAST(last_two AS INTEGER) AS last_two_negative, CAST(CASE WHEN n_windows >= 3 THEN slope < -0.001 OR recent < 0.01 OR last_two END AS INTEGER) AS is_declining FROM o"""

# ---- cross-validated lasso

PENALTIES, FOLDS = 20, 5


def lasso_cv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forward.lasso_cv(daily_features(spark, sf_dir), NAMES, "target", ["series"], FOLDS, PENALTIES)
    return out.select("series", "feature", *(F.round(c, 8).alias(c) for c in ("alpha", "coef", "abs_coef")), F.col("non_zero").cast("int").alias("non_zero"))


def lasso_cv_sql(rounds: int = 400) -> str:
    z = [f"z{i}" for i in K]
    gram = [f"covar_pop({a}, {b}) AS a{i}{j}" for i, a in enumerate(z) for j, b in enumerate(z)] + [f"covar_pop({a}, target) AS b{i}" for i, a in enumerate(z)]
    means = ", ".join(f"avg({a}) AS u{i}" for i, a in enumerate(z))
    ratio = f"pow(0.001, (it // {rounds}) / {PENALTIES - 1}.0)"
    out = " UNION ALL ".join(f"SELECT series, '{f}' AS feature, alpha, w{i} AS coef FROM best" for i, f in enumerate(NAMES))
    return f"""WITH RECURSIVE {DAILY}, {WIDE.format("daily")}, c AS (SELECT series, ts, {", ".join(f"f_{f} AS {f}" for f in NAMES)}, target FROM w WHERE {" AND ".join(f"f_{f} IS NOT NULL" for f in NAMES)} AND target IS NOT NULL),
nb AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM c),
fo AS (SELECT series, target, {", ".join(f"({f} - avg({f}) OVER (PARTITION BY series)) / stddev_pop({f}) OVER (PARTITION BY series) AS z{i}" for i, f in enumerate(NAMES))}, CASE WHEN i < (n % {FOLDS}) * (n // {FOLDS} + 1) THEN i // (n // {FOLDS} + 1) ELSE n % {FOLDS} + (i - (n % {FOLDS}) * (n // {FOLDS} + 1)) // (n // {FOLDS}) END AS fold FROM nb),
fs AS (SELECT f.range AS held, fo.* FROM fo, range({FOLDS + 1}) f WHERE fo.fold <> f.range),
gm AS (SELECT series, held, avg(target) AS uy, {means}, {", ".join(gram)} FROM fs GROUP BY ALL), top AS (SELECT series, greatest({", ".join(f"abs(b{i})" for i in K)}) AS top FROM gm WHERE held = {FOLDS}),
one AS (SELECT series, held, top, -1 AS it, {", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in K)}, uy, {", ".join(f"u{i}" for i in K)}, {", ".join(_CELLS)} FROM gm JOIN top USING (series)),
cd AS (SELECT * FROM one UNION ALL {descent(f"top * {ratio}").replace("SELECT * FROM one", f"SELECT * REPLACE (it + 1 AS it) FROM cd WHERE it < {rounds * PENALTIES - 1}")}),
fin AS (SELECT *, it // {rounds} AS step FROM cd WHERE it >= 0 AND it % {rounds} = {rounds - 1}),
er AS (SELECT fin.series, step, held, avg(pow(target - uy - ({" + ".join(f"(z{i} - u{i}) * w{i}" for i in K)}), 2)) AS e FROM fin JOIN fo ON fo.series = fin.series AND fo.fold = fin.held GROUP BY ALL),
se AS (SELECT series, step FROM (SELECT series, step, sum(e) AS e FROM er GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY series ORDER BY e, step) = 1),
best AS (SELECT fin.*, top * pow(0.001, step / {PENALTIES - 1}.0) AS alpha FROM fin JOIN se USING (series, step) WHERE held = {FOLDS}), o AS ({out})
SELECT series, feature, round(alpha, 8) + 0 AS alpha, round(coef, 8) + 0 AS coef, round(abs(coef), 8) + 0 AS abs_coef, CAST(coef <> 0 AS INTEGER) AS non_zero FROM o"""


QUERIES: dict[str, Query] = {
    "corr_wide": (corr_wide, CORR_WIDE),
    "neighbour_mi": (neighbour_mi, NEIGHBOUR_MI),
    "walk_forward_models": (walk_models, WALK_MODELS),
    "walk_forward_predictions": (walk_predictions, WALK_PREDICTIONS),
    "walk_forward_verdict": (walk_verdict, WALK_VERDICT),
    "lasso_cv": (lasso_cv_rows, lasso_cv_sql()),
}
