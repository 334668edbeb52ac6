"""Queries of the correlation network of 27 features of bars, with their SQL: numbers of walks give shortest paths, and groups merge one CTE after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import features, learning, networks, stats
from barwright.plans.bar_queries import BARS, Query, bars, r9, s9
from barwright.plans.model_queries import OPS

WINDOWS = (5, 10, 20)
NODES = [f"{op}_{n}__close" for op in OPS for n in WINDOWS]
#: Steps that the SQL looks ahead.
STEPS = 8


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = features.FeaturePlan(variables=("close",), levels=(1,), operators=tuple(OPS), windows=WINDOWS)
    return stats.correlation_pairs(features.add_features(bars(spark, sf_dir), plan), NODES)


def paths_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.betweenness(pairs(spark, sf_dir)).select("node", r9("betweenness").alias("betweenness"))


PAIRS = f"""{BARS}, w AS (SELECT {", ".join(f"{OPS[k.split('_')[0]]('close', int(k.split('_')[1]))} AS {k}" for k in NODES)} FROM bars), c AS (SELECT row_number() OVER () AS id, * FROM w WHERE {" AND ".join(f"{k} IS NOT NULL" for k in NODES)}),
l AS (SELECT id, feature, value, list_position([{", ".join(f"'{k}'" for k in NODES)}], feature) AS p FROM (FROM c UNPIVOT (value FOR feature IN ({", ".join(NODES)})))),
p AS MATERIALIZED (SELECT x.feature AS a, y.feature AS b, covar_samp(x.value, y.value) / nullif(stddev_samp(x.value) * stddev_samp(y.value), 0) AS r FROM l x JOIN l y ON x.id = y.id AND x.p < y.p GROUP BY 1, 2),
n AS MATERIALIZED (SELECT a AS node FROM p UNION SELECT b FROM p), u AS (SELECT a, b FROM p WHERE abs(r) > 0.5), e AS MATERIALIZED (SELECT a, b FROM u UNION ALL SELECT b, a FROM u)"""
_WALKS = ", ".join(f"k{i} AS MATERIALIZED (SELECT s, b AS t, sum(n) AS n, {i} AS d FROM k{i - 1} JOIN e ON t = a GROUP BY 1, 2)" for i in range(1, STEPS + 1))
BETWEENNESS = f"""WITH {PAIRS}, k0 AS (SELECT node AS s, node AS t, 1 AS n, 0 AS d FROM n), {_WALKS}, k AS ({" UNION ALL ".join(f"SELECT s, t, CAST(n AS DOUBLE) AS n, d FROM k{i}" for i in range(STEPS + 1))}), m AS MATERIALIZED (SELECT s, t, min(d) AS d, arg_min(n, d) AS n FROM k GROUP BY 1, 2),
x AS (SELECT a.t AS node, sum(a.n * b.n / c.n) AS v FROM m a JOIN m b ON b.s = a.t JOIN m c ON c.s = a.s AND c.t = b.t WHERE a.t <> a.s AND a.t <> b.t AND a.s <> b.t AND a.d + b.d = c.d GROUP BY 1)
SELECT node, {s9("coalesce(v, 0) / (SELECT (count(*) - 1) * (count(*) - 2) FROM n)")} AS betweenness FROM n LEFT JOIN x USING (node)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.communities(pairs(spark, sf_dir))


def merges() -> str:
    out = ["g0 AS MATERIALIZED (SELECT node, node AS g FROM n)", "dg AS MATERIALIZED (SELECT node, count(b) AS d FROM n LEFT JOIN e ON a = node GROUP BY 1)"]
    for i in range(1, len(NODES)):
        last = f"g{i - 1}"
        out.append(f"m{i} AS MATERIALIZED (SELECT u, v FROM (SELECT x.g AS u, y.g AS v, count(*) AS k FROM e JOIN {last} x ON x.node = a JOIN {last} y ON y.node = b WHERE x.g < y.g GROUP BY 1, 2) JOIN (SELECT g AS u, sum(d) AS du FROM {last} JOIN dg USING (node) GROUP BY 1) USING (u) JOIN (SELECT g AS v, sum(d) AS dv FROM {last} JOIN dg USING (node) GROUP BY 1) USING (v) WHERE (SELECT count(*) FROM e) * k - du * dv >= 0 ORDER BY (SELECT count(*) FROM e) * k - du * dv DESC, u, v LIMIT 1)")
        out.append(f"g{i} AS MATERIALIZED (SELECT node, CASE WHEN g = (SELECT v FROM m{i}) THEN (SELECT u FROM m{i}) ELSE g END AS g FROM {last})")
    return ", ".join(out)


_GROUPS = f"WITH {PAIRS}, {merges()}, fin AS (SELECT node, g AS community FROM g{len(NODES) - 1})"
COMMUNITIES = f"{_GROUPS} SELECT node, community FROM fin"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = networks.network_summary(pairs(spark, sf_dir))
    return out.select("n_nodes", "n_edges", r9("density").alias("density"), "n_communities", r9("modularity").alias("modularity"), "leader")


SUMMARY = f"""{_GROUPS}, s AS (SELECT sum(d) AS t FROM dg), q AS (SELECT sum(pow(d, 2)) AS q, count(*) AS k FROM (SELECT community, sum(d) AS d FROM fin JOIN dg USING (node) GROUP BY 1))
SELECT (SELECT count(*) FROM n) AS n_nodes, CAST(t // 2 AS BIGINT) AS n_edges, {s9("t / (SELECT count(*) * (count(*) - 1) FROM n)")} AS density, k AS n_communities, {s9("(SELECT count(*) FROM e JOIN fin x ON x.node = a JOIN fin y ON y.node = b WHERE x.community = y.community) / t - q / (t * t)")} AS modularity, (SELECT node FROM dg ORDER BY d DESC, node LIMIT 1) AS leader FROM s, q"""


K, ROUNDS = 4, 20


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means of the features."""
    plan = features.FeaturePlan(variables=("close",), levels=(1,), operators=tuple(OPS), windows=WINDOWS)
    out = learning.feature_clusters(features.add_features(bars(spark, sf_dir), plan), sorted(NODES), K, "kmeans")
    return out.select("feature", F.col("cluster").cast("bigint").alias("cluster"), F.col("is_representative").cast("int").alias("is_representative"), F.round("variance", 6).alias("variance"))


def centred_sql() -> str:
    steps = ["s1 AS MATERIALIZED (SELECT 1 AS i, feature FROM (SELECT a AS feature, max(CASE WHEN a = b THEN g END) - 2 * avg(g) AS far FROM gm GROUP BY 1) ORDER BY far DESC, feature LIMIT 1)"]
    for i in range(2, K + 1):
        steps.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL (SELECT {i}, feature FROM (SELECT x.a AS feature, min(d.g + e.g - 2 * x.g) AS far FROM gm x JOIN s{i - 1} s ON x.b = s.feature JOIN gm d ON d.a = x.a AND d.b = x.a JOIN gm e ON e.a = x.b AND e.b = x.b GROUP BY 1) ORDER BY far DESC, feature LIMIT 1))")
    steps.append(f"a0 AS MATERIALIZED (SELECT feature, arg_min(i, apart) AS c FROM (SELECT x.a AS feature, i, e.g - 2 * x.g AS apart FROM gm x JOIN s{K} s ON x.b = s.feature JOIN gm e ON e.a = x.b AND e.b = x.b) GROUP BY 1)")
    for i in range(1, ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT feature, arg_min(c, apart) AS c FROM (SELECT x.a AS feature, y.c, o.o - 2 * avg(x.g) AS apart FROM gm x JOIN a{i - 1} y ON x.b = y.feature JOIN (SELECT p.c, avg(g) AS o FROM gm JOIN a{i - 1} p ON p.feature = a JOIN a{i - 1} q ON q.feature = b WHERE p.c = q.c GROUP BY 1) o ON o.c = y.c GROUP BY x.a, y.c, o.o) GROUP BY 1)")
    return f"""WITH {PAIRS}, gm AS MATERIALIZED (SELECT x.feature AS a, y.feature AS b, sum(x.value * y.value) AS g FROM l x JOIN l y ON x.id = y.id GROUP BY 1, 2), {", ".join(steps)}, v AS (SELECT feature, var_pop(value) AS variance FROM l GROUP BY 1), o AS (SELECT *, min(feature) OVER (PARTITION BY c) AS g FROM a{ROUNDS} JOIN v USING (feature))
SELECT feature, dense_rank() OVER (ORDER BY g) AS cluster, CAST(row_number() OVER (PARTITION BY g ORDER BY variance DESC, feature DESC) = 1 AS INTEGER) AS is_representative, round(variance, 6) + 0 AS variance FROM o"""


QUERIES: dict[str, Query] = {
    "feature_kmeans": (centred, centred_sql()),
    "network_betweenness": (paths_through, BETWEENNESS),
    "network_communities": (groups, COMMUNITIES),
    "network_summary": (summary, SUMMARY),
}
