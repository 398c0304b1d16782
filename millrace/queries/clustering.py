"""K-means queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import kmeans
from millrace.plans.kmeans_fit import kmeans_fit
from millrace.queries import query

#: Points in element form and the eight lowest ids as centers.
_EMB = """
pts AS (SELECT vec_id AS id, CAST(vec_id % 8 AS INTEGER) AS shard,
               CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, f
       FROM pts ORDER BY id LIMIT 8),
d AS (SELECT p.id, p.shard, p.f, c.cluster,
             list_sum(list_transform(list_zip(p.f, c.f),
                      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
      FROM pts p CROSS JOIN c0 c),
a AS (SELECT id, shard, f, arg_min(cluster, (d2, cluster)) AS cluster, min(d2) AS d2
      FROM d GROUP BY id, shard, f)
"""


def _lowest_ids(points: DataFrame, k: int):
    rows = points.orderBy("id").limit(k).select("features").collect()
    return [list(r["features"]) for r in rows]


@query(
    "kmeans_step",
    f"""WITH {_EMB},
e AS (SELECT cluster, unnest(f) AS x, unnest(generate_series(1, len(f))) AS i FROM a),
m AS (SELECT cluster, i, avg(x) AS v FROM e GROUP BY cluster, i),
s AS (SELECT cluster, count(*) AS n, sum(d2) AS inertia FROM a GROUP BY cluster)
SELECT c0.cluster, CAST(coalesce(s.n, 0) AS BIGINT) AS n,
       round(coalesce(s.inertia, 0), 6) AS inertia,
       round(coalesce(max(CASE WHEN m.i = 1 THEN m.v END), any_value(c0.f[1])), 6) AS x0,
       round(coalesce(max(CASE WHEN m.i = 64 THEN m.v END), any_value(c0.f[64])), 6) AS x63,
       round(coalesce(sum(m.v), any_value(list_sum(c0.f))), 6) AS x_sum
FROM c0 LEFT JOIN s USING (cluster) LEFT JOIN m USING (cluster)
GROUP BY c0.cluster, s.n, s.inertia""",
)
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    points = B.embedding_points(spark, sf)
    centers = _lowest_ids(points, 8)
    partials = kmeans.partial_stats(points, centers)
    reduced = kmeans.reduce_partials(partials, kmeans.centroid_frame(spark, centers))
    return reduced.select(
        "cluster",
        F.col("count").alias("n"),
        F.round("inertia", 6).alias("inertia"),
        F.round(F.col("features")[0], 6).alias("x0"),
        F.round(F.col("features")[63], 6).alias("x63"),
        F.round(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 6).alias("x_sum"),
    )


@query(
    "kmeans_movement",
    f"""WITH {_EMB},
e AS (SELECT cluster, unnest(f) AS x, unnest(generate_series(1, len(f))) AS i FROM a),
m AS (SELECT cluster, i, avg(x) AS v FROM e GROUP BY cluster, i)
SELECT round(sqrt(sum((m.v - c0.f[m.i]) * (m.v - c0.f[m.i]))), 6) AS movement FROM m JOIN c0 USING (cluster)""",
)
def kmeans_movement(spark: SparkSession, sf: str) -> DataFrame:
    points = B.embedding_points(spark, sf)
    centers = _lowest_ids(points, 8)
    old = kmeans.centroid_frame(spark, centers)
    new = kmeans.reduce_partials(kmeans.partial_stats(points, centers), old)
    return kmeans.movement(old, new).select(F.round("movement", 6).alias("movement"))


@query(
    "kmeans_assign",
    f"WITH {_EMB} SELECT id, cluster, round(d2, 6) AS d2 FROM a",
)
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    points = B.embedding_points(spark, sf)
    out = kmeans.nearest(points, _lowest_ids(points, 8))
    return out.select("id", "cluster", F.round("d2", 6).alias("d2"))


@query(
    "kmeans_partials",
    f"""WITH {_EMB}
SELECT shard, cluster, count(*) AS n, round(sum(d2), 6) AS inertia,
       round(sum(list_sum(f)), 6) AS sum_of_sums
FROM a GROUP BY shard, cluster""",
)
def kmeans_partials(spark: SparkSession, sf: str) -> DataFrame:
    points = B.embedding_points(spark, sf)
    out = kmeans.partial_stats(points, _lowest_ids(points, 8))
    return out.select(
        "shard",
        "cluster",
        F.col("count").alias("n"),
        F.round("inertia", 6).alias("inertia"),
        F.round(F.aggregate("sums", F.lit(0.0), lambda s, v: s + v), 6).alias("sum_of_sums"),
    )


def _fit_sql(iterations: int) -> str:
    rows = ", ".join(
        f"({i}, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE, {c[3]}::DOUBLE)"
        for i, c in enumerate(B.LINEITEM_CENTERS)
    )
    parts = [
        "p AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_quantity AS a, "
        "l_extendedprice / 1000.0 AS b, l_discount AS c, l_tax AS d FROM lineitem)",
        f"k0(cluster, a, b, c, d) AS (SELECT * FROM (VALUES {rows}))",
    ]
    history = []
    for t in range(iterations):
        parts.append(
            f"g{t} AS MATERIALIZED (SELECT p.rid, any_value(p.a) AS a, any_value(p.b) AS b, "
            f"any_value(p.c) AS c, any_value(p.d) AS d, arg_min(k.cluster, (dd, k.cluster)) AS cluster, "
            f"min(dd) AS d2 FROM (SELECT p.*, k.cluster, (p.a-k.a)*(p.a-k.a) + (p.b-k.b)*(p.b-k.b) + "
            f"(p.c-k.c)*(p.c-k.c) + (p.d-k.d)*(p.d-k.d) AS dd FROM p CROSS JOIN k{t} k) p "
            f"JOIN k{t} k USING (cluster) GROUP BY p.rid)"
        )
        parts.append(
            f"k{t + 1} AS MATERIALIZED (SELECT k.cluster, coalesce(avg(g.a), any_value(k.a)) AS a, "
            f"coalesce(avg(g.b), any_value(k.b)) AS b, coalesce(avg(g.c), any_value(k.c)) AS c, "
            f"coalesce(avg(g.d), any_value(k.d)) AS d FROM k{t} k LEFT JOIN g{t} g USING (cluster) "
            f"GROUP BY k.cluster)"
        )
        history.append(
            f"SELECT {t} AS iteration, (SELECT round(sum(d2), 3) FROM g{t}) AS inertia, "
            f"(SELECT round(sqrt(sum((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b)+(x.c-y.c)*(x.c-y.c)"
            f"+(x.d-y.d)*(x.d-y.d))), 6) FROM k{t} x JOIN k{t + 1} y USING (cluster)) AS movement"
        )
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(history)


@query("kmeans_fit", _fit_sql(5))
def kmeans_fit_query(spark: SparkSession, sf: str) -> DataFrame:
    fit = kmeans_fit(
        B.lineitem_points(spark, sf), k=4, iterations=5, init=B.LINEITEM_CENTERS
    )
    return fit.history_frame(spark).select(
        "iteration",
        F.round("inertia", 3).alias("inertia"),
        F.round("movement", 6).alias("movement"),
    )


@query(
    "node_contributions",
    """SELECT 'node-' || l_suppkey AS node, l_returnflag AS pod, count(*) AS tasks,
    sum(l_partkey)::BIGINT AS samples, sum(l_linenumber)::BIGINT AS busy_ms FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def node_contributions(spark: SparkSession, sf: str) -> DataFrame:
    results = B.table(spark, sf, "lineitem").select(
        F.concat(F.lit("node-"), F.col("l_suppkey")).alias("node"),
        F.col("l_returnflag").alias("pod"),
        F.col("l_partkey").alias("samples"),
        F.col("l_linenumber").alias("busy_ms"),
    )
    return kmeans.node_contributions(results)


@query(
    "run_summary",
    """SELECT (SELECT count(*) FROM orders) AS iterations, (SELECT arg_max(o_totalprice, o_orderkey) FROM orders) AS final_inertia,
    (SELECT arg_max(o_totalprice / 2, o_orderkey) FROM orders) AS final_movement,
    (SELECT count_if(event_type = 'click')::BIGINT FROM events) AS tasks_retried,
    (SELECT count_if(event_type = 'error')::BIGINT FROM events) AS workers_lost,
    (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS nodes_contributing""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    history = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("iteration"),
        F.col("o_totalprice").alias("inertia"),
        (F.col("o_totalprice") / 2).alias("movement"),
    )
    events = B.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "click", "TASK_ATTEMPT_RETRIED")
        .when(F.col("event_type") == "error", "RAY_WORKER_LOST")
        .otherwise("OTHER")
        .alias("type")
    )
    nodes = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"))
    return kmeans.run_summary(history, events, nodes)
