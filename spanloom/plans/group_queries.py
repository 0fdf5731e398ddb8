"""Queries for group analytics and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.ordered import Sequence
from spanloom.operators import clusters as cl
from spanloom.operators import groups as gr
from spanloom.operators import insights as ins
from spanloom.operators import traverse as tv
from spanloom.operators.metrics import with_epoch  # noqa: F401
from spanloom.plans.graph_tables import graph
from spanloom.plans.metric_queries import members
from spanloom.plans.registry import query
from spanloom.plans.session_metric_queries import ORDER
from spanloom.plans.traverse_queries import COS, state_embeddings
from spanloom.session import cut_lineage
from spanloom.sources.fixtures import oracle_define, stored, table


def r6(c):
    return F.round(c, 6)


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def vectors(s, d):
    return table(s, d, "vectors").select("session_key", "vector", "group_id")


# -- clustering -----------------------------------------------------------------------------

RADIUS = 0.6


@query("radius_groups", "2.9.2", sql=f"""
WITH RECURSIVE e AS (SELECT a.session_key AS a, b.session_key AS b FROM vectors a JOIN vectors b ON a.session_key <> b.session_key AND {COS.format(a='a.vector', b='b.vector')} <= {RADIUS}),
 t(id, c) AS (SELECT session_key, session_key FROM vectors UNION SELECT t.id, e.b FROM t JOIN e ON e.a = t.c)
SELECT id, min(c) AS component FROM t GROUP BY 1""")
def _(s, d):
    return cl.radius_groups(vectors(s, d).withColumnRenamed("session_key", "id"), RADIUS)


@query("nested_groups", "2.9.1", sql=f"""
WITH RECURSIVE e AS (SELECT a.session_key AS a, b.session_key AS b, {COS.format(a='a.vector', b='b.vector')} AS dd FROM vectors a JOIN vectors b ON a.session_key <> b.session_key),
 r(depth, radius) AS (VALUES (0, 0.65::DOUBLE), (1, 0.6::DOUBLE), (2, 0.55::DOUBLE)),
 t(depth, id, c) AS (SELECT depth, session_key, session_key FROM vectors, r UNION SELECT t.depth, t.id, e.b FROM t JOIN r ON r.depth = t.depth JOIN e ON e.a = t.c AND e.dd <= r.radius),
 m AS (SELECT depth, id, min(c) AS c FROM t GROUP BY 1, 2), k AS (SELECT depth, id, 'L' || CAST(depth AS VARCHAR) || '_' || c AS group_id, count(*) OVER (PARTITION BY depth, c) AS n FROM m)
SELECT k.group_id, r.radius, k.n AS n_sessions, min(p.group_id) AS parent_id FROM k JOIN r USING (depth) LEFT JOIN k p ON p.id = k.id AND p.depth = k.depth - 1 AND p.n >= 2 WHERE k.n >= 2 GROUP BY 1, 2, 3""")
def _(s, d):
    member, links = cl.nested_groups(vectors(s, d).withColumnRenamed("session_key", "id"), [0.65, 0.6, 0.55])
    sized = member.groupBy("group_id", "radius").agg(F.count(F.lit(1)).alias("n_sessions"))
    up = links.withColumnRenamed("child_id", "group_id")
    return sized.join(up, "group_id", "left")


@query("group_medoids", "2.9.3", sql=f"""
SELECT group_id, session_key AS medoid, n AS n_sessions FROM (SELECT v.group_id, v.session_key, count(*) OVER (PARTITION BY v.group_id) AS n, row_number() OVER (PARTITION BY v.group_id ORDER BY {COS.format(a='v.vector', b='c.c')}, v.session_key) AS rn FROM vectors v JOIN centroids c USING (group_id)) WHERE rn = 1""")
def _(s, d):
    return gr.medoids(vectors(s, d)).select("group_id", "medoid", "n_sessions")


@query("group_hashes", "2.9.4", sql="SELECT group_id, sha256(string_agg(session_key, ',' ORDER BY session_key)) AS hash FROM (SELECT DISTINCT group_id, session_key FROM members) GROUP BY 1")
def _(s, d):
    return gr.content_hashes(members(s, d))


@query("collapsed_nodes", "2.9.6", sql="SELECT group_id, session_key FROM members WHERE group_id LIKE '%\\_m0' ESCAPE '\\'")
def _(s, d):
    return gr.collapsed(members(s, d), table(s, d, "groups").where(F.col("group_id").endswith("_m0")))


oracle_define("prev_sessions", """
SELECT 'p_' || group_id AS group_id, session_key FROM group_sessions WHERE session_key NOT LIKE '%w5' AND NOT (group_id LIKE 'app4%' AND session_key LIKE '%w4') AND group_id <> 'app1_g2'
UNION ALL SELECT 'p_old', session_key FROM group_sessions WHERE group_id = 'app1_g2' AND session_key LIKE '%w1'""")


def previous(s, d):
    g = table(s, d, "group_sessions").select("group_id", "session_key")
    k, i = F.col("session_key"), F.col("group_id")
    old = g.where(~k.endswith("w5") & ~(i.startswith("app4") & k.endswith("w4")) & (i != "app1_g2")).withColumn("group_id", F.concat(F.lit("p_"), i))
    return old.unionByName(g.where((i == "app1_g2") & k.endswith("w1")).withColumn("group_id", F.lit("p_old")))


@query("group_delta", "2.9.7", sql="""
WITH i AS (SELECT c.group_id AS cur, p.group_id AS prev, count(*) AS i FROM group_sessions c JOIN prev_sessions p USING (session_key) GROUP BY 1, 2),
 j AS (SELECT cur, prev, i / (a.n + b.n - i) AS jac FROM i JOIN (SELECT group_id, count(*) AS n FROM group_sessions GROUP BY 1) a ON a.group_id = cur JOIN (SELECT group_id, count(*) AS n FROM prev_sessions GROUP BY 1) b ON b.group_id = prev),
 r AS (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY jac DESC, prev) AS rc, row_number() OVER (PARTITION BY prev ORDER BY jac DESC, cur) AS rp FROM j), k AS (SELECT * FROM r WHERE rc = 1 AND rp = 1 AND jac >= 0.8)
SELECT c.group_id, coalesce(k.prev, '') AS previous_id, CASE WHEN k.prev IS NULL THEN 'add' WHEN jac = 1 THEN 'keep' ELSE 'update' END AS action FROM (SELECT DISTINCT group_id FROM group_sessions) c LEFT JOIN k ON k.cur = c.group_id
UNION ALL SELECT '', p.group_id, 'remove' FROM (SELECT DISTINCT group_id FROM prev_sessions) p WHERE p.group_id NOT IN (SELECT prev FROM k)""")
def _(s, d):
    return gr.group_delta(table(s, d, "group_sessions"), previous(s, d))


@query("single_query_names", "2.9.9", sql="""
SELECT session_key AS group_id, min(text) AS name FROM (SELECT session_key, CASE WHEN idx % 2 = 0 OR length(text) > 200 THEN 'same' ELSE agent END AS text FROM steps) GROUP BY 1 HAVING count(DISTINCT text) = 1""")
def _(s, d):
    q = table(s, d, "steps").select(F.col("session_key").alias("group_id"), F.when((F.col("idx") % 2 == 0) | (F.length("text") > 200), "same").otherwise(F.col("agent")).alias("query"))
    return gr.single_query_names(q)


@query("embedding_cache_misses", "2.9.10", sql="SELECT DISTINCT text FROM conversations WHERE text NOT IN (SELECT text FROM benchmark UNION SELECT text FROM conversations WHERE turn % 2 = 0)")
def _(s, d):
    c = table(s, d, "conversations")
    cache = table(s, d, "benchmark").select("text").unionByName(c.where("turn % 2 = 0").select("text")).distinct()
    cache = cache.withColumns({"model": F.lit("m"), "vector": F.array(F.length("text").cast("double"))})
    return gr.cached_vectors(c.select("conv_id", "turn", "text"), cache, "m")[1]


# -- consistency ----------------------------------------------------------------------------

oracle_define("gvals", "SELECT g.group_id, m.metric, m.result_id AS id, m.session_key, m.result AS value FROM group_sessions g JOIN metric_rows m USING (session_key)")


def values(s, d):
    return table(s, d, "group_sessions").select("group_id", "session_key").join(table(s, d, "metric_rows"), "session_key").select(
        "group_id", "metric", F.col("result_id").alias("id"), "session_key", F.col("result").alias("value"))


GM = ["group_id", "metric"]


@query("bootstrap_consistency", "2.9.11", sql=f"""
WITH st AS (SELECT group_id, metric, count(*) AS n, max(value) - min(value) AS r FROM gvals GROUP BY 1, 2),
 nb AS (SELECT group_id, metric, value, row_number() OVER (PARTITION BY group_id, metric ORDER BY value, id) - 1 AS nr FROM gvals),
 d AS (SELECT i // {gr.DRAWS} AS rep, CAST('0x' || substr(md5('7|' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM range({gr.REPLICATES * gr.DRAWS}) t(i)),
 per AS (SELECT st.group_id, st.metric, rep, stddev_pop(nb.value) AS s FROM st CROSS JOIN d JOIN nb ON nb.group_id = st.group_id AND nb.metric = st.metric AND nb.nr = d.h % st.n GROUP BY 1, 2, 3),
 q AS (SELECT group_id, metric, avg(s) AS m, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM per GROUP BY 1, 2), f AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE r END AS top FROM q JOIN st USING (group_id, metric))
SELECT group_id, metric, n, round((top - m) / top, 6) AS consistency, round((top - hi) / top, 6) AS ci_low, round((top - lo) / top, 6) AS ci_high,
 CASE WHEN (hi - lo) / top < {gr.HIGH_WIDTH} THEN 'High' WHEN (hi - lo) / top < {gr.MEDIUM_WIDTH} THEN 'Medium' ELSE 'Low' END AS indicator FROM f""")
def _(s, d):
    return rounded(gr.bootstrap_consistency(values(s, d), GM), "consistency", "ci_low", "ci_high")


@query("metric_consistency", "2.9.12", sql="""
SELECT group_id, metric, n, round(std, 6) AS std, round(CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS max_score, round((CASE WHEN r = 0 THEN 1 ELSE r END - std) / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS consistency FROM (
 SELECT group_id, metric, count(*) AS n, stddev_pop(value) AS std, max(value) - min(value) AS r FROM gvals GROUP BY 1, 2)""")
def _(s, d):
    return rounded(gr.metric_spread(values(s, d), GM), "std", "max_score", "consistency")


@query("text_dispersion", "2.9.13", sql="""
SELECT group_id, round(1 - sqrt(sum(m * m)), 6) AS dispersion FROM (SELECT group_id, i, avg(CAST(vector[i] AS DOUBLE) / len) AS m FROM (SELECT *, sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) AS len FROM vectors), (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    return rounded(gr.text_dispersion(vectors(s, d), ["group_id"]), "dispersion")


@query("semantic_entropy", "2.9.14", sql="""
WITH c AS (SELECT application_id, CASE WHEN total > 300000 THEN 'own' || session_key ELSE CAST(nation AS VARCHAR) END AS cls FROM call_sessions), n AS (SELECT application_id, cls, count(*) AS c FROM c GROUP BY 1, 2)
SELECT application_id, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT application_id, c / sum(c) OVER (PARTITION BY application_id) AS p FROM n) GROUP BY 1""")
def _(s, d):
    rows = table(s, d, "call_sessions").withColumn("cls", F.when(F.col("total") <= 300000, F.col("nation")))
    return rounded(gr.semantic_entropy(rows, ["application_id"], "cls"), "entropy")


oracle_define("call_nodes", "SELECT application_id, session_key, row_number() OVER (PARTITION BY session_key ORDER BY idx, l_partkey, l_suppkey) AS node, agent FROM calls JOIN call_sessions USING (session_key)")
oracle_define("call_pairs", "SELECT DISTINCT a.application_id, a.session_key, a.agent AS src, b.agent AS dst FROM call_nodes a JOIN call_nodes b ON b.session_key = a.session_key AND b.node = a.node + 1")


def call_graphs(s, d):
    """Nodes (one per call) and edges (consecutive calls) of every session."""
    def make():
        calls = table(s, d, "calls")
        rows = Sequence(calls, ["session_key"], ORDER).number("node").done()
        rows = rows.join(table(s, d, "call_sessions").select("session_key", "application_id"), "session_key").select("application_id", "session_key", "node", "agent")
        # the next call while rows still lie by session: a second shuffle of all calls less
        return Sequence(rows, ["session_key"], ["node"], probe=calls.withColumn("node", F.col(ORDER[0]))).next(dst="node", dst_agent="agent").done()

    nodes = stored(s, d, "call_graph_nodes", make)
    edges = nodes.where("dst IS NOT NULL")
    nodes = nodes.select("application_id", "session_key", "node", "agent")
    return nodes, edges.select("application_id", "session_key", F.col("node").alias("src"), "dst", F.col("agent").alias("src_agent"), "dst_agent")


def agent_edges(edges):
    return edges.select("application_id", "session_key", F.col("src_agent").alias("src"), F.col("dst_agent").alias("dst")).distinct()


WL = "WITH l0 AS (SELECT application_id, session_key, node, agent AS label FROM call_nodes),\n" + ",\n".join(
    f"l{i} AS (SELECT a.application_id, a.session_key, a.node, sha256(a.label || '-' || coalesce(b.label, '')) AS label FROM l{i - 1} a LEFT JOIN l{i - 1} b ON b.session_key = a.session_key AND b.node = a.node + 1)" for i in range(1, 5)) + """,
 c AS (SELECT application_id, session_key, label, count(*) AS c FROM (""" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(5)) + """) GROUP BY 1, 2, 3),
 u AS (SELECT application_id, session_key, label, c / sqrt(sum(c * c) OVER (PARTITION BY session_key)) AS u FROM c), n AS (SELECT application_id, count(DISTINCT session_key) AS n FROM call_nodes GROUP BY 1)
SELECT application_id, n, round(1 - (sq - n) / (n * (n - 1)), 6) AS distance FROM (SELECT application_id, sum(s * s) AS sq FROM (SELECT application_id, label, sum(u) AS s FROM u GROUP BY 1, 2) GROUP BY 1) JOIN n USING (application_id)"""


@query("wl_graph_distance", "2.9.15", sql=WL)
def _(s, d):
    nodes, edges = call_graphs(s, d)
    labels = gr.wl_labels(nodes, edges, ["application_id", "session_key"])
    return rounded(gr.mean_graph_distance(labels, nodes, ["application_id"], "session_key"), "distance")


# -- outliers -------------------------------------------------------------------------------


@query("metric_outliers_robust", "2.9.16", sql="""
WITH m AS (SELECT *, count(*) OVER (PARTITION BY group_id, metric) AS n, quantile_cont(value, 0.5) OVER (PARTITION BY group_id, metric) AS med FROM gvals), a AS (SELECT *, abs(value - med) AS dev FROM m),
 b AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY group_id, metric) AS mad, avg(dev) OVER (PARTITION BY group_id, metric) AS md FROM a), c AS (SELECT *, CASE WHEN mad > 0 THEN mad / 0.6745 ELSE md * 1.253314 END AS sc FROM b)
SELECT id, group_id, round(CASE WHEN sc > 0 THEN (value - med) / sc ELSE 0 END, 4) AS z, n >= 2 AND abs(CASE WHEN sc > 0 THEN (value - med) / sc ELSE 0 END) > 3.5 AS outlier FROM c""")
def _(s, d):
    return gr.robust_outliers(values(s, d), GM).select("id", "group_id", F.round("z", 4).alias("z"), "outlier")


@query("metric_outliers_fences", "2.9.16", sql="""
SELECT id, n >= 2 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier FROM (SELECT *, count(*) OVER w AS n, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3 FROM gvals WINDOW w AS (PARTITION BY group_id, metric))""")
def _(s, d):
    return gr.fence_outliers(values(s, d), GM).select("id", "outlier")


@query("metric_outliers_isolation", "2.9.16")
def _(s, d):
    return gr.isolation_outliers(values(s, d), ["metric"]).select("metric", "id", "score", "outlier")


@query("embedding_outliers", "2.9.17", sql="""
WITH f AS (SELECT v.group_id, v.session_key, list_distance(CAST(v.vector AS DOUBLE[]), c.c) AS value FROM vectors v JOIN centroids c USING (group_id)),
 m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY group_id) AS med FROM f), b AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER (PARTITION BY group_id) AS mad FROM m)
SELECT session_key, round(value, 6) AS value, abs((value - med) / (mad / 0.6745)) > 3.5 AS outlier FROM b""")
def _(s, d):
    return gr.centroid_outliers(vectors(s, d)).select("session_key", r6("value").alias("value"), "outlier")


PATHS = "WITH RECURSIVE p(session_key, application_id, node, token, len) AS (SELECT session_key, application_id, node, agent, 1 FROM call_nodes UNION ALL SELECT p.session_key, p.application_id, n.node, p.token || '__' || n.agent, len + 1 FROM p JOIN call_nodes n ON n.session_key = p.session_key AND n.node = p.node + 1 WHERE len < 10), t AS (SELECT application_id, session_key, token, count(*) AS c FROM p GROUP BY 1, 2, 3)"


@query("path_tokens", "2.9.18", sql=PATHS + " SELECT session_key, token, c FROM t")
def _(s, d):
    nodes, edges = call_graphs(s, d)
    return gr.path_tokens(nodes, edges, ["application_id", "session_key"]).select("session_key", "token", "c")


@query("graph_outliers", "2.9.18", sql=PATHS + """, n AS (SELECT application_id, count(DISTINCT session_key) AS n FROM call_nodes GROUP BY 1), m AS (SELECT application_id, token, sum(c) / max(n) AS m FROM t JOIN n USING (application_id) GROUP BY 1, 2), mm AS (SELECT application_id, sum(m * m) AS mm FROM m GROUP BY 1),
 v AS (SELECT t.application_id, t.session_key, sqrt(greatest(0, sum(c * c - 2 * c * m) + max(mm))) AS value FROM t JOIN m USING (application_id, token) JOIN mm USING (application_id) GROUP BY 1, 2),
 b AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY application_id) AS med FROM v), a AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER (PARTITION BY application_id) AS mad FROM b)
SELECT session_key, round(value, 6) AS value, abs((value - med) / (mad / 0.6745)) > 3.5 AS outlier FROM a""")
def _(s, d):
    nodes, edges = call_graphs(s, d)
    tokens = cut_lineage(gr.path_tokens(nodes, edges, ["application_id", "session_key"]))
    far = gr.token_distance(tokens, nodes, ["application_id"], "session_key")
    return gr.robust_outliers(cut_lineage(far), ["application_id"]).select("session_key", r6("value").alias("value"), "outlier")


# -- normal behaviour -----------------------------------------------------------------------


@query("normal_ranges", "2.9.19", sql="""
SELECT group_id, metric, round(m, 6) AS mean, round(s, 6) AS std, round(s * s, 6) AS var, round(m - 2 * s, 6) AS g_lower, round(m + 2 * s, 6) AS g_upper, round(m - s, 6) AS v_lower, round(m + s, 6) AS v_upper, round(ql, 6) AS q_lower, round(md, 6) AS median, round(qu, 6) AS q_upper FROM (
 SELECT group_id, metric, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.05) AS ql, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.95) AS qu FROM gvals GROUP BY 1, 2)""")
def _(s, d):
    cols = ["mean", "std", "var", "g_lower", "g_upper", "v_lower", "v_upper", "q_lower", "median", "q_upper"]
    return gr.normal_ranges(values(s, d), GM).select(*GM, *[r6(c).alias(c) for c in cols])


@query("vector_ranges", "2.9.20", sql="""
SELECT group_id, dim, round(avg(x), 6) AS mean, round(avg(x) - 2 * stddev_pop(x), 6) AS g_lower, round(quantile_cont(x, 0.05), 6) AS q_lower, round(quantile_cont(x, 0.95), 6) AS q_upper FROM (SELECT group_id, i - 1 AS dim, CAST(vector[i] AS DOUBLE) AS x FROM vectors, (SELECT unnest(range(1, 65)) AS i)) GROUP BY 1, 2""")
def _(s, d):
    out = gr.vector_ranges(vectors(s, d), ["group_id"])
    return out.select("group_id", "dim", *[r6(c).alias(c) for c in ("mean", "g_lower", "q_lower", "q_upper")])


@query("centroid_representatives", "2.9.21", sql="""
SELECT group_id, session_key AS medoid, round(dd, 6) AS distance FROM (SELECT v.group_id, v.session_key, list_distance(CAST(v.vector AS DOUBLE[]), c.c) AS dd, row_number() OVER (PARTITION BY v.group_id ORDER BY list_distance(CAST(v.vector AS DOUBLE[]), c.c), v.session_key) AS rn FROM vectors v JOIN centroids c USING (group_id)) WHERE rn = 1""")
def _(s, d):
    return gr.medoids(vectors(s, d), metric="euclidean").select("group_id", "medoid", r6("distance").alias("distance"))


@query("kde_threshold", "2.9.22", sql="""
SELECT group_id, round(quantile_cont(ld, 0.05), 6) AS threshold FROM (SELECT a.group_id, a.session_key, ln(sum(exp(-pow(list_distance(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 2) / 2))) - ln(count(*)) - 32 * ln(2 * pi()) AS ld
 FROM vectors a JOIN vectors b ON a.group_id = b.group_id GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    from spanloom.functions.ordered import quantiles

    dens = cl.log_densities(vectors(s, d).withColumnRenamed("session_key", "id"), "group_id")
    return rounded(quantiles(dens, ["group_id"], "log_density", {"threshold": 0.05}).drop("n"), "threshold")


@query("confidence_ellipsoid", "2.9.23", sql="""
SELECT group_id, i - 1 AS i, j - 1 AS j, CASE WHEN round(covar_samp(CAST(vector[i] AS DOUBLE), CAST(vector[j] AS DOUBLE)), 6) = 0 THEN 0 ELSE round(covar_samp(CAST(vector[i] AS DOUBLE), CAST(vector[j] AS DOUBLE)), 6) END AS cov, round(64 * pow(1 - 2.0 / (9.0 * 64) + 1.6448536269514722 * sqrt(2.0 / (9.0 * 64)), 3), 4) AS threshold
FROM vectors, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) WHERE i <= j GROUP BY 1, i, j""")
def _(s, d):
    out = gr.confidence_ellipsoid(vectors(s, d), ["group_id"])
    return out.select("group_id", "i", "j", F.when(r6("cov") == 0, 0.0).otherwise(r6("cov")).alias("cov"), F.round("threshold", 4).alias("threshold"))


@query("medoid_graphs", "2.9.24", sql="""
WITH c AS (SELECT application_id, src, dst, count(*) AS c FROM call_pairs GROUP BY 1, 2, 3), g AS (SELECT DISTINCT application_id, session_key FROM call_nodes), n AS (SELECT application_id, count(*) AS n FROM g GROUP BY 1), tt AS (SELECT application_id, count(*) AS t FROM call_pairs GROUP BY 1),
 o AS (SELECT e.session_key, count(*) AS a, sum(c) AS s FROM call_pairs e JOIN c USING (application_id, src, dst) GROUP BY 1)
SELECT application_id, session_key AS medoid, CAST(dist AS BIGINT) AS distance FROM (SELECT g.*, n * coalesce(a, 0) + t - 2 * coalesce(s, 0) AS dist, row_number() OVER (PARTITION BY application_id ORDER BY n * coalesce(a, 0) + t - 2 * coalesce(s, 0), session_key) AS rn FROM g LEFT JOIN o USING (session_key) JOIN n USING (application_id) JOIN tt USING (application_id)) WHERE rn = 1""")
def _(s, d):
    nodes, edges = call_graphs(s, d)
    return gr.medoid_graphs(agent_edges(edges), nodes, ["application_id"], "session_key")


CONS = "WITH g AS (SELECT DISTINCT application_id, session_key FROM call_nodes), n AS (SELECT application_id, count(*) AS n FROM g GROUP BY 1), k AS (SELECT application_id, src, dst, count(*) AS c, max(n) AS n FROM call_pairs JOIN n USING (application_id) GROUP BY 1, 2, 3 HAVING count(*) > max(n) * 0.06)"


@query("consensus_edges", "2.9.25", sql=CONS + " SELECT * FROM k")
def _(s, d):
    nodes, edges = call_graphs(s, d)
    return gr.consensus_edges(agent_edges(edges), nodes, ["application_id"], "session_key", 0.06)


@query("closest_to_consensus", "2.9.25", sql=CONS + """, z AS (SELECT application_id, count(*) AS k FROM k GROUP BY 1), o AS (SELECT e.session_key, count(*) AS a, count(k.src) AS h FROM call_pairs e LEFT JOIN k ON k.application_id = e.application_id AND k.src = e.src AND k.dst = e.dst GROUP BY 1)
SELECT application_id, session_key AS closest, distance FROM (SELECT g.*, coalesce(a, 0) + coalesce(z.k, 0) - 2 * coalesce(h, 0) AS distance, row_number() OVER (PARTITION BY application_id ORDER BY coalesce(a, 0) + coalesce(z.k, 0) - 2 * coalesce(h, 0), session_key) AS rn FROM g LEFT JOIN o USING (session_key) LEFT JOIN z USING (application_id)) WHERE rn = 1""")
def _(s, d):
    nodes, edges = call_graphs(s, d)
    e = agent_edges(edges)
    k = gr.consensus_edges(e, nodes, ["application_id"], "session_key", 0.06)
    return gr.closest_to_consensus(e, nodes, k, ["application_id"], "session_key")


# -- insights -------------------------------------------------------------------------------

oracle_define("outl", """
SELECT group_id, metric, session_key, id FROM (SELECT *, CASE WHEN sc > 0 THEN abs(value - med) / sc ELSE 0 END AS z FROM (SELECT *, CASE WHEN mad > 0 THEN mad / 0.6745 ELSE md * 1.253314 END AS sc FROM (
 SELECT *, quantile_cont(abs(value - med), 0.5) OVER w AS mad, avg(abs(value - med)) OVER w AS md FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY group_id, metric) AS med FROM gvals) WINDOW w AS (PARTITION BY group_id, metric)))) WHERE z > 1.8""")
oracle_define("norm", "SELECT group_id, metric, avg(value) AS centroid FROM gvals GROUP BY 1, 2")
oracle_define("mreports", "SELECT group_id, metric, 'metric' AS data_type, avg(value) AS mean FROM gvals WHERE metric NOT IN ('Cost', 'CyclesCount') GROUP BY 1, 2")


def metric_outliers(s, d):
    return stored(s, d, "metric_outliers", lambda: gr.robust_outliers(values(s, d), GM, 1.8).where("outlier").select(*GM, "session_key", "id"))


def normal(s, d):
    return values(s, d).groupBy(*GM).agg(F.avg("value").alias("centroid"))


def metric_reports(s, d):
    v = values(s, d).where("metric NOT IN ('Cost', 'CyclesCount')")
    return v.groupBy(*GM).agg(F.avg("value").alias("mean")).withColumn("data_type", F.lit("metric"))


def targets(df, template):
    return ins.fill(df, template).select("target", "name", "id")


def ins_sql(template, name, target, rows):
    return f"SELECT DISTINCT target, name, sha256('{template}' || target || name) AS id FROM (SELECT {target} AS target, {name} AS name FROM {rows})"


@query("insight_inconsistent_groups", "2.9.26", "2.9.27", sql=" UNION ALL ".join(
    ins_sql(t, f"'{text} in group \"' || g.name || '\"'", "r.group_id", f"reports r JOIN groups g USING (group_id) WHERE data_type = '{layer}' AND mean < 0.7")
    for t, text, layer in (("graph_inconsistency", "Unreliable execution patterns", "graph"), ("metric_inconsistency", "Unreliable metric results", "metric"), ("text_inconsistency", "Unreliable textual outcomes", "text"))))
def _(s, d):
    rows = [targets(ins.inconsistent_groups(table(s, d, "reports"), table(s, d, "groups"), layer), f"{layer}_inconsistency") for layer in ("graph", "metric", "text")]
    return ins.all_insights(rows)


OV = "(SELECT o.session_key, o.metric, m.result, c.centroid FROM (SELECT DISTINCT group_id, metric, session_key FROM outl) o JOIN metric_rows m ON m.session_key = o.session_key AND m.metric = o.metric JOIN norm c ON c.group_id = o.group_id AND c.metric = o.metric)"


@query("insight_spikes_and_drops", "2.9.28", sql=ins_sql("metric_spike", "'Unexpected spike in ' || metric", "session_key", f"{OV} WHERE centroid <> 0 AND result / centroid > 1.5") + " UNION ALL " + ins_sql(
    "metric_drop", "'Unexpected drop in ' || metric", "session_key", f"{OV} WHERE result = 0 OR centroid / nullif(result, 0) > 1.5"))
def _(s, d):
    o, m, n = metric_outliers(s, d), table(s, d, "metric_rows"), normal(s, d)
    return ins.all_insights([targets(ins.spikes(o, m, n), "metric_spike"), targets(ins.drops(o, m, n), "metric_drop")])


def risk_sql(template, name, where):
    rows = f"(SELECT g.session_key, r.metric, r.mean FROM group_sessions g JOIN mreports r USING (group_id) JOIN metric_rows m ON m.session_key = g.session_key AND m.metric = r.metric WHERE {where} AND NOT EXISTS (SELECT 1 FROM outl o WHERE o.group_id = g.group_id AND o.session_key = g.session_key AND o.metric = r.metric))"
    return ins_sql(template, f"'{name} metric consistency risk on ' || metric", "session_key", rows)


@query("insight_consistency_risks", "2.9.29", sql=risk_sql("critical_risk", "High", "mean <= 0.45") + " UNION ALL " + risk_sql("low_risk", "Low", "mean > 0.45 AND mean <= 0.60"))
def _(s, d):
    args = (metric_reports(s, d), table(s, d, "group_sessions"), table(s, d, "metric_rows"), metric_outliers(s, d))
    return ins.all_insights([
        targets(ins.consistency_risks(*args, None, ins.CRITICAL), "critical_risk"),
        targets(ins.consistency_risks(*args, ins.CRITICAL, ins.LOW), "low_risk")])


@query("insight_graph_and_text_anomalies", "2.9.30", sql=ins_sql("graph_anomaly", "'Anomalous execution graph for session ' || o.session_key", "o.session_key", "outl o JOIN groups g USING (group_id) WHERE o.metric = 'Cost'") + " UNION ALL " + ins_sql(
    "text_anomaly", "'Anomalous textual output for session ' || session_key", "session_key", "outl WHERE metric = 'Groundedness'"))
def _(s, d):
    o = metric_outliers(s, d)
    nodes, edges = graph(s, d)
    texts = tv.session_texts(nodes, edges).select(F.col("session").alias("session_key"), "output")
    heads = table(s, d, "group_sessions").groupBy("group_id").agg(F.min("session_key").alias("medoid"))
    return ins.all_insights([
        targets(ins.graph_anomalies(o.where("metric = 'Cost'"), table(s, d, "groups")), "graph_anomaly"),
        targets(ins.text_anomalies(o.where("metric = 'Groundedness'"), heads, texts), "text_anomaly")])
