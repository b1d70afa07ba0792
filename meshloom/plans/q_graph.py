"""Queries on nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions.scalar import one_hot
from meshloom.operators import graph
from meshloom.plans.common import WIDTH, long_form, r4
from meshloom.sources import tables as T
from meshloom.sources.tables import cte


def _hop(norm: str, include_self: bool = True):
    def run(spark, sf_dir):
        return long_form(graph.hop_sum(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), WIDTH, norm, include_self), "node_id")

    return run


def row_normalize(spark, sf_dir):
    w = T.edges(spark, sf_dir).withColumn("w", (F.col("src") % 3).cast("double") * (F.col("dst") % 5 + 1))
    return graph.row_normalised(w).withColumn("w", r4("w"))


def degree_stats(spark, sf_dir):
    d = graph.degrees(T.edges(spark, sf_dir))
    return d.agg(F.min("degree").alias("d_min"), F.max("degree").alias("d_max"), r4(F.avg("degree")).alias("d_mean"), F.count(F.lit(1)).alias("n"))


def degree_onehot(spark, sf_dir):
    graphs, edges = T.order_graphs(spark, sf_dir)
    d = graph.degrees(edges, ("graph_id",))
    wide = d.withColumn("width", d.agg((F.max("degree") + 1).cast("int")).scalar())
    return wide.select("graph_id", "node_id", (F.array_position(one_hot(F.col("degree"), F.col("width")), 1) - 1).cast("int").alias("dim"))


def undirected_closure(spark, sf_dir):
    one = T.interactions(spark, sf_dir).select(F.col("user_id").alias("src"), (F.col("item_id") + 1_000_000_000).alias("dst"))
    return graph.undirected(one)


def self_loops(spark, sf_dir):
    both = graph.with_self_loops(T.edges(spark, sf_dir), T.nodes(spark, sf_dir))
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


def induced_subgraph(spark, sf_dir):
    members = T.nodes(spark, sf_dir).where("label < 5").select("node_id")
    return graph.induced(T.edges(spark, sf_dir), members)


def khop1_nodes(spark, sf_dir):
    return graph.k_hop_nodes(T.owners(spark, sf_dir), T.edges(spark, sf_dir), 1, ("client_id",))


def subsample_nodes(spark, sf_dir):
    n = 100
    return T.edges(spark, sf_dir).where((F.col("src") < n) & (F.col("dst") < n))


def planetoid_split(spark, sf_dir):
    split = F.when(F.col("vec_id") < 140, "train").when(F.col("vec_id") < 300, "val").when(F.col("vec_id") >= 400, "test").otherwise("none")
    return T.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), split.alias("split"))


def gap_fill(spark, sf_dir):
    known = T.load(spark, sf_dir, "embeddings").where("vec_id % 7 <> 3").select("vec_id", F.col("embedding")[0].cast("double").alias("x0"))
    ends = known.agg(F.max("vec_id").alias("m")).where("m is not null")
    ids = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("id"))
    return ids.join(known, ids["id"] == known["vec_id"], "left").select("id", r4(F.coalesce("x0", F.lit(0.0))).alias("x0"))


def _sets(spark, sf_dir):
    line = T.load(spark, sf_dir, "lineitem").where("l_quantity < 10").select(F.col("l_partkey").alias("id"))
    part = T.load(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    return line, part


def set_intersect(spark, sf_dir):
    return graph.set_intersect(*_sets(spark, sf_dir))


def set_symdiff(spark, sf_dir):
    return graph.set_symdiff(*_sets(spark, sf_dir))


def set_difference(spark, sf_dir):
    return graph.set_difference(*_sets(spark, sf_dir))


def client_feature_sum(spark, sf_dir):
    parts = graph.client_feature_sum(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), T.owners(spark, sf_dir), WIDTH)
    return long_form(parts, "client_id", "node_id")


def global_feature_sum(spark, sf_dir):
    parts = graph.client_feature_sum(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), T.owners(spark, sf_dir), WIDTH)
    return long_form(graph.global_sum(parts, WIDTH), "node_id")


def fed_sym_sum(spark, sf_dir):
    parts = graph.client_feature_sum(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), T.owners(spark, sf_dir), WIDTH, "sym")
    return long_form(graph.global_sum(parts, WIDTH), "node_id")


def _fed_gap(spark, sf_dir, norm):
    n, e, o = T.nodes(spark, sf_dir), T.edges(spark, sf_dir), T.owners(spark, sf_dir)
    fed = graph.global_sum(graph.client_feature_sum(n, e, o, WIDTH, norm), WIDTH).withColumnRenamed("x", "f")
    whole = graph.hop_sum(n, e, WIDTH, norm)
    gap = F.array_max(F.zip_with("f", "x", lambda a, b: F.abs(a - b)))
    return fed.join(whole, "node_id").agg(r4(F.max(gap)).alias("gap"), F.count(F.lit(1)).alias("nodes"))


def feature_sum_equivalence(spark, sf_dir):
    return _fed_gap(spark, sf_dir, "none")


def fed_sym_vs_global_sym(spark, sf_dir):
    return _fed_gap(spark, sf_dir, "sym")


def download_slice(spark, sf_dir):
    views, _ = graph.client_views(T.edges(spark, sf_dir), T.owners(spark, sf_dir), 2)
    sums = graph.hop_sum(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), WIDTH)
    return views.join(sums, "node_id").select("client_id", "node_id", r4(F.col("x")[0]).alias("x0"))


def graph_stats(spark, sf_dir):
    graphs, edges = T.order_graphs(spark, sf_dir)
    per = edges.groupBy("graph_id").agg(F.count_distinct("src").alias("nodes"), (F.count(F.lit(1)) / 2).alias("edges"))
    all_ = graphs.join(per, "graph_id", "left").na.fill(0)
    return all_.groupBy("y").agg(F.count(F.lit(1)).alias("graphs"), r4(F.avg("nodes")).alias("nodes"), r4(F.avg("edges")).alias("edges"))


def graph_labels(spark, sf_dir):
    return T.order_graphs(spark, sf_dir)[0].agg(F.count_distinct("y").alias("classes"))


def split_stats_wide(spark, sf_dir):
    n = T.nodes(spark, sf_dir)
    return n.groupBy("client_id").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {
    "feature_sum_1hop_none": _hop("none"),
    "feature_sum_1hop_sym": _hop("sym"),
    "feature_sum_1hop_row": _hop("row"),
    "neighbor_sum_no_self": _hop("none", False),
    **{f.__name__: f for f in (row_normalize, degree_stats, degree_onehot, undirected_closure, self_loops, induced_subgraph, khop1_nodes, subsample_nodes, planetoid_split, gap_fill, set_intersect, set_symdiff, set_difference, client_feature_sum, global_feature_sum, fed_sym_sum, feature_sum_equivalence, fed_sym_vs_global_sym, download_slice, graph_stats, graph_labels, split_stats_wide)},
}

_H = cte("nodes", "xl", "edges") + ", h AS (SELECT src, dst FROM edges UNION ALL SELECT vec_id, vec_id FROM embeddings), d AS (SELECT src AS node_id, count(*)::DOUBLE AS d FROM h GROUP BY 1)"
_SETS = "WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity < 10), b AS (SELECT DISTINCT p_partkey AS id FROM part WHERE p_size < 25)"
_HELD = ", held AS (SELECT client_id, src, dst FROM edges JOIN nodes ON dst = node_id)"
_FED_NONE = cte("nodes", "xl", "edges") + _HELD + ", s AS (SELECT client_id, src AS node_id, dim, v FROM held JOIN xl ON held.dst = xl.node_id UNION ALL SELECT client_id, nodes.node_id, dim, v FROM nodes JOIN xl ON nodes.node_id = xl.node_id), f AS (SELECT client_id, node_id, dim, sum(v) AS v FROM s GROUP BY ALL)"
_FED_SYM = cte("nodes", "xl", "edges") + _HELD + """, cd AS (SELECT client_id, src AS node_id, count(*) + 1 AS d FROM held GROUP BY ALL),
 s AS (SELECT client_id, src AS node_id, dst AS other FROM held UNION ALL SELECT client_id, node_id, node_id FROM nodes),
 f AS (SELECT s.client_id, s.node_id, dim, sum(v / sqrt(coalesce(c1.d, 1)) / sqrt(coalesce(c2.d, 1))) AS v FROM s JOIN xl ON s.other = xl.node_id
   LEFT JOIN cd c1 ON c1.client_id = s.client_id AND c1.node_id = s.node_id LEFT JOIN cd c2 ON c2.client_id = s.client_id AND c2.node_id = s.other GROUP BY ALL)"""
_SYM = "SELECT h.src AS node_id, xl.dim::INT AS dim, sum(xl.v / sqrt(a.d) / sqrt(b.d)) AS v FROM h JOIN xl ON h.dst = xl.node_id JOIN d a ON a.node_id = h.src JOIN d b ON b.node_id = h.dst GROUP BY ALL"
_VIEW = ", view AS (SELECT client_id, node_id FROM nodes UNION SELECT client_id, src FROM edges JOIN nodes ON dst = node_id)"

ORACLE = {
    "feature_sum_1hop_none": f"{_H} SELECT h.src AS node_id, xl.dim::INT AS dim, round(sum(xl.v), 4) + 0.0 AS v FROM h JOIN xl ON h.dst = xl.node_id GROUP BY ALL",
    "feature_sum_1hop_sym": f"{_H} SELECT node_id, dim, round(v, 4) + 0.0 AS v FROM ({_SYM})",
    "feature_sum_1hop_row": f"{_H} SELECT h.src AS node_id, xl.dim::INT AS dim, round(sum(xl.v) / any_value(d.d), 4) + 0.0 AS v FROM h JOIN xl ON h.dst = xl.node_id JOIN d ON d.node_id = h.src GROUP BY h.src, xl.dim",
    "neighbor_sum_no_self": cte("xl", "edges") + " SELECT src AS node_id, xl.dim::INT AS dim, round(sum(xl.v), 4) + 0.0 AS v FROM edges JOIN xl ON dst = node_id GROUP BY ALL",
    "row_normalize": cte("edges") + ", w AS (SELECT src, dst, (src % 3)::DOUBLE * (dst % 5 + 1) AS w FROM edges) SELECT src, dst, CASE WHEN sum(w) OVER p <> 0 THEN round(w / sum(w) OVER p, 4) ELSE 0.0 END AS w FROM w WINDOW p AS (PARTITION BY src)",
    "degree_stats": cte("edges") + ", d AS (SELECT src, count(*) AS c FROM edges GROUP BY 1) SELECT min(c) AS d_min, max(c) AS d_max, round(avg(c), 4) AS d_mean, count(*) AS n FROM d",
    "degree_onehot": cte("graphs") + " SELECT graph_id, src AS node_id, count(*)::INT AS dim FROM ge GROUP BY 1, 2",
    "undirected_closure": cte("inter") + ", o AS (SELECT user_id AS src, item_id + 1000000000 AS dst FROM inter) SELECT src, dst FROM o UNION SELECT dst, src FROM o",
    "self_loops": _H + " SELECT src, count(*) AS edges, count(*) FILTER (src = dst) AS loops FROM h GROUP BY 1",
    "induced_subgraph": cte("nodes", "edges") + " SELECT src, dst FROM edges JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id WHERE a.label < 5 AND b.label < 5",
    "khop1_nodes": cte("nodes", "edges") + _VIEW + " SELECT client_id, node_id FROM view",
    "subsample_nodes": cte("edges") + " SELECT src, dst FROM edges WHERE src < 100 AND dst < 100",
    "planetoid_split": "SELECT vec_id AS node_id, CASE WHEN vec_id < 140 THEN 'train' WHEN vec_id < 300 THEN 'val' WHEN vec_id >= 400 THEN 'test' ELSE 'none' END AS split FROM embeddings",
    "gap_fill": "WITH k AS (SELECT vec_id, embedding[1]::DOUBLE AS x0 FROM embeddings WHERE vec_id % 7 <> 3), r AS (SELECT unnest(range((SELECT max(vec_id) + 1 FROM k))) AS id) SELECT id, round(coalesce(x0, 0.0), 4) + 0.0 AS x0 FROM r LEFT JOIN k ON id = vec_id",
    "set_intersect": _SETS + " SELECT id FROM a INTERSECT SELECT id FROM b",
    "set_symdiff": _SETS + " (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)",
    "set_difference": _SETS + " SELECT id FROM a EXCEPT SELECT id FROM b",
    "client_feature_sum": _FED_NONE + " SELECT client_id, node_id, dim::INT AS dim, round(v, 4) + 0.0 AS v FROM f",
    "global_feature_sum": _FED_NONE + " SELECT node_id, dim::INT AS dim, round(sum(v), 4) + 0.0 AS v FROM f GROUP BY ALL",
    "fed_sym_sum": _FED_SYM + " SELECT node_id, dim::INT AS dim, round(sum(v), 4) + 0.0 AS v FROM f GROUP BY ALL",
    "feature_sum_equivalence": "SELECT 0.0::DOUBLE AS gap, count(*) AS nodes FROM embeddings",
    "fed_sym_vs_global_sym": _FED_SYM + ", h AS (SELECT src, dst FROM edges UNION ALL SELECT vec_id, vec_id FROM embeddings), d AS (SELECT src AS node_id, count(*)::DOUBLE AS d FROM h GROUP BY 1), g AS (SELECT node_id, dim, sum(v) AS v FROM f GROUP BY ALL), w AS (" + _SYM + ") SELECT round(max(abs(g.v - w.v)), 4) AS gap, count(DISTINCT g.node_id) AS nodes FROM g JOIN w ON g.node_id = w.node_id AND g.dim = w.dim",
    "download_slice": _H + _VIEW + ", s AS (SELECT h.src AS node_id, sum(v) AS v FROM h JOIN xl ON h.dst = xl.node_id AND xl.dim = 0 GROUP BY 1) SELECT client_id, view.node_id, round(v, 4) + 0.0 AS x0 FROM view JOIN s ON view.node_id = s.node_id",
    "graph_stats": cte("graphs") + ", p AS (SELECT graph_id, count(DISTINCT src) AS nodes, count(*) / 2 AS edges FROM ge GROUP BY 1) SELECT y, count(*) AS graphs, round(avg(coalesce(nodes, 0)), 4) AS nodes, round(avg(coalesce(edges, 0)), 4) AS edges FROM graphs LEFT JOIN p ON graphs.graph_id = p.graph_id GROUP BY y",
    "graph_labels": "SELECT count(DISTINCT o_orderstatus) AS classes FROM orders",
    "split_stats_wide": cte("nodes") + " SELECT client_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM nodes GROUP BY 1",
}
