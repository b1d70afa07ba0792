"""Queries on how nodes and graphs are dealt out to clients."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import graph, partition
from meshloom.plans.common import sql_hash
from meshloom.sources import tables as T
from meshloom.sources.tables import cte


def _fixed_shares(spark):
    """share of client c in a label: (c + 1 + label mod 3) / their sum."""
    rows = [(label, c, (c + 1 + label % 3) / (15 + 5 * (label % 3))) for label in range(10) for c in range(5)]
    return spark.createDataFrame(rows, "label int, client_id int, share double")


def _labelled(spark, sf_dir):
    return T.nodes(spark, sf_dir).select("node_id", "label")


def partition_hash_dirichlet(spark, sf_dir):
    return partition.by_label_cuts(_labelled(spark, sf_dir), _fixed_shares(spark))


def partition_dirichlet(spark, sf_dir):
    """With shares drawn from a seed, which the twin has as numbers."""
    nodes = _labelled(spark, sf_dir)
    counts = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    shares = partition.dirichlet_shares(counts, 5, 10.0, sizes="equal")
    return partition.by_label_cuts(nodes, spark.createDataFrame(shares, "label int, client_id int, share double"))


def partition_label_block(spark, sf_dir):
    return partition.by_label_block(_labelled(spark, sf_dir), 5, 10, 0.6)


def partition_size_stats(spark, sf_dir):
    p = partition_hash_dirichlet(spark, sf_dir)
    return p.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))


def client_comm_nodes(spark, sf_dir):
    views, _ = graph.client_views(T.edges(spark, sf_dir), T.owners(spark, sf_dir), 2)
    return views.select("client_id", "node_id", "is_local")


def client_local_index(spark, sf_dir):
    views, _ = graph.client_views(T.edges(spark, sf_dir), T.owners(spark, sf_dir), 2)
    return views.select("client_id", "node_id", F.col("local_idx").cast("long").alias("local_idx"))


def client_edges_relabel(spark, sf_dir):
    views, edges = graph.client_views(T.edges(spark, sf_dir), T.owners(spark, sf_dir), 2)
    return graph.relabelled(edges, views).select("client_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def client_split_counts(spark, sf_dir):
    """What a client tells about itself: owned nodes by split, all nodes it sees, its edges."""
    n, e, o = T.nodes(spark, sf_dir), T.edges(spark, sf_dir), T.owners(spark, sf_dir)
    views, edges = graph.client_views(e, o, 2)
    own = n.groupBy("client_id").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")], (F.max("label") + 1).alias("classes"))
    seen = views.groupBy("client_id").agg(F.count(F.lit(1)).alias("seen"))
    return own.join(seen, "client_id").join(edges.groupBy("client_id").agg(F.count(F.lit(1)).alias("edges")), "client_id")


def gc_chunk_split(spark, sf_dir):
    return partition.graph_chunks(T.order_graphs(spark, sf_dir)[0], 10)


def gc_overlap_split(spark, sf_dir):
    out = partition.overlapping_chunks(T.order_graphs(spark, sf_dir)[0], 5)
    return out.groupBy("client_id").agg(F.count(F.lit(1)).alias("draws"), F.sum("graph_id").alias("checksum"))


def stratified_split(spark, sf_dir):
    return partition.stratified_split(T.order_graphs(spark, sf_dir)[0], "graph_id", "y", 0.8)


QUERIES = {f.__name__: f for f in (partition_hash_dirichlet, partition_dirichlet, partition_label_block, partition_size_stats, client_comm_nodes, client_local_index, client_edges_relabel, client_split_counts, gc_chunk_split, gc_overlap_split, stratified_split)}

_PLACED = f"WITH p AS (SELECT vec_id AS node_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('vec_id')}, vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"
_CUTS = _PLACED + """, sh AS (SELECT l AS label, c AS client_id, (c + 1 + l % 3)::DOUBLE / (15 + 5 * (l % 3)) AS share FROM (SELECT unnest(range(10)) AS l), (SELECT unnest(range(5)) AS c)),
 k AS (SELECT DISTINCT label, n FROM p),
 hi AS (SELECT label, client_id, CASE WHEN client_id = 4 THEN n ELSE floor(round(sum(share) OVER (PARTITION BY label ORDER BY client_id), 9) * n) END AS hi FROM sh JOIN k USING (label)),
 c AS (SELECT label, client_id, coalesce(lag(hi) OVER (PARTITION BY label ORDER BY client_id), 0) AS lo, hi FROM hi),
 a AS (SELECT node_id, p.label, client_id::INT AS client_id FROM p JOIN c ON p.label = c.label AND pos >= lo AND pos < hi)"""
_VIEW = cte("nodes", "edges") + """, view AS (SELECT client_id, node_id FROM nodes UNION SELECT client_id, src FROM edges JOIN nodes ON dst = node_id),
 vi AS (SELECT client_id, node_id, row_number() OVER (PARTITION BY client_id ORDER BY node_id) - 1 AS local_idx FROM view),
 ve AS (SELECT a.client_id, src, dst, a.local_idx AS s, b.local_idx AS t FROM edges JOIN vi a ON src = a.node_id JOIN vi b ON dst = b.node_id AND a.client_id = b.client_id)"""

_DRAWN = ", ".join(f"({label}, {c}, {share!r}::DOUBLE)" for label, c, share in partition.dirichlet_shares(dict.fromkeys(range(10), 1000), 5, 10.0, sizes="equal"))
_FIXED = "sh AS (SELECT l AS label, c AS client_id, (c + 1 + l % 3)::DOUBLE / (15 + 5 * (l % 3)) AS share FROM (SELECT unnest(range(10)) AS l), (SELECT unnest(range(5)) AS c))"

ORACLE = {
    "partition_dirichlet": _CUTS.replace(_FIXED, f"sh AS (SELECT * FROM (VALUES {_DRAWN}) v(label, client_id, share))") + " SELECT * FROM a",
    "partition_hash_dirichlet": _CUTS + " SELECT * FROM a",
    "partition_label_block": _PLACED + f" SELECT node_id, label, (CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN (label % 10) % 5 ELSE {sql_hash('node_id', seed=43)} % 5 END)::INT AS client_id, pos < floor(n * 0.6::DOUBLE) AS block FROM p",
    "partition_size_stats": _CUTS + " SELECT client_id, count(*) AS n, count(DISTINCT label) AS labels FROM a GROUP BY 1",
    "client_comm_nodes": _VIEW + " SELECT view.client_id, view.node_id, nodes.client_id = view.client_id AS is_local FROM view JOIN nodes ON view.node_id = nodes.node_id",
    "client_local_index": _VIEW + " SELECT * FROM vi",
    "client_edges_relabel": _VIEW + " SELECT client_id, s AS src, t AS dst FROM ve",
    "client_split_counts": _VIEW + """ SELECT client_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, max(label) + 1 AS classes,
   (SELECT count(*) FROM vi WHERE vi.client_id = nodes.client_id) AS seen, (SELECT count(*) FROM ve WHERE ve.client_id = nodes.client_id) AS edges FROM nodes GROUP BY client_id""",
    "gc_chunk_split": f"WITH p AS (SELECT o_orderkey AS graph_id, row_number() OVER (ORDER BY {sql_hash('o_orderkey')}, o_orderkey) - 1 AS pos, greatest(1, least(50, count(*) OVER () // 10)) AS size FROM orders) SELECT graph_id, (CASE WHEN pos // size < 10 THEN pos // size ELSE {sql_hash('graph_id', seed=43)} % 10 END)::INT AS client_id FROM p",
    "stratified_split": f"WITH p AS (SELECT o_orderkey AS graph_id, o_orderstatus AS y, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash('o_orderkey')}, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT graph_id, y, pos < floor(n * 0.8::DOUBLE) AS is_train FROM p",
    "gc_overlap_split": f"""WITH p AS (SELECT o_orderkey AS graph_id, row_number() OVER (ORDER BY {sql_hash('o_orderkey')}, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
 c AS (SELECT id AS client_id, 50 + {sql_hash('id', seed=44)} % 100 AS size FROM range(5) t(id)), d AS (SELECT client_id, unnest(range(1, size + 1)) AS draw FROM c),
 e AS (SELECT client_id, draw, {sql_hash('client_id', 'draw', seed=45)} % (SELECT max(n) FROM p) AS pos FROM d)
 SELECT client_id::INT AS client_id, count(*) AS draws, sum(graph_id)::BIGINT AS checksum FROM e JOIN p USING (pos) GROUP BY 1""",
}
