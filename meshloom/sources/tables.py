"""Canonical tables, derived from the driver's parquet files.

Nodes and features come from `embeddings`, interactions from the order tables, time slices from `events`. Readers return
plain DataFrames, so filters and column choices of later steps reach the parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Number of clients that own parts of the data.
CLIENTS = 5
#: Rows of a partition at most, and those of a small table's; so a task's memory stays as the tables grow.
PART_ROWS, SMALL_ROWS = 1 << 20, 1 << 15
#: The same where a task sorts what it holds, for a join of tables that may both be large.
SORT_ROWS = 1 << 18


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(spark: SparkSession, sf_dir: str, *names: str, part_rows: int | None = None) -> int:
    """How many partitions rows of these tables are dealt to: one per part_rows (PART_ROWS), or the session's number if that is more.

    A small table gets fewer, one per SMALL_ROWS. Counting reads the files' footers only.
    """
    one = [load(spark, sf_dir, name).select(F.lit(1)) for name in names]
    rows, usual = reduce(DataFrame.union, one).count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // (part_rows or PART_ROWS)), min(usual, -(-rows // SMALL_ROWS)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x (array of doubles), label, split (train, val, test), client_id."""
    r = F.pmod("vec_id", F.lit(10))
    split = F.when(r < 7, "train").when(r == 7, "val").otherwise("test")
    e = load(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"), "label",
        split.alias("split"), F.pmod("vec_id", F.lit(CLIENTS)).cast("int").alias("client_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: i with 7i+1 and i+1 modulo the number of nodes, both ways, distinct, without loops."""
    ids = load(spark, sf_dir, "embeddings").select("vec_id")
    n = ids.agg(F.count(F.lit(1))).scalar()
    ends = F.explode(F.array(F.pmod(7 * F.col("vec_id") + 1, n), F.pmod(F.col("vec_id") + 1, n)))
    one = ids.select(F.col("vec_id").alias("src"), ends.alias("dst"))
    return one.union(one.select("dst", "src")).where("src <> dst").distinct()


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", "client_id")


def _orders_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, user_id, client_id (region), ts of orders of known customers and nations."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    if (count := parts_for(spark, sf_dir, "orders", "customer", part_rows=SORT_ROWS)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        orders = orders.repartition(count, "o_custkey")  # or the session's number bounds their tasks
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # nation is a table of fixed size
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("n_regionkey").alias("client_id"), "ts")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id (region), user_id, item_id, ts: a row per line item; duplicates stay. Line items move once, by order."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(parts_for(spark, sf_dir, "lineitem"), "l_orderkey")
    joined = line.join(_orders_by_client(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("client_id", "user_id", F.col("l_partkey").alias("item_id"), "ts")


def order_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One small graph per order: graphs(graph_id, y) and edges(graph_id, src, dst) between its parts and suppliers.

    Part ids are even and supplier ids odd, so they do not clash.
    """
    graphs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderstatus").alias("y"))
    line = load(spark, sf_dir, "lineitem")
    one = line.select(F.col("l_orderkey").alias("graph_id"), (2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))
    one = one.repartition(parts_for(spark, sf_dir, "lineitem"), "graph_id")  # what is grouped by graph then stays where it is
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return graphs, one.distinct().select("graph_id", ways).select("graph_id", "e.src", "e.dst")


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, name, pos, v, n: a deterministic stand-in for client models. v is the mean discount, n its rows."""
    count = parts_for(spark, sf_dir, "lineitem", "orders", "part")
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount").repartition(count, "l_orderkey")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    # orders and parts of a partition are few: a hash join needs no memory for sorting line items
    orders = _orders_by_client(spark, sf_dir).select("o_orderkey", "client_id").hint("shuffle_hash")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("client_id", "l_partkey", "l_discount")
    rows = rows.repartition(count, "l_partkey").join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    # numbers as keys: names follow once a client's part is one row
    sums = rows.groupBy("client_id", "l_partkey", F.pmod("p_size", F.lit(3)).alias("layer")).agg(F.avg("l_discount").alias("v"), F.count(F.lit(1)).alias("n"))
    return sums.select("client_id", F.concat(F.lit("layer"), F.col("layer").cast("string")).alias("name"), F.col("l_partkey").alias("pos"), "v", "n")


#: Tab-separated interactions: user, item, time; no header.
INTERACTION_SCHEMA = T.StructType([T.StructField("user", T.StringType()), T.StructField("item", T.StringType()), T.StructField("time", T.StringType())])


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """user, item, time of a tab-separated file or folder, as text."""
    return spark.read.csv(path, sep="\t", header=False, schema=INTERACTION_SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one whole number per line: line content as `id`; other lines give null."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS BIGINT)").alias("id"))


def write_by_client(df: DataFrame, path: str) -> None:
    """A folder per client; reading one client then reads its folder only."""
    df.write.mode("overwrite").partitionBy("client_id").parquet(path)


def read_client(spark: SparkSession, path: str, client_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("client_id") == client_id)


def write_metrics(df: DataFrame, path: str) -> None:
    """Appends metrics of a run as CSV with a header."""
    df.write.mode("append").option("header", True).csv(path)


#: DuckDB twins of the tables above, as common table expressions.
SQL = {
    "nodes": "nodes AS (SELECT vec_id AS node_id, embedding AS x, label, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, (vec_id % 5)::INT AS client_id FROM embeddings)",
    "xl": "xl AS (SELECT vec_id AS node_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "edges": "n AS (SELECT count(*) AS n FROM embeddings), e1 AS (SELECT vec_id AS src, (7 * vec_id + 1) % n AS dst FROM embeddings, n UNION ALL SELECT vec_id, (vec_id + 1) % n FROM embeddings, n), edges AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1) WHERE src <> dst)",
    "inter": "inter AS (SELECT n_regionkey AS client_id, o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "graphs": "graphs AS (SELECT o_orderkey AS graph_id, o_orderstatus AS y FROM orders), ge AS (SELECT DISTINCT graph_id, src, dst FROM (SELECT l_orderkey AS graph_id, 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem UNION ALL SELECT l_orderkey, 2 * l_suppkey + 1, 2 * l_partkey FROM lineitem))",
    "params": "params AS (SELECT n_regionkey AS client_id, 'layer' || (p_size % 3) AS name, l_partkey AS pos, avg(l_discount) AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
}


def cte(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
