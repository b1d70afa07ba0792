"""Queries on what is kept between runs: id maps, windows that move by a day, factors of tall matrices."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from meshloom.operators import range_finder, slices
from meshloom.plans.common import r4
from meshloom.session import shared_folder
from meshloom.sources import tables as T
from meshloom.sources.id_map import IdMap
from meshloom.sources.tables import cte
from meshloom.streaming import keyed

#: Batches that the events arrive in; the first window's days, how many windows there are.
BATCHES, FROM, UPTO, WINDOWS = 3, date(1998, 6, 1), date(1998, 7, 1), 10


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def extended_id_map(spark, sf_dir):
    """Users numbered in three batches of events; the second one is run twice, as after a lost job."""
    events = T.load(spark, sf_dir, "events").select("event_id", "user_id")
    # parts of equal width of the ids, which a footer's smallest and largest value tell
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - (low or 0)) * BATCHES / ((high or 0) - (low or 0) + 1))
    known = IdMap(spark, _fresh(spark, "id-map"), events.schema["user_id"].dataType)
    for batch in (0, 1, 1, 2):
        known.extend(events.where(part == batch), "user_id", "event_id", batch)
    return known.rows(BATCHES).select(F.col("value").alias("user_id"), "idx")


def advanced_slices(spark, sf_dir):
    """Degrees and sums of item features of each user in ten windows of thirty days, each made from the one before."""
    path = _fresh(spark, "edges-by-day")
    edges = T.interactions(spark, sf_dir).select(F.col("user_id").alias("node"), F.col("item_id").alias("other"), "ts")
    slices.store_by_day(edges, path)
    features = T.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("other"), F.array(F.lit(1.0), F.col("p_size").cast("double")).alias("x"))
    views = slices.day_by_day(spark, path, features, 2, FROM, UPTO, WINDOWS)
    return views.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("node").alias("user_id"), "degree", r4(F.col("x")[0]).alias("ones"), r4(F.col("x")[1]).alias("size"))


def _tall(spark, sf_dir):
    """A matrix per client of customers by months: numbers of orders. It has as many rows as there are customers."""
    o = T.load(spark, sf_dir, "orders").select((F.col("o_custkey") % T.CLIENTS).cast("int").alias("client_id"), F.lit("months").alias("name"), F.col("o_custkey").alias("i"), F.month("o_orderdate").alias("j"))
    return o.groupBy("client_id", "name", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


def range_round_trip(spark, sf_dir):
    """All twelve triplets of each matrix give the numbers of orders again."""
    back = range_finder.from_factors(range_finder.range_factors(_tall(spark, sf_dir), 12, extra=2, rounds=1))
    return back.select("client_id", "i", "j", r4("v").alias("v")).where("v > 0")


def range_top_value(spark, sf_dir):
    """The largest singular value of each matrix, from a random range of five columns."""
    factors = range_finder.range_factors(_tall(spark, sf_dir), 1, extra=4, rounds=4)
    return factors.where("side = 's'").select("client_id", r4("v").alias("s"))


def keyed_tests(spark, sf_dir):
    """Users' vectors learned from a stream of events that comes in three parts, each scored before it is learned from; features are whole.

    The stream ends after each part and is taken up again from its state when the next has come.
    """
    events = T.load(spark, sf_dir, "events").select("event_id", "user_id", F.array(F.lit(1.0), F.coalesce(F.floor("value"), F.lit(0)).cast("double")).alias("x"))
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - (low or 0)) * BATCHES / ((high or 0) - (low or 0) + 1))
    name = f"keyed-tests-{uuid.uuid4().hex}"
    source, run = f"{shared_folder(spark)}/{name}/source", keyed.KeyedRun(spark, name)
    for k in range(BATCHES):
        events.where(part == k).drop("event_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.drop("event_id").schema).parquet(source)
        run.upto_now(keyed.keyed_tests(stream, "user_id", 2))
    return run.tests().select("user_id", "n", "seen", "score")


QUERIES = {f.__name__: f for f in (extended_id_map, advanced_slices, range_round_trip, range_top_value, keyed_tests)}

_TALL = "WITH RECURSIVE m AS (SELECT (o_custkey % 5)::INT AS client_id, o_custkey AS i, month(o_orderdate)::INT AS j, count(*)::DOUBLE AS v FROM orders GROUP BY ALL)"

ORACLE = {
    "extended_id_map": "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS idx FROM events GROUP BY user_id",
    "advanced_slices": cte("inter") + f", d AS (SELECT DATE '{UPTO}' + t.k::INT - 1 AS last, DATE '{FROM}' + t.k::INT AS first FROM range({WINDOWS}) t(k)) SELECT strftime(last, '%Y-%m-%d') AS day, user_id, count(*) AS degree, count(*)::DOUBLE AS ones, sum(p_size)::DOUBLE AS size FROM d JOIN inter ON ts::DATE BETWEEN first AND last JOIN part ON p_partkey = item_id GROUP BY ALL",
    "keyed_tests": f"""WITH b AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events),
 e AS (SELECT user_id, floor((event_id - low) * {BATCHES} / (high - low + 1)) AS part, coalesce(floor(value), 0)::DOUBLE AS v FROM events, b),
 p AS (SELECT user_id, part, count(*) AS n, sum(v) AS s FROM e GROUP BY ALL),
 w AS (SELECT *, coalesce(sum(n) OVER before, 0)::BIGINT AS seen, coalesce(sum(s) OVER before, 0) AS learned FROM p WINDOW before AS (PARTITION BY user_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT user_id, n, seen, n * seen + s * learned AS score FROM w""",
    "range_round_trip": _TALL + " SELECT client_id, i, j::BIGINT AS j, v FROM m",
    # power steps on the twelve-sided Gram matrix, whose entries are all positive
    "range_top_value": _TALL + """, g AS (SELECT a.client_id, a.j, b.j AS l, sum(a.v * b.v) AS v FROM m a JOIN m b USING (client_id, i) GROUP BY ALL),
 r AS (SELECT client_id, j, list(v ORDER BY l) AS row FROM (SELECT c.client_id, x.j, y.j AS l, coalesce(g.v, 0) AS v FROM (SELECT DISTINCT client_id FROM m) c CROSS JOIN (SELECT unnest(range(1, 13))::INT AS j) x CROSS JOIN (SELECT unnest(range(1, 13))::INT AS j) y LEFT JOIN g ON g.client_id = c.client_id AND g.j = x.j AND g.l = y.j) GROUP BY ALL),
 a AS (SELECT client_id, list(row ORDER BY j) AS a FROM r GROUP BY 1),
 it AS (SELECT client_id, a, list_transform(range(12), lambda k: 1.0::DOUBLE) AS x, 0 AS t FROM a
  UNION ALL SELECT client_id, a, list_transform(list_transform(a, lambda row: list_inner_product(row, x)), lambda y: y / list_max(list_transform(a, lambda row: list_inner_product(row, x)))), t + 1 FROM it WHERE t < 60)
 SELECT client_id, round(sqrt(list_inner_product(list_transform(a, lambda row: list_inner_product(row, x)), x) / list_inner_product(x, x)), 4) AS s FROM it WHERE t = 60""",
}
