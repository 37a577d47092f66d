"""Frames that the queries share, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph
from ..sources import tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
N = 20

#: Nodes, edges, weights and shards as SQL; queries name what they need after it.
SHARED = """
s AS (SELECT vec_id, label, CAST((vec_id * 7919) % 20 AS INTEGER) AS node_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT vec_id, label, node_id, CAST(unnest(range(len(x))) AS INTEGER) AS c, unnest(x) AS v FROM s),
m AS (SELECT node_id, c, avg(v) AS v, avg(v) FILTER (WHERE (vec_id // 20) % 2 = 0) AS th FROM e GROUP BY node_id, c),
n AS (SELECT CAST(range AS INTEGER) AS node_id, range % 7 = 3 AS is_byz FROM range(20)),
g AS (SELECT a.node_id AS src, b.node_id AS dst FROM n a JOIN n b ON a.node_id <> b.node_id AND (abs(a.node_id - b.node_id) IN (1, 19) OR (least(a.node_id, b.node_id) * 31 + greatest(a.node_id, b.node_id) * 17) % 10 < 2)),
deg AS (SELECT src, count(*) AS d FROM g GROUP BY src),
w0 AS (SELECT g.src, g.dst, 1.0e0 / (1 + greatest(a.d, b.d)) AS w FROM g JOIN deg a ON g.src = a.src JOIN deg b ON g.dst = b.src),
w AS (SELECT src, dst, w FROM w0 UNION ALL SELECT src, src, 1 - sum(w) FROM w0 GROUP BY src),
wide AS (SELECT node_id, list(v ORDER BY c) AS x, list(th ORDER BY c) AS t, list((th - v) / 0.5e0 ORDER BY c) AS gr FROM m GROUP BY node_id),
pairs AS (SELECT w.src, w.dst, w.w, a.x AS own, b.x AS other, a.t AS own_t, a.gr FROM w JOIN wide a ON a.node_id = w.src JOIN wide b ON b.node_id = w.dst)
"""


def register(name: str, sql: str | None = None, shared: bool = True):
    """Adds a query, and its SQL; ``WITH`` what is shared unless the SQL stands alone."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            if shared:
                own = body.startswith("WITH")
                body = f"WITH RECURSIVE {SHARED.strip()}{', ' + body[5:] if own else ' ' + body}"
            SQL[name] = body
        return f

    return add


def tidy(x: Column | str) -> Column:
    return V.tidy(F.col(x) if isinstance(x, str) else x)


def frame(spark, sf_dir: str):
    return tables.samples(spark, sf_dir, N)


def models(spark, sf_dir: str) -> DataFrame:
    return tables.models(tables.coordinates(frame(spark, sf_dir)))


def messages(spark, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).select("node_id", "c", "v")


def nodes(spark) -> DataFrame:
    return graph.nodes(spark, N)


def edges(spark) -> DataFrame:
    return graph.edges_where(nodes(spark), graph.ring_with_chords(N))


def weights(spark) -> DataFrame:
    return graph.mh_weights(edges(spark))


def wide_models(spark, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir).withColumn("gr", (F.col("th") - F.col("v")) / 0.5)
    rows = F.sort_array(F.collect_list(F.struct("c", "v", "th", "gr")))
    return m.groupBy("node_id").agg(rows.alias("r")).select("node_id", F.transform("r", lambda p: p["v"]).alias("x"), F.transform("r", lambda p: p["th"]).alias("t"), F.transform("r", lambda p: p["gr"]).alias("gr"))


def edge_vectors(spark, sf_dir: str) -> DataFrame:
    """src, dst, own (the model before), other (the neighbour's message), g (the own gradient)."""
    wide = wide_models(spark, sf_dir)
    own = wide.select(F.col("node_id").alias("src"), F.col("t").alias("own"), F.col("gr").alias("g"))
    other = wide.select(F.col("node_id").alias("dst"), F.col("x").alias("other"))
    return edges(spark).join(own, "src").join(other, "dst")


def coords(df: DataFrame) -> DataFrame:
    return df.select("node_id", "c", tidy("v").alias("v"))
