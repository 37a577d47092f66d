"""Neighbour mixing and robust aggregation over messages (node_id, c, v) and weights (src, dst, w).

Coordinate-wise rules work on the long form. Rules that look at whole vectors
work on arrays (node_id, x). Every output is (node_id, c, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def received(weights: DataFrame, messages: DataFrame) -> DataFrame:
    """src, dst, w, c, v: each neighbour's coordinates; the edge table is a graph's, and small next to the messages."""
    return messages.withColumnRenamed("node_id", "dst").join(weights, "dst")


def weighted_mean(weights: DataFrame, messages: DataFrame) -> DataFrame:
    return received(weights, messages).groupBy(F.col("src").alias("node_id"), "c").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def pairs(weights: DataFrame, messages: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """src, dst, w, own, other: the node's vector, of its model before the step (node_id, c, th) where given, and the neighbour's message."""
    wide = V.wide_form(messages, "node_id")
    mine = wide if before is None else V.wide_form(before, "node_id", v="th")
    own = mine.select(F.col("node_id").alias("src"), F.col("x").alias("own"))
    other = wide.select(F.col("node_id").alias("dst"), F.col("x").alias("other"))
    return weights.join(own, "src").join(other, "dst")


def _summed(rows: DataFrame, vector: str = "term") -> DataFrame:
    return V.long_form(rows, vector, "src").groupBy(F.col("src").alias("node_id"), "c").agg(F.sum("v").alias("v"))


def kept_weights(weights: DataFrame, flagged: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w): flagged neighbours (src, dst) weigh nothing, and what they weighed goes to the node itself; every node of nodes has its own row."""
    marked = weights.where("src <> dst").join(flagged.select("src", "dst", F.lit(True).alias("bad")), ["src", "dst"], "left")
    kept = marked.where("bad IS NULL").select("src", "dst", "w")
    own = nodes.select(F.col("node_id").alias("src")).distinct().join(kept.groupBy("src").agg(F.sum("w").alias("mass")), "src", "left")
    return kept.unionByName(own.select("src", F.col("src").alias("dst"), (1 - F.coalesce("mass", F.lit(0.0))).alias("w")))


def projected(weights: DataFrame, messages: DataFrame, before: DataFrame, flagged: DataFrame, radius: float) -> DataFrame:
    """(src, dst, w, near): messages that a node keeps, its own among them, each moved to within radius of its model before the step."""
    kept = kept_weights(weights, flagged, messages.select("node_id"))
    return pairs(kept, messages, before).select("src", "dst", "w", V.project("own", "other", radius).alias("near"))


def filtered_projection(weights: DataFrame, messages: DataFrame, before: DataFrame, flagged: DataFrame, radius: float) -> DataFrame:
    """The kept weights' mean of the projected messages."""
    moved = projected(weights, messages, before, flagged, radius)
    return _summed(moved.select("src", F.transform("near", lambda x: x * F.col("w")).alias("term")))


def oracle_flags(edges: DataFrame, nodes: DataFrame, rates: DataFrame, abstain: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """src, dst of flagged neighbours, by a hash of the edge: attackers with probability 1 - fnr, honest ones with probability fpr, by the node's own rates (node_id, fnr, fpr); attackers that abstain (node_id) are neither."""
    far = nodes.select(F.col("node_id").alias("dst"), "is_byz")
    own = rates.select(F.col("node_id").alias("src"), "fnr", "fpr")
    u = F.pmod((F.col("src").cast("long") * 7919 + F.col("dst") * 104729 + seed * 1299709) * 48271, F.lit(2147483647)) / F.lit(2147483647.0)
    seen = edges.where("src <> dst").join(far, "dst").join(own, "src")
    if abstain is not None:
        seen = seen.join(abstain.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return seen.where(F.when(F.col("is_byz"), u >= F.col("fnr")).otherwise(u < F.col("fpr"))).select("src", "dst")


def clipped(weights: DataFrame, messages: DataFrame, radius: float = 0.3) -> DataFrame:
    """Self-centred clipping: own + sum of w * clip(other - own, radius)."""
    both = pairs(weights.where("src <> dst"), messages)
    d = V.distance("own", "other")
    scale = F.when(d > radius, F.lit(radius) / d).otherwise(1.0) * F.col("w")
    moves = both.withColumn("s", scale).select("src", F.zip_with("other", "own", lambda o, x: F.col("s") * (o - x)).alias("term"))
    moved = _summed(moves)
    return messages.select("node_id", "c", F.col("v").alias("own")).join(moved, ["node_id", "c"], "left").select("node_id", "c", (F.col("own") + F.coalesce("v", F.lit(0.0))).alias("v"))


def trimmed(edges: DataFrame, messages: DataFrame, q: int) -> DataFrame:
    """Coordinate-wise mean without the q smallest and largest of m neighbours (q at most (m-1)//2), mixed with the own value by 1/(m+1-2q)."""
    values = F.array_sort(F.collect_list("v"))
    got = received(edges.where("src <> dst").select("src", "dst"), messages).groupBy("src", "c").agg(values.alias("vs"))
    got = got.withColumn("m", F.size("vs")).withColumn("q", F.least(F.lit(q), F.floor((F.col("m") - 1) / 2).cast("int")))
    kept = F.slice("vs", F.col("q") + 1, F.col("m") - 2 * F.col("q"))
    mean = F.aggregate(kept, F.lit(0.0), lambda t, x: t + x) / F.size(kept)
    r = 1.0 / (F.col("m") + 1 - 2 * F.col("q"))
    means = got.select(F.col("src").alias("node_id"), "c", mean.alias("mean"), r.alias("r"))
    return messages.select("node_id", "c", F.col("v").alias("own")).join(means, ["node_id", "c"]).select("node_id", "c", ((1 - F.col("r")) * F.col("mean") + F.col("r") * F.col("own")).alias("v"))


def coordinate_median(weights: DataFrame, messages: DataFrame) -> DataFrame:
    """(1 - w_ii) times the neighbours' median plus w_ii times the own value."""
    med = received(weights.where("src <> dst"), messages).groupBy(F.col("src").alias("node_id"), "c").agg(F.median("v").alias("med"))
    own = weights.where("src = dst").select(F.col("src").alias("node_id"), F.col("w").alias("own_w"))
    return messages.withColumnRenamed("v", "own").join(med, ["node_id", "c"]).join(own, "node_id").select("node_id", "c", ((1 - F.col("own_w")) * F.col("med") + F.col("own_w") * F.col("own")).alias("v"))


def outlier_rounds(weights: DataFrame, messages: DataFrame, q: int) -> DataFrame:
    """(src, dst, w) that stay trusted after q rounds of dropping the neighbour farthest from the trusted weighted mean; ties by the smaller id.

    The node itself is never dropped. Each round is one join, one aggregation and one ranking.
    """
    trusted = weights
    for _ in range(q):
        inside = received(trusted, messages)
        mean = inside.groupBy("src", "c").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))
        far = inside.join(mean, ["src", "c"]).groupBy("src", "dst", "w").agg(F.sum((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("d2"))
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("is_self"), F.col("d2").desc(), "dst"))
        ranked = far.withColumn("is_self", (F.col("src") == F.col("dst")).cast("int")).withColumn("rank", rank)
        trusted = ranked.where("rank > 1 OR is_self = 1").select("src", "dst", "w")
    return trusted


def outlier_mean(weights: DataFrame, messages: DataFrame, q: int) -> DataFrame:
    """Weighted mean of the trusted; w_ii times the own value where the weights sum to 0."""
    trusted = outlier_rounds(weights, messages, q)
    got = received(trusted, messages).groupBy(F.col("src").alias("node_id"), "c").agg(F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w") * F.col("v"))).alias("own"))
    return got.select("node_id", "c", F.when(F.col("mass") == 0, F.col("own")).otherwise(F.col("s") / F.col("mass")).alias("v"))


def spread_constant(edges: DataFrame, messages: DataFrame, alpha: float, share: float = 0.8, factor: float = 1.2) -> DataFrame:
    """proj_const: factor times the quantile of distances between neighbours' messages, over alpha."""
    both = pairs(edges.where("src <> dst").select("src", "dst"), messages)
    return both.select((V.distance("own", "other") / alpha).alias("r")).agg((F.percentile("r", F.lit(share)) * factor).alias("proj_const"))


def aggregate(name: str, weights: DataFrame, messages: DataFrame, q: int = 1) -> DataFrame:
    """An aggregator by its name; unknown names raise."""
    rules = {
        "mean": lambda: weighted_mean(weights, messages),
        "outlier_mean": lambda: outlier_mean(weights, messages, q),
        "clipped": lambda: clipped(weights, messages),
        "trimmed": lambda: trimmed(weights, messages, q),
        "median": lambda: coordinate_median(weights, messages),
    }
    if name not in rules:
        raise ValueError(f"unknown aggregator {name!r}")
    return rules[name]()
