"""Features of an edge (i, j): what a node sees of a neighbour's message.

Vectors come as (src, dst, own, other, g): the node's model before the step,
the neighbour's message, the node's own gradient. D = own - other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

EPS = 1e-12


def direction(edges: DataFrame, alpha: float) -> DataFrame:
    """src, dst, cos_g, log_norm_ratio, log_alpha."""
    d = V.minus("own", "other")
    with_d = edges.withColumn("d", d)
    length, size = V.norm("d"), V.norm("g")
    return with_d.select("src", "dst", (V.dot("d", "g") / (length * size + EPS)).alias("cos_g"), F.log(length / (alpha * size) + EPS).alias("log_norm_ratio"), F.lit(float(np.log(alpha + EPS))).alias("log_alpha"))


def left_out_median(df: DataFrame, value: str, keys: list[str], out: str = "med") -> DataFrame:
    """Adds each row's median of the other rows of its group, from ranks: no pair of rows is formed, and a row holds four of its group's values. Groups of one give null."""
    order, group = Window.partitionBy(*keys).orderBy(F.col(value), "dst"), Window.partitionBy(*keys)
    ranked = df.withColumn("r_", F.row_number().over(order)).withColumn("m_", F.count("*").over(group))
    # of the m - 1 others the middle ranks are lo and hi; from the own rank on they stand one place further
    lo, hi = F.floor(F.col("m_") / 2), F.floor((F.col("m_") + 1) / 2)
    at = lambda k: F.max(F.when(F.col("r_") == k, F.col(value))).over(group)
    placed = ranked.withColumns({"lo_": at(lo), "lo1_": at(lo + 1), "hi_": at(hi), "hi1_": at(hi + 1)})
    low, high = (F.when(F.col("r_") <= k, F.col(f"{name}1_")).otherwise(F.col(f"{name}_")) for name, k in (("lo", lo), ("hi", hi)))
    return placed.withColumn(out, F.when(F.col("m_") > 1, (low + high) / 2)).drop("r_", "m_", "lo_", "lo1_", "hi_", "hi1_")


def consensus(edges: DataFrame) -> DataFrame:
    """src, dst, cos_gbar (D against the others' median D), log_dev_norm; 0 for nodes of fewer than three neighbours."""
    d = edges.select("src", "dst", F.posexplode(V.minus("own", "other")).alias("c", "v"))
    med = left_out_median(d, "v", ["src", "c"])
    sums = med.groupBy("src", "dst").agg(F.sum(F.col("v") * F.col("med")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nv"), F.sqrt(F.sum(F.col("med") * F.col("med"))).alias("nm"), F.sqrt(F.sum((F.col("v") - F.col("med")) * (F.col("v") - F.col("med")))).alias("dev"))
    typical = sums.groupBy("src").agg(F.median("dev").alias("typical"), F.count("*").alias("m"))
    both = sums.join(typical, "src")
    few = F.col("m") < 3
    return both.select("src", "dst", F.when(few, 0.0).otherwise(F.col("dot") / (F.col("nv") * F.col("nm") + EPS)).alias("cos_gbar"), F.when(few, 0.0).otherwise(F.log(F.col("dev") / (F.col("typical") + EPS) + EPS)).alias("log_dev_norm"))


def class_weights(samples: DataFrame) -> DataFrame:
    """node_id, label, n, weight: 1 / (classes present * the class's samples), so each class weighs alike."""
    n = samples.groupBy("node_id", "label").agg(F.count("*").alias("n"))
    present = n.groupBy("node_id").agg(F.count("*").alias("classes"))
    return n.join(present, "node_id").select("node_id", "label", "n", (1.0 / (F.col("classes") * F.col("n"))).alias("weight"))


def shift_margin(sums: DataFrame, columns: DataFrame, classes: int) -> DataFrame:
    """src, dst, margin: max over shifts s of rho(s), minus rho(0); rho(s) = - mean over the shard's classes of cos(class sum c, column c + s of D).

    sums (src, cls, x) has classes present only; columns (src, dst, cls, x) has all of D's columns.
    """
    shifted = sums.withColumnRenamed("x", "own").crossJoin(F.broadcast(sums.sparkSession.range(classes).select(F.col("id").cast("int").alias("s")))).withColumn("at", F.pmod(F.col("cls") + F.col("s"), F.lit(classes)).cast("int")).select("src", "s", "at", "own")
    both = shifted.join(columns.withColumnRenamed("cls", "at"), ["src", "at"])
    cos = V.dot("own", "x") / (V.norm("own") * V.norm("x") + EPS)
    rho = both.groupBy("src", "dst", "s").agg((-F.avg(cos)).alias("rho"))
    return rho.groupBy("src", "dst").agg((F.max("rho") - F.max(F.when(F.col("s") == 0, F.col("rho")))).alias("margin"))


def stable_rank(edges: DataFrame, classes: int, by_class: bool = False) -> DataFrame:
    """src, dst, stable_rank: squared Frobenius norm over the largest squared singular value of D as a (d, classes) matrix, rows after one another, or columns if by_class."""

    @F.pandas_udf("double")
    def rank(d: pd.Series) -> pd.Series:
        def one(v) -> float:
            a = np.asarray(v, dtype=float)
            a = a.reshape(classes, -1).T if by_class else a.reshape(-1, classes)
            gram = a.T @ a
            return float(np.trace(gram) / (np.linalg.eigvalsh(gram)[-1] + EPS))

        return d.map(one)

    return edges.select("src", "dst", rank(V.minus("own", "other")).alias("stable_rank"))


def neighbour_loss(edges: DataFrame, samples: DataFrame, theta: DataFrame, reg: float = 0.01) -> DataFrame:
    """src, dst, acc (the neighbour's model on the node's shard), ce_diff_nbr (its class-balanced loss with penalty, against the node's other neighbours)."""
    from .training import scored

    # the pair's number stands for a node, so that each pair's samples meet the neighbour's model
    pairs = edges.select("src", "dst", F.xxhash64("src", "dst").alias("pair"))
    seen = samples.withColumnRenamed("node_id", "src").join(pairs.select("src", "dst", "pair"), "src").withColumnRenamed("pair", "node_id")
    models = theta.withColumnRenamed("node_id", "dst").join(pairs.select("dst", F.col("pair").alias("node_id")), "dst").select("node_id", "cls", "t")
    weights = class_weights(samples).select(F.col("node_id").alias("src"), "label", "weight")
    p = scored(seen, models).join(weights, ["src", "label"])
    ce = F.col("weight") * (F.col("lse") - F.col("z")[F.col("label").cast("int")])
    got = p.groupBy("src", "dst").agg(F.sum(ce).alias("ce"), F.avg((V.argmax(F.col("z")) == F.col("label")).cast("double")).alias("acc"))
    size = theta.groupBy(F.col("node_id").alias("dst")).agg(F.sum(F.aggregate("t", F.lit(0.0), lambda s, x: s + x * x)).alias("sq"))
    loss = got.join(size, "dst").withColumn("loss", F.col("ce") + 0.5 * reg * F.col("sq"))
    return loss.select("src", "dst", "acc").join(against_others(loss.select("src", "dst", "loss"), "loss", "ce_diff_nbr"), ["src", "dst"])


#: An edge's features, in order, and those of heavy tails, which are scaled by quantiles and stand first after it.
FEATURES = ("cos_g", "log_norm_ratio", "margin", "stable_rank", "acc", "cos_gbar", "log_dev_norm", "ce_diff_nbr", "log_alpha")
HEAVY = ("log_norm_ratio", "log_dev_norm", "ce_diff_nbr")


def assembled(direction_: DataFrame, margin: DataFrame, rank: DataFrame, loss: DataFrame, consensus_: DataFrame) -> DataFrame:
    """src, dst and the nine features in their order; NaN, infinities and nulls are 0."""
    out = direction_
    for part in (margin, rank, loss, consensus_):
        out = out.join(part, ["src", "dst"], "left")
    return finite(out.select("src", "dst", *FEATURES), *FEATURES)


def edge_features(edges: DataFrame, samples: DataFrame, before: DataFrame, after: DataFrame, gradients: DataFrame, classes: int, alpha: float, reg: float = 0.01) -> DataFrame:
    """The nine features of each edge (src, dst) of a round: before (node_id, cls, t) the models, after the half steps that were sent, gradients (node_id, cls, c, g) the nodes' own."""
    g = V.wide_form(gradients.select("node_id", F.struct("cls", "c").alias("at"), "g"), "node_id", c="at", v="g", out="g").select(F.col("node_id").alias("src"), "g")
    flat = lambda df, key, name: df.groupBy(F.col("node_id").alias(key)).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("cls", "t"))), lambda r: r["t"])).alias(name))
    vectors = edges.join(flat(before, "src", "own"), "src").join(flat(after, "dst", "other"), "dst").join(g, "src")
    sums = V.wide_form(samples.select(F.col("node_id").alias("src"), F.col("label").alias("cls"), F.posexplode("x").alias("c", "v")).groupBy("src", "cls", "c").agg(F.sum("v").alias("v")), "src", "cls")
    mine, theirs = before.select(F.col("node_id").alias("src"), "cls", F.col("t").alias("a")), after.select(F.col("node_id").alias("dst"), "cls", F.col("t").alias("b"))
    columns = edges.join(mine, "src").join(theirs, ["dst", "cls"]).select("src", "dst", "cls", V.minus("a", "b").alias("x"))
    rank = stable_rank(vectors.withColumns({c: F.col(c) for c in ("own", "other")}), classes, by_class=True)
    return assembled(direction(vectors, alpha), shift_margin(sums, columns, classes), rank, neighbour_loss(edges, samples, after, reg), consensus(vectors))


def fit_scaler(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """(centre, width) of each feature: median and unit-normal quartile range of the heavy ones, mean and population deviation of the others; a width of 0 counts as 1. One aggregation, one row."""
    unit = 1.3489795003921634
    wanted = []
    for f in FEATURES:
        q = lambda share, f=f: F.percentile(f, F.lit(share))
        centre, width = (q(0.5), (q(0.75) - q(0.25)) / unit) if f in HEAVY else (F.avg(f), F.stddev_pop(f))
        wanted.append(F.struct(centre.alias("centre"), F.when(width == 0, 1.0).otherwise(width).alias("width")).alias(f))
    got = rows.agg(*wanted).head()
    return {f: (float(got[f].centre), float(got[f].width)) for f in FEATURES}


def scale(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """The other columns and the scaled features, heavy ones first."""
    order = [*HEAVY, *(f for f in FEATURES if f not in HEAVY)]
    return rows.select(*[c for c in rows.columns if c not in FEATURES], *[((F.col(f) - scaler[f][0]) / scaler[f][1]).alias(f) for f in order])


def against_others(values: DataFrame, value: str, out: str) -> DataFrame:
    """src, dst, out: the value minus the median of the node's other neighbours; 0 below three neighbours."""
    med = left_out_median(values, value, ["src"])
    m = F.count("*").over(Window.partitionBy("src"))
    return med.withColumn("m_", m).select("src", "dst", F.when(F.col("m_") < 3, 0.0).otherwise(F.col(value) - F.col("med")).alias(out))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities become 0."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) | F.col(c).isNull()
    return df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in columns})
