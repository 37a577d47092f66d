"""Messages of attackers; half steps are (node_id, c, v), models before them (node_id, c, th)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sign_flip(steps: DataFrame, scale: float = 1.0) -> DataFrame:
    """th + scale * (th - v): the step in the other direction; steps has th and v."""
    return steps.select("node_id", "c", (F.col("th") + scale * (F.col("th") - F.col("v"))).alias("v"))


def label_flip(samples: DataFrame, shifts: DataFrame, classes: int) -> DataFrame:
    """Labels of attackers' samples moved by the attacker's shift (node_id, shift); others keep theirs."""
    moved = F.pmod(F.col("label") + F.coalesce("shift", F.lit(0)), F.lit(classes))
    return samples.join(shifts, "node_id", "left").withColumn("label", moved.cast("int")).drop("shift")


def gaussian(messages: DataFrame, seed: int = 11) -> DataFrame:
    """The message plus standard normal noise in each coordinate, drawn from a hash of (node, coordinate)."""
    u = lambda k: (F.pmod(F.xxhash64("node_id", "c", F.lit(seed + k)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    noise = F.sqrt(-2 * F.log(u(0))) * F.cos(F.lit(6.283185307179586) * u(1))
    return messages.select("node_id", "c", (F.col("v") + noise).alias("v"))


def z_of(n: int, m: int) -> float:
    """Normal quantile of the share that m of n colluding nodes may hide behind."""
    s = n // 2 + 1 - m
    p = (n - m - s) / max(n - m, 1)
    return NormalDist().inv_cdf(min(max(p, 1e-6), 1 - 1e-6))


def z_table(edges: DataFrame, nodes: DataFrame) -> list[tuple[int, int, int, float]]:
    """(node_id, n, m, z) of each attacker: n its degree + 1, m its attacking neighbours + 1."""
    far = nodes.select(F.col("node_id").alias("dst"), "is_byz")
    near = edges.where("src <> dst").join(far, "dst").groupBy(F.col("src").alias("node_id")).agg((F.count("*") + 1).alias("n"), (F.count_if("is_byz") + 1).alias("m"))
    rows = near.join(nodes.where("is_byz").select("node_id"), "node_id", "left_semi").collect()
    return sorted((r.node_id, r.n, r.m, z_of(r.n, r.m)) for r in rows)


def honest_neighbours(edges: DataFrame, nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """src (attacker), dst (honest), c, and the messages' columns."""
    attackers = nodes.where("is_byz").select(F.col("node_id").alias("src"))
    honest = nodes.where("NOT is_byz").select(F.col("node_id").alias("dst"))
    inner = edges.where("src <> dst").join(attackers, "src", "left_semi").join(honest, "dst", "left_semi")
    return messages.withColumnRenamed("node_id", "dst").join(inner.select("src", "dst"), "dst")


def little_is_enough(edges: DataFrame, nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Mean minus z sample deviations of the honest neighbours' messages; attackers with fewer than two have no row."""
    spark = messages.sparkSession
    z = spark.createDataFrame([(i, z) for i, _, _, z in z_table(edges, nodes)], "node_id int, z double")
    got = honest_neighbours(edges, nodes, messages).groupBy(F.col("src").alias("node_id"), "c").agg(F.count("*").alias("k"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return got.where("k >= 2").join(z, "node_id").select("node_id", "c", (F.col("mean") - F.col("z") * F.col("sd")).alias("v"))


def inner_product(edges: DataFrame, nodes: DataFrame, steps: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """th + epsilon * mean of the honest neighbours' (th - v); steps has th and v. Attackers without one have no row."""
    mean = honest_neighbours(edges, nodes, steps).groupBy(F.col("src").alias("node_id"), "c").agg(F.avg(F.col("th") - F.col("v")).alias("g"))
    return steps.select("node_id", "c", "th").join(mean, ["node_id", "c"]).select("node_id", "c", (F.col("th") + epsilon * F.col("g")).alias("v"))


def flipped_step(samples: DataFrame, shifts: DataFrame, theta: DataFrame, classes: int, alpha: float, reg: float) -> DataFrame:
    """node_id, c (class x d + coordinate), v: attackers' half steps on labels moved by their shift (node_id, shift); theta (node_id, cls, t)."""
    from .training import half_step

    own = shifts.select("node_id")
    moved = label_flip(samples.join(own, "node_id", "left_semi"), shifts, classes)
    return half_step(moved, theta.join(own, "node_id", "left_semi"), alpha, reg)


def attack(name: str, edges: DataFrame, nodes: DataFrame, steps: DataFrame, flips: DataFrame | None = None) -> DataFrame:
    """Messages after the attackers have spoken: theirs by the named attack, or their own where they abstain; unknown names raise.

    label_flip sends the steps that were taken on moved labels: flips (node_id, c, v), from ``flipped_step``.
    """
    kinds = {
        "label_flip": lambda: flips,
        "sign_flip": lambda: sign_flip(steps),
        "gaussian": lambda: gaussian(steps),
        "little_is_enough": lambda: little_is_enough(edges, nodes, steps),
        "inner_product": lambda: inner_product(edges, nodes, steps),
        "none": lambda: steps.select("node_id", "c", "v").limit(0),
    }
    if name not in kinds:
        raise ValueError(f"unknown attack {name!r}")
    if name == "label_flip" and flips is None:
        raise ValueError("label_flip needs the steps on moved labels")
    bad = kinds[name]().join(nodes.where("is_byz").select("node_id"), "node_id", "left_semi").withColumnRenamed("v", "bad")
    return steps.select("node_id", "c", "v").join(bad, ["node_id", "c"], "left").select("node_id", "c", F.coalesce("bad", "v").alias("v"))
