"""Preprocessing, sharding, softmax regression steps and the constants of its objective."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def minmax_scale(coords: DataFrame, train: str = "split = 'train'") -> DataFrame:
    """Coordinates (.., split, c, v) scaled by the training rows' range; a constant column gives 0."""
    fit = coords.where(train).groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return coords.join(F.broadcast(fit), "c").withColumn("v", F.when(span == 0, 0.0).otherwise((F.col("v") - F.col("lo")) / span)).drop("lo", "hi")


def standard_scale(coords: DataFrame, train: str = "split = 'train'") -> DataFrame:
    """By the training rows' mean and population deviation; a constant column gives 0."""
    fit = coords.where(train).groupBy("c").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return coords.join(F.broadcast(fit), "c").withColumn("v", F.when(F.col("sd") == 0, 0.0).otherwise((F.col("v") - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def robust_scale(coords: DataFrame, train: str = "split = 'train'") -> DataFrame:
    """(v - median) / (interquartile range / 1.349...), the range of a unit normal."""
    unit = 1.3489795003921634
    fit = coords.where(train).groupBy("c").agg(F.percentile("v", F.lit(0.25)).alias("q1"), F.median("v").alias("q2"), F.percentile("v", F.lit(0.75)).alias("q3"))
    scale = (F.col("q3") - F.col("q1")) / unit
    return coords.join(F.broadcast(fit), "c").withColumn("v", (F.col("v") - F.col("q2")) / F.when(scale == 0, 1.0).otherwise(scale)).drop("q1", "q2", "q3")


def whitened_pca(samples: DataFrame, share: float = 0.93, key: str = "vec_id", vector: str = "x", train: str = "true") -> DataFrame:
    """key, z: projections on the components that explain ``share`` of the variance of the training rows, with unit variance there.

    Only sums of coordinates and of their products reach the driver, from slices
    of rows that are summed where they stand; the spectrum is found there.
    """
    one = samples.where(train).select(F.lit(0).alias("node_id"), F.concat(F.array(F.lit(1.0)), F.col(vector)).alias("x"))
    rows = sorted((r.i, r.s, r.n) for r in _outer(one, "x", "x").collect())
    d, n = int(round(len(rows) ** 0.5)), rows[0][2]
    gram = np.array([s for _, s, _ in rows]).reshape(d, d) / n
    mean = gram[0, 1:]
    cov = (gram[1:, 1:] - np.outer(mean, mean)) * n / max(1, n - 1)
    values, axes = np.linalg.eigh(cov)
    values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12)) + 1
    basis = axes[:, :k] / np.sqrt(values[:k] + 1e-300)
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(k)])
    basis *= signs

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_numpy()) - mean) @ basis))

    return samples.select(key, project(vector).alias("z"))


def with_bias(samples: DataFrame, vector: str = "x") -> DataFrame:
    return samples.withColumn(vector, F.concat(F.col(vector), F.array(F.lit(1.0))))


def class_cuts(samples: DataFrame, shares: DataFrame) -> DataFrame:
    """Samples dealt to nodes class by class: shares (label, node_id, share) become cuts of the class's samples in a fixed pseudo-random order."""
    order = Window.partitionBy("label").orderBy(F.pmod(F.col("vec_id") * 2654435761, F.lit(4294967296)), "vec_id")
    ranked = samples.drop("node_id").withColumn("rn", F.row_number().over(order) - 1)
    sizes = samples.groupBy("label").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("node_id")
    last = F.max("node_id").over(Window.partitionBy("label"))
    cut = F.floor(F.round(F.sum("share").over(before) * F.col("n"), 9))
    # the last node takes what truncation leaves
    cuts = shares.join(F.broadcast(sizes), "label").withColumn("hi", F.when(F.col("node_id") == last, F.col("n")).otherwise(cut)).withColumn("lo", F.coalesce(F.lag("hi").over(before), F.lit(0)))
    return ranked.join(F.broadcast(cuts.select("label", "node_id", "lo", "hi")), "label").where("lo <= rn AND rn < hi").drop("rn", "lo", "hi")


def minibatch(samples: DataFrame, size: int, k: int = 0) -> DataFrame:
    """At most ``size`` samples of each node, in an order that changes with the round k."""
    order = Window.partitionBy("node_id").orderBy(F.pmod((F.col("vec_id") + k * 7919) * 2654435761, F.lit(4294967296)), "vec_id")
    return samples.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= size).drop("rn")


def rates(steps: int, alpha: float = 0.5, decay: float = 0.25, tau: float = 1.0):
    """Columns over k: alpha / (1 + k decay), and the radius tau * alpha."""
    a = alpha / (1 + F.col("k") * decay)
    return a.alias("alpha"), (tau * a).alias("tau")


def heterogeneous(nodes: DataFrame, mean: float, spread: float, n: int) -> DataFrame:
    """node_id, rate: the mean plus spread * a line from -1 to 1 over the nodes, within [0, 0.95]."""
    line = F.lit(-1.0) + F.lit(2.0) * F.col("node_id") / (n - 1)
    return nodes.select("node_id", F.least(F.greatest(spread * line + mean, F.lit(0.0)), F.lit(0.95)).alias("rate"))


def drawn_pi(spark, n: int, concentration: float, seed: int = 12345) -> DataFrame:
    """node_id, pi: a draw from the symmetric Dirichlet distribution over the nodes."""
    drawn = np.random.default_rng(seed).dirichlet(np.full(n, concentration))
    return spark.createDataFrame([(i, float(p / drawn.sum())) for i, p in enumerate(drawn)], "node_id int, pi double")


def stacked(theta: DataFrame) -> DataFrame:
    """node_id, ts: the class vectors (node_id, cls, t) in the classes' order; classes are 0, 1, ..."""
    rows = F.sort_array(F.collect_list(F.struct("cls", "t")))
    return theta.groupBy("node_id").agg(F.transform(rows, lambda r: r["t"]).alias("ts"))


def scored(samples: DataFrame, theta: DataFrame) -> DataFrame:
    """The samples with z, p (arrays over the classes) and lse, by the stable log-sum-exp; a sample stays one row."""
    z = samples.join(stacked(theta), "node_id").withColumn("z", F.transform("ts", lambda t: V.dot("x", t))).drop("ts")
    top = F.array_max("z")
    z = z.withColumn("lse", top + F.log(F.aggregate(F.transform("z", lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)))
    return z.withColumn("p", F.transform("z", lambda v: F.exp(v - F.col("lse"))))


def residuals(samples: DataFrame, theta: DataFrame) -> DataFrame:
    """scored, with r = p - onehot(label)."""
    return scored(samples, theta).withColumn("r", F.transform("p", lambda v, i: v - (i == F.col("label")).cast("double")))


def _outer(rows: DataFrame, left: str, right: str) -> DataFrame:
    """node_id, i (position in left x size of right + position in right), s, n: sums over the node's rows of left x right; slices of rows are summed where they stand."""

    def part(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for node, own in b.groupby("node_id"):
                n, g = held.get(node, (0, 0.0))
                held[node] = (n + len(own), g + np.stack(own[left].to_numpy()).T @ np.stack(own[right].to_numpy()))
        yield pd.DataFrame([(int(k), n, g.ravel()) for k, (n, g) in held.items()], columns=["node_id", "n", "g"])

    parts = rows.select(F.col("node_id").cast("int"), left, *([right] if right != left else [])).mapInPandas(part, "node_id int, n long, g array<double>")
    return parts.select("node_id", "n", F.posexplode("g").alias("i", "g")).groupBy("node_id", "i").agg(F.sum("g").alias("s"), F.sum("n").alias("n"))


def gradient(samples: DataFrame, theta: DataFrame, reg: float = 0.01) -> DataFrame:
    """node_id, cls, c, g: mean of (p - onehot) x, plus reg * theta."""
    flat = theta.select("node_id", "cls", F.size("t").alias("d"), F.posexplode("t").alias("c", "tv")).withColumn("i", F.col("cls") * F.col("d") + F.col("c"))
    return _outer(residuals(samples, theta), "r", "x").join(flat, ["node_id", "i"]).select("node_id", "cls", "c", (F.col("s") / F.col("n") + reg * F.col("tv")).alias("g"))


def half_step(samples: DataFrame, theta: DataFrame, alpha: float, reg: float = 0.01) -> DataFrame:
    """node_id, c (class x d + coordinate), v, th: theta - alpha * gradient, and theta."""
    flat = theta.select("node_id", "cls", F.size("t").alias("d"), F.posexplode("t").alias("c", "th"))
    return gradient(samples, theta, reg).join(flat, ["node_id", "cls", "c"]).select("node_id", (F.col("cls") * F.col("d") + F.col("c")).alias("c"), (F.col("th") - alpha * F.col("g")).alias("v"), "th")


def losses(samples: DataFrame, theta: DataFrame, reg: float = 0.01) -> DataFrame:
    """node_id, loss (mean cross entropy plus half reg |theta|^2), accuracy (the first of equal scores counts)."""
    hit = (V.argmax(F.col("z")) == F.col("label")).cast("double")
    got = scored(samples, theta).groupBy("node_id").agg(F.avg(F.col("lse") - F.col("z")[F.col("label").cast("int")]).alias("ce"), F.avg(hit).alias("accuracy"))
    size = theta.groupBy("node_id").agg(F.sum(F.aggregate("t", F.lit(0.0), lambda s, x: s + x * x)).alias("sq"))
    return got.join(size, "node_id").select("node_id", (F.col("ce") + 0.5 * reg * F.col("sq")).alias("loss"), "accuracy")


def global_ce(samples: DataFrame, theta: DataFrame) -> DataFrame:
    """ce: mean cross entropy of all samples under one model (cls, t), without penalty."""
    got = scored(samples.drop("node_id").withColumn("node_id", F.lit(0)), theta.withColumn("node_id", F.lit(0)))
    return got.agg(F.avg(F.col("lse") - F.col("z")[F.col("label").cast("int")]).alias("ce"))


def averaged_model(theta: DataFrame, pi: DataFrame | None = None) -> DataFrame:
    """cls, t: the (weighted) mean of the nodes' class vectors."""
    w = theta.withColumn("pi", F.lit(1.0)) if pi is None else theta.join(pi.select("node_id", "pi"), "node_id")
    by = w.select("cls", "pi", F.posexplode("t").alias("c", "tv")).groupBy("cls", "c").agg((F.sum(F.col("pi") * F.col("tv")) / F.sum("pi")).alias("v"))
    return V.wide_form(by, "cls", out="t")


def accuracy_of(samples: DataFrame, model: DataFrame) -> DataFrame:
    """accuracy of one model (cls, t) on all samples."""
    got = scored(samples.drop("node_id").withColumn("node_id", F.lit(0)), model.withColumn("node_id", F.lit(0)))
    return got.agg(F.avg((V.argmax(F.col("z")) == F.col("label")).cast("double")).alias("accuracy"))


def variance_within(samples: DataFrame, theta: DataFrame) -> DataFrame:
    """sigma_sq: the largest over nodes of mean |sample gradient|^2 - |mean gradient|^2."""
    each = residuals(samples, theta)
    squares = each.groupBy("node_id").agg(F.avg(V.dot("r", "r") * V.dot("x", "x")).alias("mean_sq"))
    means = _outer(each, "r", "x").groupBy("node_id").agg(F.sum(F.col("s") / F.col("n") * F.col("s") / F.col("n")).alias("sq_mean"))
    return squares.join(means, "node_id").agg(F.max(F.col("mean_sq") - F.col("sq_mean")).alias("sigma_sq"))


def variance_between(grads: DataFrame, pi: DataFrame | None = None) -> DataFrame:
    """zeta_sq: (weighted) mean squared distance of nodes' gradients (node_id, cls, c, g) to their (weighted) mean."""
    w = grads.withColumn("pi", F.lit(1.0)) if pi is None else grads.join(F.broadcast(pi), "node_id")
    by = w.groupBy("cls", "c").agg((F.sum(F.col("pi") * F.col("g")) / F.sum("pi")).alias("mean"))
    terms = w.join(by, ["cls", "c"]).select("node_id", "pi", ((F.col("g") - F.col("mean")) * (F.col("g") - F.col("mean"))).alias("sq"))
    return terms.groupBy("node_id").agg(F.sum("sq").alias("sq"), F.first("pi").alias("pi")).agg((F.sum(F.col("pi") * F.col("sq")) / F.sum("pi")).alias("zeta_sq"))


def smoothness(samples: DataFrame, reg: float = 0.01) -> DataFrame:
    """L, mu: reg + half the largest eigenvalue of any node's mean Gram matrix; reg.

    A node's Gram matrix is summed over slices of its rows, so no node's rows meet in one task.
    """
    whole = _outer(samples, "x", "x")
    wide = whole.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("g")))).alias("gs")).select("node_id", F.transform("gs", lambda s: s["g"]).alias("g"))

    @F.pandas_udf("double")
    def top(g: pd.Series) -> pd.Series:
        return g.map(lambda v: float(np.linalg.eigvalsh(np.asarray(v).reshape(int(len(v) ** 0.5), -1))[-1]))

    return wide.select(top("g").alias("top")).agg((F.lit(reg) + 0.5 * F.max("top")).alias("L"), F.lit(reg).alias("mu"))


def mean_losses(node_losses: DataFrame, pi: DataFrame) -> DataFrame:
    """f_unif, f_pi: plain and weighted mean of nodes' losses (node_id, loss)."""
    return node_losses.join(F.broadcast(pi), "node_id").agg(F.avg("loss").alias("f_unif"), (F.sum(F.col("pi") * F.col("loss")) / F.sum("pi")).alias("f_pi"))


def local_optimum(samples: DataFrame, pi: DataFrame | None = None, reg: float = 0.01, rounds: int = 200) -> tuple[DataFrame, float, float]:
    """cls, t of the softmax regression without intercept that weighs the nodes of samples alike (or by pi); its objective; F*, its unweighted log loss plus half reg |theta|^2. Pass honest nodes' samples only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    sizes = samples.groupBy("node_id").agg(F.count("*").alias("n"))
    share = sizes.withColumn("pi", F.lit(1.0)) if pi is None else sizes.join(pi, "node_id")
    total = share.agg(F.sum("pi")).head()[0]
    # the library gives a constant column, such as the bias, no weight; a reflection, which changes no norm, leaves none constant
    turned = F.transform("x", lambda v: v - F.col("twice") / F.size("x"))
    rows = samples.join(share.select("node_id", (F.col("pi") / total / F.col("n")).alias("w")), "node_id").withColumn("twice", 2 * F.aggregate("x", F.lit(0.0), lambda t, v: t + v))
    rows = rows.select("label", "w", array_to_vector(turned).alias("features"))
    model = LogisticRegression(family="multinomial", labelCol="label", weightCol="w", fitIntercept=False, standardization=False, regParam=reg, maxIter=rounds, tol=1e-10).fit(rows)
    theta = model.coefficientMatrix.toArray()
    theta = theta - 2 * theta.mean(axis=1, keepdims=True)
    classes = samples.sparkSession.createDataFrame([(c, [float(v) for v in row]) for c, row in enumerate(theta)], "cls int, t array<double>")
    f_star = global_ce(samples, classes).head().ce + 0.5 * reg * float((theta * theta).sum())
    return classes, float(model.summary.objectiveHistory[-1]), float(f_star)


def capacity_partition(samples: DataFrame, shares: DataFrame, nodes: int) -> DataFrame:
    """Class cuts of at most equal room for each node: beyond it a node's samples (in a fixed order) are left out."""
    room = samples.count() // nodes
    order = Window.partitionBy("node_id").orderBy(F.pmod(F.col("vec_id") * 2246822519, F.lit(4294967296)), "vec_id")
    return class_cuts(samples, shares).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= room).drop("rn")
