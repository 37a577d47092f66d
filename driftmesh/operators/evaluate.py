"""Curves, thresholds and metrics of scored binary rows (y, score), optionally by group; models for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import reporting


def by_score(scored: DataFrame, *by: str) -> DataFrame:
    """by.., score, n_pos, n_neg: one row for each distinct score."""
    return scored.groupBy(*by, "score").agg(F.sum(F.col("y").cast("long")).alias("n_pos"), F.sum(1 - F.col("y").cast("long")).alias("n_neg"))


#: Ranges that scores are cut into, so that curves over all rows aren't one task.
RANGES = 32


def _cut(rows: DataFrame) -> DataFrame:
    """Adds part_, which rises with the score: how many of some approximate quantiles are below it."""
    marks = rows.approxQuantile("score", [i / RANGES for i in range(1, RANGES)], 0.01)
    return rows.withColumn("part_", F.size(F.filter(F.array(*[F.lit(float(m)) for m in sorted(set(marks))]).cast("array<double>"), lambda m: m < F.col("score"))))


def _running(scored: DataFrame, *by: str) -> DataFrame:
    """by.., score, n_pos, n_neg, part_; tp, fp at score >= the row's; the totals pos, neg. Distinct scores are summed first, then inside ranges of scores; the ranges' sums, a few rows for each group, are added."""
    rows = _cut(by_score(scored, *by))
    sums = rows.groupBy(*by, "part_").agg(F.sum("n_pos").alias("p_"), F.sum("n_neg").alias("q_"), F.max_by(F.struct("n_pos", "n_neg"), "score").alias("first_"))
    later = Window.partitionBy(*by).orderBy(F.col("part_").desc())
    over, whole = later.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero = F.lit(0).cast("long")
    # the range below's highest score follows on a range's lowest
    offsets = sums.select(*by, "part_", F.coalesce(F.sum("p_").over(over), zero).alias("p_"), F.coalesce(F.sum("q_").over(over), zero).alias("q_"), F.sum("p_").over(whole).alias("pos"), F.sum("q_").over(whole).alias("neg"), F.lead("first_").over(later).alias("follows_"))
    own = Window.partitionBy(*by, "part_").orderBy(F.col("score").desc())
    down = own.rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*by, "part_"])
    return joined.withColumns({"tp": F.col("p_") + F.sum("n_pos").over(down), "fp": F.col("q_") + F.sum("n_neg").over(down), "next_": F.coalesce(F.lead(F.struct("n_pos", "n_neg")).over(own), F.col("follows_"))}).drop("p_", "q_", "follows_")


def roc_curve(scored: DataFrame, *by: str, drop_collinear: bool = True) -> DataFrame:
    """by.., idx, threshold, fpr, tpr by falling thresholds; the first is +inf at (0, 0). Points on a straight line between their neighbours are dropped."""
    run = _running(scored, *by)
    if drop_collinear:
        # the step to a point and the one after it differ in either count; the last point stays
        run = run.where((F.col("next_").isNull()) | (F.col("next_.n_pos") != F.col("n_pos")) | (F.col("next_.n_neg") != F.col("n_neg")))
    run = run.select(*by, "part_", F.col("score").alias("threshold"), "fp", "tp", "pos", "neg")
    counts = run.groupBy(*by, "part_").agg(F.count("*").alias("n_"))
    later = Window.partitionBy(*by).orderBy(F.col("part_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "part_", F.coalesce(F.sum("n_").over(later), F.lit(0)).alias("before_"))
    place = F.row_number().over(Window.partitionBy(*by, "part_").orderBy(F.col("threshold").desc()))
    points = run.withColumn("place_", place).join(before, [*by, "part_"]).select(*by, (F.col("before_") + F.col("place_")).alias("idx"), "threshold", (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"))
    zero = F.lit(0.0)
    start = scored.groupBy(*by).agg(F.count("*").alias("n_")).where("n_ > 0").select(*by, F.lit(0).cast("long").alias("idx"), F.lit(float("inf")).alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
    return points.unionByName(start)


def auc(scored: DataFrame, *by: str) -> DataFrame:
    """by.., auc: pairs that are ranked rightly, ties by half; null with one class only."""
    rows = _running(scored, *by).withColumn("below", F.col("neg") - F.col("fp"))
    got = rows.groupBy(*by).agg(F.sum(F.col("n_pos") * (F.col("below") + F.col("n_neg") / 2)).alias("won"), F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"))
    return got.select(*by, (F.col("won") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """by.., avg_precision: sum over distinct scores of the step in recall times precision."""
    run = _running(scored, *by)
    return run.groupBy(*by).agg(F.sum(F.col("n_pos") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("avg_precision"))


def pr_curve(scored: DataFrame, *by: str) -> DataFrame:
    return _running(scored, *by).select(*by, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))


def operating_point(scored: DataFrame, cost_fp: float = 1.0, cost_fn: float = 1.0) -> DataFrame:
    """tau (within [0, 1]), fpr, fnr at the first ROC point of the least expected cost."""
    share = scored.agg(F.avg(F.col("y").cast("double")).alias("pi"))
    cost = F.col("pi") * cost_fn * (1 - F.col("tpr")) + (1 - F.col("pi")) * cost_fp * F.col("fpr")
    best = roc_curve(scored).crossJoin(F.broadcast(share)).withColumn("cost", F.round(cost, 12)).orderBy("cost", F.col("threshold").desc()).limit(1)
    return best.select(F.least(F.greatest("threshold", F.lit(0.0)), F.lit(1.0)).alias("tau"), "fpr", (1 - F.col("tpr")).alias("fnr"))


def threshold_at(scored: DataFrame, targets: list[float], mode: str = "below") -> DataFrame:
    """target, idx, threshold, fpr, tpr: the last ROC point with fpr <= target, or with ``nearest`` the closer of it and the next (the lower one if alike)."""
    if mode not in ("below", "nearest"):
        raise ValueError(f"unknown mode {mode!r}")
    roc = roc_curve(scored)
    spark = scored.sparkSession
    wanted = spark.createDataFrame([(float(t),) for t in targets], "target double")
    ahead = roc.select((F.col("idx") - 1).alias("idx"), F.struct("threshold", "fpr", "tpr").alias("next"))
    points = roc.select("idx", F.struct("threshold", "fpr", "tpr").alias("own")).join(ahead, "idx", "left")
    # an as-of join: one pass over the curve for each of the few targets, summed to one row
    below = points.join(F.broadcast(wanted), F.col("own.fpr") <= F.col("target")).groupBy("target").agg(F.max_by(F.struct("idx", "own", "next"), "idx").alias("at"))
    if mode == "below":
        return below.select("target", "at.idx", "at.own.threshold", "at.own.fpr", "at.own.tpr")
    later = F.col("at.next").isNotNull() & (F.col("at.next.fpr") - F.col("target") < F.col("target") - F.col("at.own.fpr"))
    at = F.when(later, F.col("at.next")).otherwise(F.col("at.own"))
    return below.withColumn("own", at).select("target", (F.col("at.idx") + later.cast("int")).alias("idx"), "own.threshold", "own.fpr", "own.tpr")


def confusion(scored: DataFrame, tau: float, *by: str) -> DataFrame:
    """Counts at score >= tau, prevalence, precision, recall, and the rates missed (fnr) and falsely flagged (fpr)."""
    hit, pos = F.col("score") >= tau, F.col("y") == 1
    c = scored.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(*by, "tp", "fp", "fn", "tn", safe(F.col("tp") + F.col("fn"), n).alias("prevalence"), safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("op_prec"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("op_rec"), safe(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"), safe(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def separability(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, separability: 2 auc - 1 of each raw feature."""
    long = rows.select("y", *[F.col(f).cast("double") for f in features]).unpivot("y", features, "feature", "score")
    return auc(long, "feature").select("feature", (2 * F.col("auc") - 1).alias("separability"))


def permuted(rows: DataFrame, feature: str, key: str, seed: int) -> DataFrame:
    """The rows with the feature's values dealt anew: the i-th by key gets the value of the i-th by a hash of key and seed.

    Positions are counted within hash blocks, so no order over all rows is needed.
    """
    block = F.pmod(F.xxhash64(key), F.lit(64))
    here = rows.withColumn("b_", block).withColumn("i_", F.row_number().over(Window.partitionBy("b_").orderBy(key)))
    there = rows.select(block.alias("b_"), key, F.col(feature).alias("dealt_")).withColumn("i_", F.row_number().over(Window.partitionBy("b_").orderBy(F.xxhash64(key, F.lit(seed)), key))).drop(key)
    return here.join(there, ["b_", "i_"]).withColumn(feature, F.col("dealt_")).drop("b_", "i_", "dealt_")


def permutation_importance(rows: DataFrame, features: list[str], model, key: str, repeats: int = 10) -> DataFrame:
    """feature, repeat, drop in average precision when the feature is permuted; model(df) adds ``score``, as the fitted models do."""
    base = average_precision(model(rows).select("y", "score")).select(F.col("avg_precision").alias("base"))
    parts = None
    for f in features:
        for r in range(repeats):
            part = model(permuted(rows, f, key, r)).select(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), "y", "score")
            parts = part if parts is None else parts.unionByName(part)
    return average_precision(parts, "feature", "repeat").crossJoin(F.broadcast(base)).select("feature", "repeat", (F.col("base") - F.col("avg_precision")).alias("drop"))


def fit_logistic(train: DataFrame, features: list[str], strength: float = 1.0):
    """Balanced logistic regression over the features; strength is the inverse penalty. Returns transform(df) with ``score``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.create_map(*[F.lit(x) for y, k in n.items() for x in (y, total / (len(n) * k))])[F.col("y")]
    ready = VectorAssembler(inputCols=features, outputCol="features_")
    model = LogisticRegression(featuresCol="features_", labelCol="y", weightCol="w_", standardization=False, regParam=1 / (strength * total), maxIter=200).fit(ready.transform(train.withColumn("w_", weight)))

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(ready.transform(df)).withColumn("score", vector_to_array("probability")[1]).drop("features_", "rawPrediction", "probability", "prediction")

    scored.coefficients, scored.intercept = model.coefficients.toArray(), float(model.intercept)
    return scored


def fit_trees(train: DataFrame, features: list[str], rounds: int = 30, depth: int = 4, rate: float = 0.1, seed: int = 0):
    """Boosted trees with classes of equal weight; transform(df) adds ``score``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ratio = n.get(0, 1) / max(1, n.get(1, 1))
    ready = VectorAssembler(inputCols=features, outputCol="features_")
    model = GBTClassifier(featuresCol="features_", labelCol="y", weightCol="w_", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(ready.transform(train.withColumn("w_", F.when(F.col("y") == 1, ratio).otherwise(1.0))))
    return lambda df: model.transform(ready.transform(df)).withColumn("score", vector_to_array("probability")[1]).drop("features_", "rawPrediction", "probability", "prediction")


def fit_network(train: DataFrame, features: list[str], layers: tuple[int, ...] = (64, 32), seed: int = 0, rounds: int = 100):
    """A multilayer perceptron; transform(df) adds ``score``."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=features, outputCol="features_")
    model = MultilayerPerceptronClassifier(featuresCol="features_", labelCol="y", layers=[len(features), *layers, 2], seed=seed, maxIter=rounds).fit(ready.transform(train))
    return lambda df: model.transform(ready.transform(df)).withColumn("score", vector_to_array("probability")[1]).drop("features_", "rawPrediction", "probability", "prediction")


def fit_kernel(train: DataFrame, features: list[str], gamma: float = 0.5, components: int = 24, strength: float = 1.0, key: str = "key"):
    """Balanced logistic regression over a landmark (Nystroem) approximation of the RBF kernel; landmarks are the rows of the smallest hashed keys."""
    import numpy as np

    marks = np.array([[float(r[f]) for f in features] for r in train.orderBy(F.xxhash64(key), key).limit(components).collect()])
    square = ((marks[:, None, :] - marks[None, :, :]) ** 2).sum(axis=2)
    values, axes = np.linalg.eigh(np.exp(-gamma * square))
    root = axes / np.sqrt(np.maximum(values, 1e-12)) @ axes.T
    m = len(marks)

    def mapped(df: DataFrame) -> DataFrame:
        k = [F.exp(-gamma * sum((F.col(f) - float(x)) * (F.col(f) - float(x)) for f, x in zip(features, row, strict=True))) for row in marks]
        with_k = df.withColumn("k_", F.array(*k))
        out = {f"z{j}_": F.aggregate(F.zip_with("k_", F.array(*[F.lit(float(v)) for v in root[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) for j in range(m)}
        return with_k.withColumns(out).drop("k_")

    names = [f"z{j}_" for j in range(m)]
    inner = fit_logistic(mapped(train), names, strength)
    return lambda df: inner(mapped(df)).drop(*names)


#: Models by name: fit(train, features) gives transform(df).
MODELS = {"linear": fit_logistic, "kernel": fit_kernel, "network": fit_network, "trees": fit_trees}


def search(rows: DataFrame, features: list[str], name: str, grid: list[dict], folds: int = 5, group: str = "grp") -> DataFrame:
    """setting (JSON), cv_ap: mean average precision over folds of whole groups."""
    import json

    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}")
    spark = rows.sparkSession
    # groups are dealt in turn, by their place among all groups: a row for each group, not for each sample
    places = reporting.numbered(rows.select(group).distinct().withColumn("all_", F.lit(0)), ["all_"], [group], F.pmod(F.xxhash64(group), F.lit(RANGES)), "place_").cache()
    k = min(folds, places.count())
    dealt = rows.join(places.select(group, F.pmod("place_", F.lit(k)).alias("fold_")), group).cache()
    out = []
    for setting in grid:
        got = []
        for fold in range(k):
            model = MODELS[name](dealt.where(F.col("fold_") != fold), features, **setting)
            got += [r.avg_precision for r in average_precision(model(dealt.where(F.col("fold_") == fold)).select("y", "score")).collect()]
        got = [x for x in got if x is not None]
        out.append((json.dumps(setting, sort_keys=True), sum(got) / max(1, len(got))))
    dealt.unpersist()
    return spark.createDataFrame(out, "setting string, cv_ap double")
