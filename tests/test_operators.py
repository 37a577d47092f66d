"""Invariants of the operators, and the loop of whole runs against the DataFrame operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftmesh.functions import vectors as V
from driftmesh.operators import attacks, evaluate, features, graph, mixing, reporting, simulate, training
from driftmesh.plans import base
from driftmesh.sources import tables


def messages(spark, values):
    return spark.createDataFrame([(i, c, float(v)) for i, row in enumerate(values) for c, v in enumerate(row)], "node_id int, c int, v double")


def matrix(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r.node_id, {})[r.c] = r.v
    return np.array([[out[i][c] for c in sorted(out[i])] for i in range(n)])


@pytest.fixture(scope="module")
def ring(spark):
    return graph.as_edges(spark, {(i, (i + 1) % 6) if i < 5 else (0, 5) for i in range(6)} | {(0, 2), (1, 4), (2, 5)})


@pytest.mark.parametrize("rule", ["mean", "outlier_mean", "clipped", "trimmed", "median"])
def test_equal_messages_stay(spark, ring, rule):
    got = matrix(mixing.aggregate(rule, graph.mh_weights(ring), messages(spark, [[1.0, -2.0]] * 6), 1), 6)
    assert np.allclose(got, [[1.0, -2.0]] * 6)


@pytest.mark.parametrize("rule", ["mean", "outlier_mean", "clipped", "trimmed", "median"])
def test_loop_and_tables_agree(spark, ring, rule):
    x = np.random.default_rng(1).standard_normal((6, 5))
    w = np.zeros((6, 6))
    for r in graph.mh_weights(ring).collect():
        w[r.src, r.dst] = r.w
    near = [[j for j in range(6) if j != i and w[i, j] > 0] for i in range(6)]
    want = np.array([simulate.combine(rule, i, x, w, near[i], 1) for i in range(6)])
    assert np.allclose(matrix(mixing.aggregate(rule, graph.mh_weights(ring), messages(spark, x), 1), 6), want)


def test_unknown_names_raise(spark, ring):
    with pytest.raises(ValueError):
        mixing.aggregate("none such", ring, None)
    with pytest.raises(ValueError):
        attacks.attack("none such", ring, None, None)
    with pytest.raises(ValueError):
        graph.generate("barbell", 5)
    with pytest.raises(ValueError):
        evaluate.threshold_at(None, [0.1], "above")
    with pytest.raises(ValueError):
        graph.sample_until("erdos_renyi", 6, {0}, p=0.0, attempts=3)


def test_weights(spark, ring):
    pi = spark.createDataFrame([(i, (i + 1) / 21) for i in range(6)], "node_id int, pi double")
    got = graph.detailed_balance(graph.mh_weights_for(ring, pi), pi).head()
    assert got.max_gap < 1e-10 and got.max_row < 1e-10
    with pytest.raises(Exception, match="neighbour"):
        graph.mh_weights_for(ring, pi.union(spark.createDataFrame([(9, 0.1)], "node_id int, pi double"))).collect()


def test_projection(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    near, same = df.select(V.project("a", "b", 1.0).alias("p")).collect()
    assert np.allclose(near.p, [0.6, 0.8]) and same.p == [1.0, 1.0]


def test_connectivity(spark):
    edges = graph.as_edges(spark, {(0, 1), (1, 2), (3, 4)})
    keep = lambda ids: spark.createDataFrame([(i,) for i in ids], "node_id int")
    assert graph.is_connected(edges, keep([0, 1, 2])).head().connected
    assert not graph.is_connected(edges, keep([0, 1, 3])).head().connected
    for kind, kw in simulate.GRAPHS.items():
        assert graph.connected(graph.sample_until(kind, 20, {1, 2}, 3, **kw), set(range(20)) - {1, 2})


@pytest.mark.parametrize("m", [2, 3, 4, 5, 6, 7])
def test_left_out_median(spark, m):
    vals = [1.0, 5.0, 5.0, 2.0, -3.0, 7.0, 0.5][:m]
    df = spark.createDataFrame([(0, j, v) for j, v in enumerate(vals)], "src int, dst int, v double")
    for r in features.left_out_median(df, "v", ["src"]).collect():
        assert r.med == pytest.approx(np.median([v for j, v in enumerate(vals) if j != r.dst]))


def scored(spark, y, s):
    return spark.createDataFrame(list(zip(y, map(float, s), strict=True)), "y int, score double")


def test_curves(spark):
    assert evaluate.auc(scored(spark, [0, 0, 1, 1], [1, 1, 1, 1])).head().auc == 0.5
    assert evaluate.auc(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4])).head().auc == 1.0
    assert evaluate.average_precision(scored(spark, [0, 1, 1, 0], [0.9, 0.8, 0.7, 0.1])).head().avg_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    roc = evaluate.roc_curve(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4])).orderBy("idx").collect()
    assert [(r.fpr, r.tpr) for r in roc] == [(0, 0), (0, 1), (1, 1)] and roc[0].threshold == float("inf")
    op = evaluate.operating_point(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4])).head()
    assert (op.tau, op.fpr, op.fnr) == (0.3, 0, 0)


def test_ewma_matches_pandas(spark):
    v = np.random.default_rng(0).standard_normal(1500)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "grp int, k int, v double")
    got = [r.ewma for r in reporting.ewma(df, ["grp"], ["k"], "v", 40, block=128).orderBy("k").collect()]
    assert np.allclose(got, pd.Series(v).ewm(span=40).mean())


def test_shards_are_a_partition(spark, sf):
    shares = spark.createDataFrame([(c, n, 0.25) for c in range(10) for n in range(4)], "label int, node_id int, share double")
    dealt = training.class_cuts(tables.samples(spark, sf), shares)
    assert dealt.count() == dealt.select("vec_id").distinct().count() == tables.samples(spark, sf).count()


def test_pca_and_smoothness(spark, sf):
    x = tables.samples(spark, sf)
    a = np.stack(x.orderBy("vec_id").toPandas()["x"].to_numpy())
    z = np.stack(training.whitened_pca(x).orderBy("vec_id").toPandas()["z"].to_numpy())
    assert np.allclose(np.cov(z.T), np.eye(z.shape[1]), atol=1e-6)
    node = x.toPandas()
    want = max(np.linalg.eigvalsh(np.stack(g["x"].to_numpy()).T @ np.stack(g["x"].to_numpy()) / len(g))[-1] for _, g in node.groupby("node_id"))
    assert training.smoothness(x, 0.01).head().L == pytest.approx(0.01 + 0.5 * want)
    assert a.shape[1] >= z.shape[1]


def test_gradient_against_numpy(spark, sf):
    x = tables.samples(spark, sf).where("node_id < 3")
    rng = np.random.default_rng(2)
    theta = {i: rng.standard_normal((64, 10)) for i in range(3)}
    t = spark.createDataFrame([(i, c, theta[i][:, c].tolist()) for i in range(3) for c in range(10)], "node_id int, cls int, t array<double>")
    got = {(r.node_id, r.cls, r.c): r.g for r in training.gradient(x, t, 0.1).collect()}
    for i, g in x.toPandas().groupby("node_id"):
        loss, want = simulate.softmax_gradient(np.stack(g["x"].to_numpy()), g["label"].to_numpy(), theta[i], 0.1)
        assert np.allclose([[got[i, c, k] for c in range(10)] for k in range(64)], want)
        assert training.losses(x, t, 0.1).where(F.col("node_id") == int(i)).head().loss == pytest.approx(loss)


def test_runs_learn_and_filtering_helps(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 8)) * 2
    y = np.arange(400) % 4
    x = np.column_stack([centres[y] + rng.standard_normal((400, 8)), np.ones(400)])
    last = lambda attack, alg: simulate.run_one("complete", attack, 0, alg, x, y, rounds=12, n=8, b=2)[-1][5]
    assert last("none", "mean") > 0.85
    assert last("sign_flip", "oracle_0") > 0.85
    grid = reporting.grid(spark, graph=["complete"], attack=["gaussian"], seed=[0, 1], alg=["median"])
    samples = spark.createDataFrame([(i, int(c), v[:-1].tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "vec_id long, label int, x array<double>")
    assert simulate.simulate(grid, samples, rounds=3, n=8, b=2).count() == 6


def test_a_grid_of_runs_is_one_small_table_and_a_task_for_each_run(spark):
    grid = reporting.grid(spark, graph=["complete", "random_regular"], attack=["sign_flip"], seed=[0, 1], alg=["median", "filtered"])
    assert sorted(map(tuple, grid.collect())) == sorted((g, "sign_flip", s, a) for g in ("complete", "random_regular") for s in (0, 1) for a in ("median", "filtered"))
    assert grid.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    rng = np.random.default_rng(6)
    samples = spark.createDataFrame([(i, i % 3, rng.standard_normal(4).tolist()) for i in range(120)], "vec_id long, label int, x array<double>")
    got = simulate.simulate(grid, samples, rounds=2, n=8, b=2)
    assert got.rdd.getNumPartitions() == 8
    rows = samples.orderBy("vec_id").toPandas()
    x, y = np.column_stack([np.stack(rows["x"].to_numpy()), np.ones(120)]), rows["label"].to_numpy()
    want = {r[:5]: r[5:16] for g, a, s, alg in map(tuple, grid.collect()) for r in simulate.run_one(g, a, s, alg, x, y, rounds=2, n=8, b=2)}
    seen = {tuple(r)[:5]: tuple(r)[5:16] for r in got.collect()}
    assert seen.keys() == want.keys() and all(np.allclose(seen[k], want[k]) for k in want)
    s = simulate.State(simulate.Config(n=8, b=2, pi=tuple(np.arange(1, 9) / 36)), "complete", 0, x, y, np.zeros(8), 2)
    for pi, theta in zip((np.full(6, 1 / 6), s.pi), s.goals(), strict=True):
        assert np.abs(sum(p * simulate.softmax_gradient(*s.shard(i), theta, 0.01)[1] for p, i in zip(pi, s.honest, strict=True))).max() < 1e-9


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "graph string, k int, acc double")
    for name in ("one", "two"):
        tables.write_results(df, str(tmp_path / "csv"), name)
    back = tables.read_results(spark, str(tmp_path / "csv"), "graph string, k int, acc double")
    assert back.count() == 4 and back.where("acc IS NULL").count() == 2
    assert {r.experiment for r in back.select("experiment").collect()} == {"one", "two"}
    config = {"alpha": 0.5, "graph": {"n": 20}}
    tables.write_config(config, str(tmp_path / "config"), spark)
    assert tables.read_config(spark, str(tmp_path / "config")) == config
    calls = []
    make = lambda: calls.append(1) or df
    for c in (config, config, {"alpha": 0.1}):
        tables.cached(spark, str(tmp_path / "cache"), c, make).count()
    assert len(calls) == 2


def test_vector_text(spark):
    df = spark.createDataFrame([("[0.1  2.\n 3e-1]",), ("[]",)], "t string")
    assert [r.v for r in df.select(reporting.parse_vector(F.col("t")).alias("v")).collect()] == [[0.1, 2.0, 0.3], []]


def test_noise_is_standard_normal(spark):
    zero = spark.range(20_000).select((F.col("id") % 20).cast("int").alias("node_id"), F.floor(F.col("id") / 20).cast("int").alias("c"), F.lit(0.0).alias("v"))
    v = np.array([r.v for r in attacks.gaussian(zero).select("v").collect()])
    assert len(v) == 20_000 and abs(v.mean()) < 0.03 and abs(v.std() - 1) < 0.03 and abs((v**3).mean()) < 0.1 and abs((v**4).mean() - 3) < 0.25


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == base.N * 64
    assert set(entry.oracle_sql()) <= set(entry.queries())
