"""The classifier loop and the theory's constants against dense NumPy written from the formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmesh.operators import attacks, evaluate, experiment, features, graph, mixing, reporting, rounds, simulate, training
from driftmesh.operators.simulate import Config, Filter


def blobs(n=240, d=5, classes=3, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((classes, d)) * 2
    y = np.arange(n) % classes
    return centres[y] + rng.standard_normal((n, d)), y


@pytest.fixture(scope="module")
def samples(spark):
    x, y = blobs()
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "vec_id long, label int, x array<double>")


def theta_frame(spark, theta):
    return spark.createDataFrame([(i, c, theta[i][:, c].tolist()) for i in range(len(theta)) for c in range(theta.shape[2])], "node_id int, cls int, t array<double>")


def test_features_of_loop_and_tables_agree(spark):
    x, y = blobs(90)
    rng = np.random.default_rng(1)
    n, d, classes = 5, 5, 3
    owner = np.arange(len(y)) % n
    y = np.where((owner == 2) & (y == 1), 0, y)  # a shard without a class
    rows = spark.createDataFrame([(i, int(y[i]), int(owner[i]), x[i].tolist()) for i in range(len(y))], "vec_id long, label int, node_id int, x array<double>")
    before = rng.standard_normal((n, d, classes))
    near = [[1, 2, 3, 4], [0, 2, 3], [0, 1], [0, 1, 4], [0, 3]]
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in near[i]], "src int, dst int")
    grads = np.stack([simulate.softmax_gradient(x[owner == i], y[owner == i], before[i], 0.1)[1] for i in range(n)])
    after = before - 0.4 * grads
    own = training.gradient(rows, theta_frame(spark, before), 0.1)
    got = {(r.src, r.dst): r for r in features.edge_features(edges, rows, theta_frame(spark, before), theta_frame(spark, after), own, classes, 0.4, 0.1).collect()}
    for i in range(n):
        want = simulate.edge_rows(x[owner == i], y[owner == i], before[i], grads[i], after[near[i]], 0.4, 0.1)
        for j, row in zip(near[i], want, strict=True):
            assert np.allclose([got[i, j][f] for f in features.FEATURES], row, atol=1e-7), (i, j)
        assert len(near[i]) > 2 or (want[:, 5:8] == 0).all()
        for j, row in zip(near[i], want, strict=True):
            sv = np.linalg.svd(before[i] - after[j], compute_uv=False)
            assert row[3] == pytest.approx((sv**2).sum() / sv[0] ** 2)


def test_margin_sees_a_shift_of_labels():
    x, y = blobs(300)
    theta = np.zeros((5, 3))
    for shift, low in ((0, 0.0), (1, 0.3)):
        _, g = simulate.softmax_gradient(x, (y + shift) % 3, theta, 0.0)
        margin = simulate.edge_rows(x, y, theta, simulate.softmax_gradient(x, y, theta, 0.0)[1], (theta - 0.1 * g)[None], 0.1, 0.0)[0][2]
        assert margin >= low and (shift or margin < 1e-9)


def test_filtered_round_of_loop_and_tables_agree(spark):
    x, y = blobs()
    c = Config(n=8, b=2, rounds=3, batch=8, reg=0.1, graphs={"complete": {}, "random_regular": {"deg": 4}})
    s = simulate.State(c, "random_regular", 3, x, y, c.spread(0.2, 0.05), 2)
    rng = np.random.default_rng(5)
    before, sent = rng.standard_normal((2, 8, 5, 3))
    bad = {(i, j) for i in range(8) for j in s.near[i] if (i + j) % 3 == 0}
    after, seen, pull = simulate.filtered_round(s, lambda i, near, adv, hon: np.array([(i, j) in bad for j in near]), sent, before, 0.7, np.zeros(8, bool))
    long = lambda a, v: spark.createDataFrame([(i, k, float(z)) for i in range(8) for k, z in enumerate(a[i].ravel())], f"node_id int, c int, {v} double")
    w = spark.createDataFrame([(i, j, float(s.w[i, j])) for i in range(8) for j in [*s.near[i], i]], "src int, dst int, w double")
    flagged = spark.createDataFrame(sorted(bad), "src int, dst int")
    got = {}
    for r in mixing.filtered_projection(w, long(sent, "v"), long(before, "th"), flagged, 0.7).collect():
        got.setdefault(r.node_id, {})[r.c] = r.v
    for i in s.honest:
        assert np.allclose([got[i][k] for k in range(15)], after[i].ravel())
    nodes = spark.createDataFrame([(i, i in s.byz) for i in range(8)], "node_id int, is_byz boolean")
    pi = spark.createDataFrame([(i, float(p)) for i, p in zip(s.honest, s.pi, strict=True)], "node_id int, pi double")
    near = mixing.projected(w, long(sent, "v"), long(before, "th"), flagged, 0.7)
    assert rounds.attacker_pull(near, pi, nodes, long(before, "th")).head().rho2_k == pytest.approx(float(s.pi @ pull))
    weights_of_flags = sum(s.w[i, j] for i in s.honest for j in s.near[i] if (i, j) in bad and j in s.byz)
    assert seen[:, 4].sum() == pytest.approx(weights_of_flags)


def test_flipped_labels_by_the_dispatcher(spark):
    x, y = blobs(60)
    rows = spark.createDataFrame([(i, int(y[i]), i % 3, x[i].tolist()) for i in range(60)], "vec_id long, label int, node_id int, x array<double>")
    theta = np.random.default_rng(0).standard_normal((3, 5, 3))
    nodes = spark.createDataFrame([(0, False), (1, True), (2, False)], "node_id int, is_byz boolean")
    steps = training.half_step(rows, theta_frame(spark, theta), 0.3, 0.1)
    flips = attacks.flipped_step(rows, spark.createDataFrame([(1, 2)], "node_id int, shift int"), theta_frame(spark, theta), 3, 0.3, 0.1)
    got = {}
    for r in attacks.attack("label_flip", None, nodes, steps, flips).collect():
        got.setdefault(r.node_id, {})[r.c] = r.v
    for i in range(3):
        yy = (y[i::3] + 2 * (i == 1)) % 3
        want = theta[i] - 0.3 * simulate.softmax_gradient(x[i::3], yy, theta[i], 0.1)[1]
        assert np.allclose([got[i][k] for k in range(15)], want.T.ravel())
    with pytest.raises(ValueError):
        attacks.attack("label_flip", None, nodes, steps)


def test_mixing_constants(spark):
    near, w, byz, honest = simulate.create_graph("random_regular", 2, 10, 2, None, deg=4)
    gamma = np.linspace(0.05, 0.3, 10)
    target = (1 - gamma) / 10
    w = simulate.node_weights(near, target)
    assert np.allclose(target[:, None] * w, (target[:, None] * w).T) and np.allclose(w.sum(axis=1), 1)
    table = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(10) for j in range(10) if w[i, j] or i == j], "src int, dst int, w double")
    nodes = spark.createDataFrame([(i, i in byz, float(gamma[i]), float(target[i])) for i in range(10)], "node_id int, is_byz boolean, gamma double, pi double")
    pi = graph.stationary(nodes)
    got = graph.spectral(table, pi, nodes)
    p = np.full(8, 1 / 8)  # the target over (1 - gamma) is uniform
    wh = w[np.ix_(honest, honest)]
    g = gamma[honest]
    q = np.zeros((8, 8))
    for a in range(8):
        for c in range(8):
            e = np.zeros(8)
            e[a], e[c] = 1, -1
            q += (a != c) * p[a] * wh[a, c] ** 2 * g[a] * (1 - g[a]) * np.outer(e, e)
    nu2 = max(np.linalg.eigvals(np.diag(1 / p) @ q).real)
    bar = (1 - g)[:, None] * wh
    np.fill_diagonal(bar, 0)
    np.fill_diagonal(bar, 1 - bar.sum(axis=1))
    lam = np.sort(np.abs(np.linalg.eigvals(bar)))[-2]  # the second eigenvalue of a reversible chain
    off = w - np.diag(np.diag(w))
    gap = np.sort(np.linalg.eigvals(np.diag(off.sum(axis=1)) - off).real)[1]
    assert got == pytest.approx({"spectral_gap": gap, "lam_pi": lam, "nu2": nu2, "g": 1 - lam**2 - nu2}, abs=1e-9)
    bound = graph.nu_bound(table, pi, nodes).head().nu2_bound
    assert bound == pytest.approx(4 * (wh - np.diag(np.diag(wh))).max() * (g * (1 - g)).max()) and bound >= nu2
    assert rounds.bounds(spark.createDataFrame([(2.0, 0.5, float(nu2), float(lam), 0.8, 0.3, 1.5, 0.05, 0.25, 0.1, 0.2, 8.0, 30.0, 1 / 8, 0.0)], "L double, mu double, nu2 double, lam double, sigma_sq double, zeta_sq double, proj_const double, alpha double, db_max double, db_pi double, fnr double, h double, n_loc double, pi_max double, pi_dist_sq double")).head().alpha_max_conv == pytest.approx((1 - lam**2 - nu2) / 12)


def test_constants_at_the_optimum(spark, samples):
    x, y = blobs()
    x = np.column_stack([x, np.ones(len(x))])
    c = Config(n=6, b=1, rounds=4, reg=0.5, pi=(0.1, 0.3, 0.1, 0.2, 0.2, 0.1), heterogeneity=2.0)
    flt = Filter(np.linspace(0.1, 0.2, 6), np.linspace(0.05, 0.2, 6))
    got = simulate.constants("complete", 1, x, y, c, flt, 1.5)
    s = simulate.State(c, "complete", 1, x, y, flt.fpr, 1)
    rows = spark.createDataFrame([(int(k), int(y[k]), int(i), x[k].tolist()) for i in s.honest for k in s.shards[i]], "vec_id long, label int, node_id int, x array<double>")
    pi = spark.createDataFrame([(i, float(p)) for i, p in zip(s.honest, s.pi, strict=True)], "node_id int, pi double")
    model, _, f_star = training.local_optimum(rows, None, 0.5, 200)
    _, _, f_pi = training.local_optimum(rows, pi, 0.5, 200)
    assert (got["f_star"], got["f_pi_star"]) == pytest.approx((f_star, f_pi), rel=1e-3)
    every = spark.createDataFrame([(i,) for i in s.honest], "node_id int").crossJoin(model)
    assert got["sigma_sq"] == pytest.approx(training.variance_within(rows, every).head().sigma_sq, rel=1e-2)
    assert got["zeta_sq"] == pytest.approx(training.variance_between(training.gradient(rows, every, 0.0)).head().zeta_sq, rel=1e-2)
    assert got["L"] == pytest.approx(training.smoothness(rows, 0.5).head().L)
    assert got["epsilon"] == pytest.approx([a + b for a, b in zip(got["eps_opt"], got["eps_byz"], strict=True)]) and len(got["epsilon"]) == 6


def test_projection_constant():
    x, y = blobs()
    c = Config(n=5, b=1, rounds=3, reg=0.2, batch=4)
    s = simulate.State(c, "complete", 7, x, y, c.spread(c.fpr_mean, c.fpr_spread), 1)
    theta, out = np.zeros((5, 5, 3)), []
    for k, a in enumerate(c.alphas()):
        half = np.stack([theta[i] - a * simulate.softmax_gradient(*(v[simulate.stream("batch", 7, i, k).permutation(len(s.shards[i]))[:4]] for v in s.shard(i)), theta[i], 0.2)[1] for i in range(5)])
        out += [np.linalg.norm(half[j] - half[i]) / a for i in range(5) for j in s.near[i]]
        theta = np.einsum("ij,jdc->idc", s.w, half)
    assert simulate.projection_constant("complete", 7, x, y, c, 1) == pytest.approx(1.2 * np.quantile(out, 0.8))


def test_attackers_mix_what_was_sent():
    x, y = blobs()
    c = Config(n=6, b=2, rounds=2, reg=0.2, batch=8)
    s = simulate.State(c, "complete", 1, x, y, np.zeros(6), 2)
    held = []
    models = [theta.copy() for _, theta, _, _ in simulate.play(s, "sign_flip", "median", None, 1.0, lambda k, th, sent, g: held.append(sent))]
    for i in s.byz:
        assert np.allclose(models[0][i], np.einsum("j,jdc->dc", s.w[i], held[0]))
    with pytest.raises(ValueError):
        simulate.run_one("complete", "sign_flip", 0, "median", x, y, n=6, b=1, threat="T9")


def test_a_cycle(spark, samples, tmp_path):
    c = Config(n=8, b=2, rounds=6, batch=8, reg=0.1)
    names = experiment.experiments(Config(), Config())
    assert len(names) == 8 and names["permute_graphs"][2] and names["tm_0_baseline"][1].threat == "T0" and names["worst_case"][0].b == 8
    proj = experiment.projection_constants(spark, samples, ["complete"], c)
    edges = experiment.labelled_edges(spark, samples, proj, c, ("sign_flip", "gaussian")).cache()
    assert {r.split for r in edges.select("split").distinct().collect()} == set(simulate.SPLITS)
    assert {r.g for r in edges.select((F.col("grp") / 1000).cast("int").alias("g")).distinct().collect()} == {0, 1}
    # three rounds, six honest nodes of seven neighbours
    assert edges.where("split = 'train' AND atk_id = 0").count() == 3 * 6 * 7
    scaler = features.fit_scaler(edges.where("split = 'train'"))
    z = features.scale(edges, scaler)
    assert z.columns[-9:] == simulate.scaled_order()
    fitted = {"complete": experiment.fit(edges, proj["complete"], c, (1.0,), 2)}
    assert fitted["complete"].metrics["roc_auc"] > 0.8
    experiment.save(fitted, edges, str(tmp_path / "run"))
    back, again = experiment.restore(spark, str(tmp_path / "run"))
    assert back == fitted and again.count() == edges.count()
    # the exported model scores rows as the fitted one does
    train, order = z.where("split = 'train'"), simulate.scaled_order()
    model = evaluate.fit_logistic(train, order, 1.0)
    flt = back["complete"].filter()
    rows = edges.where("split = 'test'").limit(50)
    want = [r.score for r in model(features.scale(rows, scaler)).select("score").collect()]
    assert np.allclose(flt.scores(np.array([[r[f] for f in features.FEATURES] for r in rows.collect()])), want, atol=1e-5)
    out = experiment.run_cycle(spark, samples, c, c, ["complete"], ["sign_flip"], [1, 2], ("filtered", "oracle_0", "median"), grid=(1.0,))
    acc = {r.alg: r["mean"] for r in out["test_accuracy"].collect()}
    assert acc["oracle_0"] > 0.8 and acc["filtered"] > 0.6
    sim = out["sys_sim"]
    assert sim.count() == 3 * 6 and sim.where("alg = 'median' AND rho2_k IS NULL AND gamma_k IS NULL").count() == 6
    assert out["sys_metrics"].head().g < 1 and out["clf_metrics"].head().proj_const > 0


def test_curves_in_ranges_of_scores(spark):
    rng = np.random.default_rng(3)
    y, s = (rng.random(400) < 0.4).astype(int), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b), "x" if i % 3 else "y") for i, (a, b) in enumerate(zip(y, s, strict=True))], "y int, score double, g string")

    def brute(y, s):
        points = [(np.inf, 0, 0)] + [(t, int(((s >= t) & (y == 0)).sum()), int(((s >= t) & (y == 1)).sum())) for t in sorted(set(s), reverse=True)]
        keep = [k for k in range(len(points)) if k in (0, len(points) - 1) or any(points[k + 1][c] - 2 * points[k][c] + points[k - 1][c] for c in (1, 2))]
        return [points[k] for k in keep]

    n1, n0 = y.sum(), len(y) - y.sum()
    roc = evaluate.roc_curve(df).orderBy("idx").collect()
    assert [(r.threshold, round(r.fpr * n0), round(r.tpr * n1)) for r in roc] == brute(y, s) and [r.idx for r in roc] == list(range(len(roc)))
    won = sum((a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0])
    assert evaluate.auc(df).head().auc == pytest.approx(won / n1 / n0)
    for r in evaluate.roc_curve(df, "g").groupBy("g").count().collect():
        at = np.array([("x" if i % 3 else "y") == r.g for i in range(400)])
        assert r["count"] == len(brute(y[at], s[at]))
    got = reporting.numbered(df.withColumn("one", F.lit(1)), ["one"], ["score", "y", "g"], F.floor(F.col("score") * 5)).orderBy("k_").collect()
    assert [r.k_ for r in got] == list(range(400)) and [r.score for r in got] == sorted(s.tolist())
