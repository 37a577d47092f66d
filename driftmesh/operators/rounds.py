"""Metrics of a round from models and edge decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus_distance(models: DataFrame, pi: DataFrame) -> DataFrame:
    """c_pi, c_unif: weighted squared distances of models (node_id, c, v) to their pi-mean."""
    own = models.join(pi, "node_id")
    mean = own.groupBy("c").agg((F.sum(F.col("pi") * F.col("v")) / F.sum("pi")).alias("mean"))
    d = own.join(mean, "c").groupBy("node_id").agg(F.first("pi").alias("pi"), F.sum((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("d2"))
    return d.agg(F.sum(F.col("pi") * F.col("d2")).alias("c_pi"), F.avg("d2").alias("c_unif"))


def optimality_gap(models: DataFrame, pi: DataFrame, goal: DataFrame) -> DataFrame:
    """opt_gap: distance of the pi-mean from the goal (c, v)."""
    mean = models.join(pi, "node_id").groupBy("c").agg((F.sum(F.col("pi") * F.col("v")) / F.sum("pi")).alias("mean"))
    return mean.join(goal.withColumnRenamed("v", "goal"), "c").agg(F.sqrt(F.sum((F.col("mean") - F.col("goal")) * (F.col("mean") - F.col("goal")))).alias("opt_gap"))


def edge_confusion(decisions: DataFrame) -> DataFrame:
    """node_id, counts and weights of right and wrong flags, and row_w, the weight of all neighbours: decisions (src, dst, flagged, is_adv, is_hon, w); an attacker that abstains is neither."""
    cases = {"tp": "flagged AND is_adv", "fp": "flagged AND is_hon", "tn": "NOT flagged AND is_hon", "fn": "NOT flagged AND is_adv"}
    counts = [F.count_if(F.expr(e)).alias(k) for k, e in cases.items()]
    mass = [F.sum(F.when(F.expr(e), F.col("w")).otherwise(0.0)).alias(f"{k}_w") for k, e in cases.items()]
    return decisions.groupBy(F.col("src").alias("node_id")).agg(*counts, *mass, F.sum("w").alias("row_w"))


def realized_rates(confused: DataFrame, pi: DataFrame, rates: DataFrame) -> DataFrame:
    """gamma_k, beta_k (pooled rates), byz_w_k, hon_w_k (what was missed, what was kept, in weight, at the nodes' own rates (node_id, fnr, fpr))."""
    j = confused.join(pi, "node_id").join(rates, "node_id")
    return j.agg(
        (F.sum("fp") / (F.sum("fp") + F.sum("tn") + 1e-12)).alias("gamma_k"),
        (F.sum("fn") / (F.sum("fn") + F.sum("tp") + 1e-12)).alias("beta_k"),
        F.sum(F.col("pi") * F.col("fn_w") * F.col("fnr")).alias("byz_w_k"),
        F.sum(F.col("pi") * (F.col("row_w") - F.col("fp_w")) * (1 - F.col("fpr"))).alias("hon_w_k"),
    )


def node_rates(confused: DataFrame) -> DataFrame:
    """node_id, gamma_k_node: each node's share of wrong flags among its honest neighbours."""
    return confused.select("node_id", (F.col("fp") / (F.col("fp") + F.col("tn") + 1e-12)).alias("gamma_k_node"))


def attacker_pull(near: DataFrame, pi: DataFrame, nodes: DataFrame, before: DataFrame) -> DataFrame:
    """rho2_k: sum of pi_i |sum over attackers j of w_ij (p_ij - x_i)|^2; near (src, dst, w, near) are the projected messages that were kept, before (node_id, c, th)."""
    bad = nodes.where("is_byz").select(F.col("node_id").alias("dst"))
    own = before.select(F.col("node_id").alias("src"), "c", "th")
    kept = near.where("w <> 0 AND src <> dst").join(bad, "dst", "left_semi").select("src", "w", F.posexplode("near").alias("c", "v"))
    pull = kept.join(own, ["src", "c"]).groupBy("src", "c").agg(F.sum(F.col("w") * (F.col("v") - F.col("th"))).alias("d"))
    return pull.groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("d") * F.col("d")).alias("d2")).join(pi, "node_id").agg(F.coalesce(F.sum(F.col("pi") * F.col("d2")), F.lit(0.0)).alias("rho2_k"))


def extremes(node_metrics: DataFrame) -> DataFrame:
    """mean, least and largest accuracy, least and largest loss over honest nodes (node_id, accuracy, loss)."""
    return node_metrics.agg(F.avg("accuracy").alias("mean_test_acc"), F.min("accuracy").alias("min_test_acc"), F.max("accuracy").alias("max_test_acc"), F.min("loss").alias("min_train_loss"), F.max("loss").alias("max_train_loss"))


def bounds(t: DataFrame) -> DataFrame:
    """Adds derived constants to rows of (L, mu, nu2, lam, sigma_sq, zeta_sq, proj_const, alpha, db_max, db_pi, fnr, h, n_loc, pi_max, pi_dist_sq).

    g is what mixing contracts; the step sizes are the largest that convergence and
    stability allow; eps_* bound the stability and opt_gap_ub the distance of the
    plain from the weighted optimum; the floor is what attackers leave. fnr is each
    node's own rate of missed attackers; pi_dist_sq is |pi - 1/h|^2.
    """
    L, mu, h, n, fnr = (F.col(c) for c in ("L", "mu", "h", "n_loc", "fnr"))
    g = 1 - (F.col("lam") * F.col("lam") + F.col("nu2"))
    tau = F.col("proj_const") * F.col("alpha")
    eps_opt = 8 * L * (1 + fnr * F.col("db_max")) / (mu * h * n)
    eps_byz = 8 * h * tau * fnr * F.col("db_pi") / (F.col("alpha") * mu * n)
    return t.withColumns({
        "s2": 1 - g,
        "g": g,
        "tau": tau,
        "alpha_max_conv": g / (6 * L),
        "alpha_max_stab": 2 / (mu + L),
        "eps_opt": eps_opt,
        "eps_byz": eps_byz,
        "epsilon": eps_opt + eps_byz,
        "byz_cons_floor": F.col("proj_const") * F.col("proj_const") * fnr * F.col("db_max") * F.col("db_max") / (mu * mu),
        "opt_gap_ub": 3 / (mu * mu) * (F.col("zeta_sq") * h * F.col("pi_dist_sq") + F.col("sigma_sq") / n * (1 / h + F.col("pi_max"))),
    })


def stability_series(rounds_: DataFrame, L: float, mu: float, h: int, m: int, proj_const: float, fpr: float, fnr: float, span: int = 40) -> DataFrame:
    """grp, k, bound: 4 h (x + y) / (mu m) smoothed over span rounds, x = L (1 - fpr) hon_w / h what honest neighbours add, y = proj_const m fnr byz_w what missed attackers add; rounds_ (grp, k, hon_w_k, byz_w_k)."""
    from .reporting import ewma

    x = L * (1 - fpr) * F.col("hon_w_k") / h
    y = proj_const * m * fnr * F.col("byz_w_k")
    return ewma(rounds_.withColumn("eps", 4 * h * (x + y) / (mu * m)), ["grp"], ["k"], "eps", span, "bound", coarse=F.floor(F.col("k") / 100_000)).select("grp", "k", "bound")
