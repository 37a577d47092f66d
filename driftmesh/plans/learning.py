"""Queries of mixing, attacks, graph statistics, training steps and edge features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import attacks, evaluate, experiment, features, graph, mixing, rounds, simulate, training
from ..sources import tables
from . import base
from .base import coords, register, tidy

R = "round({}, 6) + 0.0e0 AS {}"
OUT = "SELECT node_id, c, round(v, 6) + 0.0e0 AS v FROM "


@register("dsgd_mix", OUT + "(SELECT w.src AS node_id, m.c, sum(w.w * m.v) AS v FROM w JOIN m ON m.node_id = w.dst GROUP BY 1, 2)")
def dsgd_mix(spark, sf):
    return coords(mixing.weighted_mean(base.weights(spark), base.messages(spark, sf)))


PROJECTED = """
d AS (SELECT *, sqrt(list_sum(list_transform(list_zip(own, other), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM {pairs}),
near AS (SELECT *, list_transform(list_zip(own, other), lambda p: p[1] + CASE WHEN dist > 0 THEN least(1.0e0, {tau} / dist) ELSE 0 END * (p[2] - p[1])) AS p FROM d)
"""


@register("proj_tau", "WITH " + PROJECTED.format(pairs="pairs", tau="0.15e0") + "SELECT src, dst, c, round(v, 6) + 0.0e0 AS v FROM (SELECT src, dst, CAST(unnest(range(len(p))) AS INTEGER) AS c, unnest(p) AS v FROM near)")
def proj_tau(spark, sf):
    both = mixing.pairs(base.weights(spark), base.messages(spark, sf))
    return both.select("src", "dst", F.posexplode(V.project("own", "other", 0.15)).alias("c", "v")).select("src", "dst", "c", tidy("v").alias("v"))


#: Each node's own rates; node 3 is an attacker that abstains.
RATES = "rt AS (SELECT node_id, {fnr} AS fnr, {fpr} AS fpr FROM n)"
FLAGGED = """
fl AS (SELECT g.src, g.dst FROM g JOIN n ON n.node_id = g.dst JOIN rt ON rt.node_id = g.src WHERE g.dst <> 3 AND CASE WHEN is_byz THEN u(g.src, g.dst) >= fnr ELSE u(g.src, g.dst) < fpr END),
kept AS (SELECT w.* FROM w ANTI JOIN fl ON fl.src = w.src AND fl.dst = w.dst WHERE w.src <> w.dst),
kw AS (SELECT src, dst, w FROM kept UNION ALL SELECT n.node_id, n.node_id, 1 - coalesce(sum(w), 0) FROM n LEFT JOIN kept ON kept.src = n.node_id GROUP BY n.node_id),
kp AS (SELECT kw.src, kw.dst, kw.w, a.t AS own, b.x AS other FROM kw JOIN wide a ON a.node_id = kw.src JOIN wide b ON b.node_id = kw.dst),
"""
DRAW = "(((g.src * 7919::BIGINT + g.dst * 104729::BIGINT + 1299709) * 48271) % 2147483647) / 2147483647.0e0"
OWN_RATES = ("0.1e0 + 0.01e0 * node_id", "0.005e0 * node_id")


def _near_sql(fnr: str, fpr: str) -> str:
    return "WITH " + RATES.format(fnr=fnr, fpr=fpr) + "," + FLAGGED.replace("u(g.src, g.dst)", DRAW) + PROJECTED.format(pairs="kp", tau="0.1e0")


def _filtered_sql(fnr: str, fpr: str) -> str:
    return _near_sql(fnr, fpr) + OUT + "(SELECT src AS node_id, c, sum(w * v) AS v FROM (SELECT src, w, CAST(unnest(range(len(p))) AS INTEGER) AS c, unnest(p) AS v FROM near) GROUP BY 1, 2)"


def _rates(spark, fnr, fpr):
    return base.nodes(spark).select("node_id", fnr.alias("fnr"), fpr.alias("fpr"))


def _own_rates(spark):
    return _rates(spark, 0.1 + 0.01 * F.col("node_id"), 0.005 * F.col("node_id"))


def _flags(spark, rates):
    return mixing.oracle_flags(base.edges(spark), base.nodes(spark), rates, base.nodes(spark).where("node_id = 3"))


def _before(spark, sf):
    return base.models(spark, sf).select("node_id", "c", "th")


def _filtered(spark, sf, rates):
    return coords(mixing.filtered_projection(base.weights(spark), base.messages(spark, sf), _before(spark, sf), _flags(spark, rates), 0.1))


@register("rdsgd_mix", _filtered_sql(*OWN_RATES))
def rdsgd_mix(spark, sf):
    return _filtered(spark, sf, _own_rates(spark))


@register("oracle_perfect", _filtered_sql("0.0e0", "0.0e0"))
def oracle_perfect(spark, sf):
    return _filtered(spark, sf, _rates(spark, F.lit(0.0), F.lit(0.0)))


@register("oracle_blind", _filtered_sql("1.0e0", "0.0e0"))
def oracle_blind(spark, sf):
    return _filtered(spark, sf, _rates(spark, F.lit(1.0), F.lit(0.0)))


def _ios_round(i: int, before: str) -> str:
    return f"""
i{i} AS (SELECT t.src, t.dst, t.w, m.c, m.v FROM {before} t JOIN m ON m.node_id = t.dst),
a{i} AS (SELECT src, c, sum(w * v) / sum(w) AS mean FROM i{i} GROUP BY src, c),
f{i} AS (SELECT i.src, i.dst, i.w, sum((v - mean) * (v - mean)) AS d2 FROM i{i} i JOIN a{i} a ON a.src = i.src AND a.c = i.c GROUP BY i.src, i.dst, i.w),
t{i} AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN src = dst THEN 1 ELSE 0 END, d2 DESC, dst) AS r FROM f{i}) WHERE r > 1 OR src = dst)"""


@register("ios_select", "WITH " + _ios_round(1, "w") + "," + _ios_round(2, "t1") + " " + OUT + "(SELECT t.src AS node_id, m.c, sum(t.w * m.v) / sum(t.w) AS v FROM t2 t JOIN m ON m.node_id = t.dst GROUP BY 1, 2)")
def ios_select(spark, sf):
    return coords(mixing.aggregate("outlier_mean", base.weights(spark), base.messages(spark, sf), 2))


@register("scc_clip", """WITH
d AS (SELECT *, sqrt(list_sum(list_transform(list_zip(own, other), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM pairs WHERE src <> dst),
mv AS (SELECT src, CAST(unnest(range(len(own))) AS INTEGER) AS c, unnest(list_transform(list_zip(own, other), lambda p: CASE WHEN dist > 0.1e0 THEN 0.1e0 / dist ELSE 1 END * w * (p[2] - p[1]))) AS v FROM d),
sm AS (SELECT src, c, sum(v) AS v FROM mv GROUP BY src, c)
SELECT m.node_id, m.c, round(m.v + coalesce(sm.v, 0), 6) + 0.0e0 AS v FROM m LEFT JOIN sm ON sm.src = m.node_id AND sm.c = m.c""")
def scc_clip(spark, sf):
    return coords(mixing.clipped(base.weights(spark), base.messages(spark, sf), 0.1))


@register("trimmed_mean", """WITH
r AS (SELECT g.src, m.c, m.v, row_number() OVER (PARTITION BY g.src, m.c ORDER BY m.v) AS rn, count(*) OVER (PARTITION BY g.src, m.c) AS k FROM g JOIN m ON m.node_id = g.dst),
q AS (SELECT *, least(1, (k - 1) // 2) AS q FROM r),
t AS (SELECT src, c, avg(v) AS mean, 1.0e0 / (any_value(k) + 1 - 2 * any_value(q)) AS r FROM q WHERE rn > q AND rn <= k - q GROUP BY src, c)
SELECT m.node_id, m.c, round((1 - t.r) * t.mean + t.r * m.v, 6) + 0.0e0 AS v FROM m JOIN t ON t.src = m.node_id AND t.c = m.c""")
def trimmed_mean(spark, sf):
    return coords(mixing.trimmed(base.edges(spark), base.messages(spark, sf), 1))


@register("coord_median", """WITH
t AS (SELECT g.src, m.c, median(m.v) AS med FROM g JOIN m ON m.node_id = g.dst GROUP BY 1, 2)
SELECT m.node_id, m.c, round((1 - w.w) * t.med + w.w * m.v, 6) + 0.0e0 AS v FROM m JOIN t ON t.src = m.node_id AND t.c = m.c JOIN w ON w.src = m.node_id AND w.dst = m.node_id""")
def coord_median(spark, sf):
    return coords(mixing.coordinate_median(base.weights(spark), base.messages(spark, sf)))


@register("proj_const_quantile", "SELECT round(1.2e0 * quantile_cont(sqrt(list_sum(list_transform(list_zip(own, other), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) / 0.5e0, 0.8), 6) + 0.0e0 AS proj_const FROM pairs WHERE src <> dst")
def proj_const_quantile(spark, sf):
    return mixing.spread_constant(base.edges(spark), base.messages(spark, sf), 0.5).select(tidy("proj_const").alias("proj_const"))


@register("trim_count", "SELECT CAST(ceil(avg(k)) AS INTEGER) AS q FROM (SELECT n.node_id, count(b.node_id) AS k FROM n LEFT JOIN g ON g.src = n.node_id LEFT JOIN n b ON b.node_id = g.dst AND b.is_byz WHERE NOT n.is_byz GROUP BY 1)")
def trim_count(spark, sf):
    return graph.trim_count(base.edges(spark), base.nodes(spark))


# ---- attacks ----

@register("sign_flip_step", "SELECT node_id, c, round(th + (th - v), 6) + 0.0e0 AS v FROM m")
def sign_flip_step(spark, sf):
    return coords(attacks.sign_flip(base.models(spark, sf)))


@register("label_flip_shift", "SELECT vec_id, s.node_id, CAST((label + CASE WHEN is_byz THEN 1 + s.node_id % 9 ELSE 0 END) % 10 AS INTEGER) AS label FROM s JOIN n ON n.node_id = s.node_id")
def label_flip_shift(spark, sf):
    shifts = base.nodes(spark).where("is_byz").select("node_id", (1 + F.col("node_id") % 9).alias("shift"))
    return attacks.label_flip(base.frame(spark, sf), shifts, 10).select("vec_id", "node_id", "label")


@register("gaussian_msg")
def gaussian_msg(spark, sf):
    return coords(attacks.gaussian(base.messages(spark, sf)))


#: Normal quantiles of (n - m - s) / (n - m), s = n // 2 + 1 - m, from tables, for the degrees here.
Z_VALUES = "(6, 1, -0.2533471031357997::DOUBLE), (8, 1, -0.18001236979270496::DOUBLE)"


HONEST = """
hn AS (SELECT g.src, g.dst FROM g JOIN n a ON a.node_id = g.src AND a.is_byz JOIN n b ON b.node_id = g.dst AND NOT b.is_byz),
nm AS (SELECT g.src, count(*) + 1 AS n, count(*) FILTER (WHERE b.is_byz) + 1 AS m FROM g JOIN n b ON b.node_id = g.dst GROUP BY g.src)"""


@register("alie_msg", f"""WITH zt(n, m, z) AS (VALUES {Z_VALUES}), {HONEST}
SELECT hn.src AS node_id, m.c, round(avg(m.v) - any_value(z) * stddev_samp(m.v), 6) + 0.0e0 AS v FROM hn JOIN m ON m.node_id = hn.dst JOIN nm ON nm.src = hn.src JOIN zt ON zt.n = nm.n AND zt.m = nm.m GROUP BY 1, 2 HAVING count(*) >= 2""")
def alie_msg(spark, sf):
    return coords(attacks.little_is_enough(base.edges(spark), base.nodes(spark), base.messages(spark, sf)))


@register("ipm_msg", f"""WITH {HONEST},
a AS (SELECT hn.src, m.c, avg(m.th - m.v) AS g FROM hn JOIN m ON m.node_id = hn.dst GROUP BY 1, 2)
SELECT m.node_id, m.c, round(m.th + 0.5e0 * a.g, 6) + 0.0e0 AS v FROM m JOIN a ON a.src = m.node_id AND a.c = m.c""")
def ipm_msg(spark, sf):
    return coords(attacks.inner_product(base.edges(spark), base.nodes(spark), base.models(spark, sf)))


@register("alie_z", f"""WITH zt(n, m, z) AS (VALUES {Z_VALUES}), {HONEST}
SELECT nm.src AS node_id, nm.n, nm.m, round(z, 6) + 0.0e0 AS z FROM nm JOIN zt ON zt.n = nm.n AND zt.m = nm.m JOIN n ON n.node_id = nm.src AND n.is_byz""")
def alie_z(spark, sf):
    rows = [(i, int(n), int(m), round(z, 6) + 0.0) for i, n, m, z in attacks.z_table(base.edges(spark), base.nodes(spark))]
    return spark.createDataFrame(rows, "node_id int, n long, m long, z double")


@register("attacked_median", f"""WITH {HONEST},
a AS (SELECT hn.src, m.c, avg(m.th - m.v) AS g FROM hn JOIN m ON m.node_id = hn.dst GROUP BY 1, 2),
x AS (SELECT m.node_id, m.c, CASE WHEN is_byz AND a.g IS NOT NULL THEN m.th + 0.5e0 * a.g ELSE m.v END AS v FROM m JOIN n ON n.node_id = m.node_id LEFT JOIN a ON a.src = m.node_id AND a.c = m.c),
t AS (SELECT g.src, x.c, median(x.v) AS med FROM g JOIN x ON x.node_id = g.dst GROUP BY 1, 2)
SELECT x.node_id, x.c, round((1 - w.w) * t.med + w.w * x.v, 6) + 0.0e0 AS v FROM x JOIN t ON t.src = x.node_id AND t.c = x.c JOIN w ON w.src = x.node_id AND w.dst = x.node_id""")
def attacked_median(spark, sf):
    sent = attacks.attack("inner_product", base.edges(spark), base.nodes(spark), base.models(spark, sf))
    return coords(mixing.aggregate("median", base.weights(spark), sent))


@register("abstain_mask", """WITH k AS (SELECT a.node_id, count(b.node_id) AS n_honest FROM n a LEFT JOIN g ON g.src = a.node_id LEFT JOIN n b ON b.node_id = g.dst AND NOT b.is_byz WHERE a.is_byz GROUP BY 1)
SELECT attack, node_id, n_honest, n_honest < need AS abstain FROM k CROSS JOIN (VALUES ('inner_product', 1), ('little_is_enough', 2), ('sign_flip', 0)) v(attack, need)""")
def abstain_mask(spark, sf):
    return graph.abstainers(base.edges(spark), base.nodes(spark), {"inner_product": 1, "little_is_enough": 2, "sign_flip": 0})


# ---- graph ----

@register("mh_weights", "SELECT src, dst, round(w, 6) + 0.0e0 AS w FROM w")
def mh_weights(spark, sf):
    return base.weights(spark).select("src", "dst", tidy("w").alias("w"))


def _pi(spark):
    return base.nodes(spark).select("node_id", ((F.col("node_id") + 1) / 210.0).alias("pi"))


@register("mh_gen_weights", """WITH p AS (SELECT node_id, (node_id + 1) / 210.0e0 AS pi FROM n),
o AS (SELECT g.src, g.dst, least(1.0e0, (b.pi / e2.d) / (a.pi / e1.d)) / e1.d AS w FROM g JOIN deg e1 ON e1.src = g.src JOIN deg e2 ON e2.src = g.dst JOIN p a ON a.node_id = g.src JOIN p b ON b.node_id = g.dst)
SELECT src, dst, round(w, 6) + 0.0e0 AS w FROM (SELECT * FROM o UNION ALL SELECT src, src, 1 - sum(w) FROM o GROUP BY src)""")
def mh_gen_weights(spark, sf):
    return graph.mh_weights_for(base.edges(spark), _pi(spark)).select("src", "dst", tidy("w").alias("w"))


@register("gen_weights_balance")
def gen_weights_balance(spark, sf):
    got = graph.detailed_balance(graph.mh_weights_for(base.edges(spark), _pi(spark)), _pi(spark))
    return got.select(tidy("max_gap").alias("max_gap"), tidy("max_row").alias("max_row"))


@register("honest_connected", """WITH h AS (SELECT node_id FROM n WHERE NOT is_byz),
reach(node_id) AS (SELECT min(node_id) FROM h UNION SELECT g.dst FROM reach r JOIN g ON g.src = r.node_id JOIN h ON h.node_id = g.dst)
SELECT (SELECT count(*) FROM h) AS n_nodes, count(*) AS n_reached, count(*) = (SELECT count(*) FROM h) AS connected FROM reach""")
def honest_connected(spark, sf):
    return graph.is_connected(base.edges(spark), base.nodes(spark).where("NOT is_byz"))


@register("byz_edge_mass", """SELECT a.node_id, round(coalesce(sum(w0.w) FILTER (WHERE b.is_byz), 0), 6) + 0.0e0 AS byz_mass, round(coalesce(sum(w0.w) FILTER (WHERE NOT b.is_byz), 0), 6) + 0.0e0 AS hon_mass
FROM n a LEFT JOIN w0 ON w0.src = a.node_id LEFT JOIN n b ON b.node_id = w0.dst WHERE NOT a.is_byz GROUP BY 1""")
def byz_edge_mass(spark, sf):
    got = graph.attacker_mass(base.weights(spark), base.nodes(spark))
    return got.select("node_id", tidy("byz_mass").alias("byz_mass"), tidy("hon_mass").alias("hon_mass"))


GAMMA = "gn AS (SELECT *, least(greatest(0.05e0 * (-1 + 2.0e0 * node_id / 19) + 0.06e0, 0), 0.95e0) AS gamma, 0.05e0 AS pi FROM n)"


def _rated(spark):
    rate = training.heterogeneous(base.nodes(spark), 0.06, 0.05, base.N).withColumnRenamed("rate", "gamma")
    return base.nodes(spark).join(rate, "node_id").withColumn("pi", F.lit(0.05))


MIXING = GAMMA + """,
hm AS (SELECT w0.src, w0.dst, (1 - a.gamma) * w0.w AS w FROM w0 JOIN gn a ON a.node_id = w0.src AND NOT a.is_byz JOIN gn b ON b.node_id = w0.dst AND NOT b.is_byz),
st AS (SELECT node_id, (pi / (1 - gamma)) / sum(pi / (1 - gamma)) OVER () AS pi FROM gn WHERE NOT is_byz),
qe AS (SELECT w0.src, w0.dst, st.pi * w0.w * w0.w * a.gamma * (1 - a.gamma) AS q FROM w0 JOIN gn a ON a.node_id = w0.src AND NOT a.is_byz JOIN gn b ON b.node_id = w0.dst AND NOT b.is_byz JOIN st ON st.node_id = w0.src)"""


@register("effective_mixing", f"WITH {MIXING} SELECT src, dst, round(w, 6) + 0.0e0 AS w FROM (SELECT * FROM hm UNION ALL SELECT src, src, 1 - sum(w) FROM hm GROUP BY src)")
def effective_mixing(spark, sf):
    return graph.effective_mixing(base.weights(spark), _rated(spark)).select("src", "dst", tidy("w").alias("w"))


@register("stationary_pi", f"WITH {MIXING} SELECT node_id, round(pi, 6) + 0.0e0 AS pi FROM st")
def stationary_pi(spark, sf):
    return graph.stationary(_rated(spark)).select("node_id", tidy("pi").alias("pi"))


@register("nu_bound", f"""WITH {MIXING} SELECT round(4 * (SELECT max(pi) / min(pi) FROM st) * max(w0.w) * (SELECT max(gamma * (1 - gamma)) FROM gn WHERE NOT is_byz), 6) + 0.0e0 AS nu2_bound
FROM w0 JOIN n a ON a.node_id = w0.src AND NOT a.is_byz JOIN n b ON b.node_id = w0.dst AND NOT b.is_byz""")
def nu_bound(spark, sf):
    rated = _rated(spark)
    return graph.nu_bound(base.weights(spark), graph.stationary(rated), rated).select(tidy("nu2_bound").alias("nu2_bound"))


@register("spectral_metrics")
def spectral_metrics(spark, sf):
    rated = _rated(spark)
    got = graph.spectral(base.weights(spark), graph.stationary(rated), rated)
    return spark.createDataFrame([tuple(round(v, 6) for v in got.values())], ", ".join(f"{k} double" for k in got))


@register("het_rates", f"WITH {GAMMA} SELECT node_id, round(gamma, 6) + 0.0e0 AS rate FROM gn")
def het_rates(spark, sf):
    return training.heterogeneous(base.nodes(spark), 0.06, 0.05, base.N).select("node_id", tidy("rate").alias("rate"))


@register("er_edges", "SELECT src, dst FROM g")
def er_edges(spark, sf):
    return base.edges(spark)


@register("sampled_graphs")
def sampled_graphs(spark, sf):
    rows = [(kind, a, b) for kind, kw in simulate.GRAPHS.items() for a, b in sorted(graph.sample_until(kind, base.N, {3, 10, 17}, 5, **kw))]
    return spark.createDataFrame(rows, "graph string, src int, dst int")


@register("topology_study")
def topology_study(spark, sf):
    from ..operators import reporting

    return reporting.means(simulate.topology(spark, sorted(simulate.GRAPHS), 10), ["graph"], ["db_max", "dh_max", "spectral_gap", "lam_pi", "nu2", "g"])


# ---- training ----

@register("train_test_split", "SELECT vec_id, CASE WHEN (vec_id * 40503 + 12345) % 1000 < 330 THEN 'test' ELSE 'train' END AS split FROM s")
def train_test_split(spark, sf):
    return tables.split(base.frame(spark, sf)).select("vec_id", "split")


SPLIT = "sp AS (SELECT *, (vec_id * 40503 + 12345) % 1000 >= 330 AS is_train FROM e)"


def _split_coords(spark, sf):
    return tables.split(base.frame(spark, sf)).select("vec_id", "split", F.posexplode("x").alias("c", "v"))


@register("minmax_scale", f"WITH {SPLIT}, f AS (SELECT c, min(v) AS lo, max(v) AS hi FROM sp WHERE is_train GROUP BY c) SELECT vec_id, sp.c, round(CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END, 6) + 0.0e0 AS v FROM sp JOIN f ON f.c = sp.c")
def minmax_scale(spark, sf):
    return training.minmax_scale(_split_coords(spark, sf)).select("vec_id", "c", tidy("v").alias("v"))


@register("standard_scale", f"WITH {SPLIT}, f AS (SELECT c, avg(v) AS a, stddev_pop(v) AS sd FROM sp WHERE is_train GROUP BY c) SELECT vec_id, sp.c, round(CASE WHEN sd = 0 THEN 0 ELSE (v - a) / sd END, 6) + 0.0e0 AS v FROM sp JOIN f ON f.c = sp.c")
def standard_scale(spark, sf):
    return training.standard_scale(_split_coords(spark, sf)).select("vec_id", "c", tidy("v").alias("v"))


@register("robust_scale", f"WITH {SPLIT}, f AS (SELECT c, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM sp WHERE is_train GROUP BY c) SELECT vec_id, sp.c, round((v - q2) / CASE WHEN q3 = q1 THEN 1 ELSE (q3 - q1) / 1.3489795003921634e0 END, 6) + 0.0e0 AS v FROM sp JOIN f ON f.c = sp.c")
def robust_scale(spark, sf):
    return training.robust_scale(_split_coords(spark, sf)).select("vec_id", "c", tidy("v").alias("v"))


@register("whitened_pca")
def whitened_pca(spark, sf):
    rows = tables.split(base.frame(spark, sf))
    got = training.whitened_pca(rows, train="split = 'train'").join(rows.where("split = 'train'").select("vec_id"), "vec_id").select("vec_id", F.posexplode("z").alias("j", "z"))
    return got.groupBy("j").agg(tidy(F.avg("z")).alias("mean"), tidy(F.var_samp("z")).alias("variance"))


@register("bias_augment", "SELECT vec_id, len(x) + 1 AS d, round(list_sum(x) + 1, 6) + 0.0e0 AS total FROM s")
def bias_augment(spark, sf):
    x = training.with_bias(base.frame(spark, sf))
    return x.select("vec_id", F.size("x").cast("long").alias("d"), tidy(F.aggregate("x", F.lit(0.0), lambda t, v: t + v)).alias("total"))


SHARES = "sh AS (SELECT CAST(l.range AS INTEGER) AS label, CAST(k.range AS INTEGER) AS node_id, (1 + (l.range * 7 + k.range * 13) % 5) AS wt FROM range(10) l CROSS JOIN range(20) k), ps AS (SELECT label, node_id, wt / CAST(sum(wt) OVER (PARTITION BY label) AS DOUBLE) AS share FROM sh)"


@register("dirichlet_shard", f"""WITH {SHARES},
rk AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) - 1 AS rn FROM s),
sz AS (SELECT label, count(*) AS k FROM s GROUP BY label),
ct AS (SELECT ps.label, node_id, CASE WHEN node_id = 19 THEN k ELSE floor(round(sum(share) OVER (PARTITION BY ps.label ORDER BY node_id) * k, 9)) END AS hi FROM ps JOIN sz ON sz.label = ps.label),
cl AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY label ORDER BY node_id), 0) AS lo FROM ct)
SELECT vec_id, rk.label, node_id FROM rk JOIN cl ON cl.label = rk.label AND lo <= rn AND rn < hi""")
def dirichlet_shard(spark, sf):
    wt = 1 + (F.col("label") * 7 + F.col("node_id") * 13) % 5
    grid = spark.range(10).select(F.col("id").cast("int").alias("label")).crossJoin(spark.range(20).select(F.col("id").cast("int").alias("node_id"))).withColumn("wt", wt)
    total = grid.groupBy("label").agg(F.sum("wt").alias("t"))
    shares = grid.join(F.broadcast(total), "label").select("label", "node_id", (F.col("wt") / F.col("t")).alias("share"))
    return training.class_cuts(base.frame(spark, sf), shares).select("vec_id", "label", "node_id")


@register("minibatch", "SELECT node_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ((vec_id + 3 * 7919) * 2654435761) % 4294967296, vec_id) AS r FROM s) WHERE r <= 10")
def minibatch(spark, sf):
    return training.minibatch(base.frame(spark, sf), 10, 3).select("node_id", "vec_id")


@register("class_balance", "WITH k AS (SELECT node_id, label, count(*) AS n FROM s GROUP BY 1, 2) SELECT node_id, label, n, round(1.0e0 / (count(*) OVER (PARTITION BY node_id) * n), 6) + 0.0e0 AS weight FROM k")
def class_balance(spark, sf):
    return features.class_weights(base.frame(spark, sf)).select("node_id", "label", "n", tidy("weight").alias("weight"))


@register("honest_union", "SELECT s.vec_id, s.label, s.node_id FROM s JOIN n ON n.node_id = s.node_id AND NOT n.is_byz")
def honest_union(spark, sf):
    honest = base.nodes(spark).where("NOT is_byz")
    return base.frame(spark, sf).join(F.broadcast(honest), "node_id", "left_semi").select("vec_id", "label", "node_id")


@register("step_sizes", "SELECT CAST(range AS INTEGER) AS k, round(0.5e0 / (1 + range * 0.25e0), 6) + 0.0e0 AS alpha, round(2.0e0 * 0.5e0 / (1 + range * 0.25e0), 6) + 0.0e0 AS tau FROM range(200)", shared=False)
def step_sizes(spark, sf):
    got = spark.range(200).select(F.col("id").cast("int").alias("k")).select("k", *training.rates(200, tau=2.0))
    return got.select("k", tidy("alpha").alias("alpha"), tidy("tau").alias("tau"))


#: Each node's class vectors are the centroids of its shard's classes, 4 times as long; absent classes are zero.
OWN_THETA = """
cc AS (SELECT node_id, label AS cls, c, 4 * avg(v) AS t FROM e GROUP BY 1, 2, 3),
al AS (SELECT n.node_id, CAST(k.range AS INTEGER) AS cls, CAST(d.range AS INTEGER) AS c FROM n CROSS JOIN range(10) k CROSS JOIN (SELECT DISTINCT c AS range FROM e) d),
th AS (SELECT al.node_id, al.cls, list(coalesce(cc.t, 0) ORDER BY al.c) AS t FROM al LEFT JOIN cc ON cc.node_id = al.node_id AND cc.cls = al.cls AND cc.c = al.c GROUP BY 1, 2),
us AS (SELECT * FROM s),"""
#: One model for all honest nodes, the centroids of all their samples, and their samples only.
HONEST_THETA = """
us AS (SELECT s.* FROM s JOIN n ON n.node_id = s.node_id AND NOT is_byz),
cc AS (SELECT label AS cls, c, 4 * avg(v) AS t FROM e JOIN n ON n.node_id = e.node_id AND NOT is_byz GROUP BY 1, 2),
th AS (SELECT n.node_id, cls, t FROM n CROSS JOIN (SELECT cls, list(t ORDER BY c) AS t FROM cc GROUP BY 1) WHERE NOT is_byz),"""
SOFTMAX = """
z AS (SELECT us.node_id, us.vec_id, us.label, us.x, th.cls, list_dot_product(us.x, th.t) AS z FROM us JOIN th ON th.node_id = us.node_id),
zz AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM z),
p AS (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p, top + ln(sum(exp(z - top)) OVER (PARTITION BY vec_id)) AS lse FROM zz),
rs AS (SELECT *, p - CASE WHEN cls = label THEN 1 ELSE 0 END AS r FROM p),
gr AS (SELECT node_id, cls, c, avg(r * v) AS g0 FROM (SELECT node_id, cls, r, CAST(unnest(range(len(x))) AS INTEGER) AS c, unnest(x) AS v FROM rs) GROUP BY 1, 2, 3),
gg AS (SELECT gr.node_id, gr.cls, gr.c, g0 + 0.01e0 * t[gr.c + 1] AS g, t[gr.c + 1] AS t FROM gr JOIN th ON th.node_id = gr.node_id AND th.cls = gr.cls)"""
THETA, COMMON = OWN_THETA + SOFTMAX, HONEST_THETA + SOFTMAX
SQUARES = "sq AS (SELECT node_id, sum(list_dot_product(t, t)) AS sq FROM th GROUP BY 1)"


def _theta(spark, sf):
    x = tables.coordinates(base.frame(spark, sf))
    got = x.groupBy("node_id", F.col("label").alias("cls"), "c").agg((4 * F.avg("v")).alias("t"))
    wide = V.wide_form(got, "node_id", "cls", v="t", out="t")
    every = base.nodes(spark).select("node_id").crossJoin(spark.range(10).select(F.col("id").cast("int").alias("cls")))
    zero = base.frame(spark, sf).limit(1).select(F.transform("x", lambda _: F.lit(0.0)).alias("zero"))
    return every.join(wide, ["node_id", "cls"], "left").crossJoin(F.broadcast(zero)).select("node_id", "cls", F.coalesce("t", "zero").alias("t"))


def _honest(spark, sf):
    return base.frame(spark, sf).join(base.nodes(spark).where("NOT is_byz").select("node_id"), "node_id", "left_semi")


def _common_theta(spark, sf):
    got = tables.coordinates(_honest(spark, sf)).groupBy(F.col("label").alias("cls"), "c").agg((4 * F.avg("v")).alias("t"))
    return base.nodes(spark).where("NOT is_byz").select("node_id").crossJoin(V.wide_form(got, "cls", v="t", out="t"))


@register("softmax_grad", f"WITH {THETA} SELECT node_id, cls, c, round(g, 6) + 0.0e0 AS g FROM gg")
def softmax_grad(spark, sf):
    return training.gradient(base.frame(spark, sf), _theta(spark, sf)).select("node_id", "cls", "c", tidy("g").alias("g"))


@register("half_step", f"WITH {THETA} SELECT node_id, cls * 64 + c AS c, round(t - 0.4e0 * g, 6) + 0.0e0 AS v FROM gg")
def half_step(spark, sf):
    return coords(training.half_step(base.frame(spark, sf), _theta(spark, sf), 0.4))


@register("label_flip_msg", f"WITH {OWN_THETA.replace('us AS (SELECT * FROM s)', 'us AS (SELECT s.vec_id, s.node_id, s.x, CAST((label + CASE WHEN is_byz THEN 1 + s.node_id % 9 ELSE 0 END) % 10 AS INTEGER) AS label FROM s JOIN n ON n.node_id = s.node_id)') + SOFTMAX} SELECT node_id, cls * 64 + c AS c, round(t - 0.4e0 * g, 6) + 0.0e0 AS v FROM gg")
def label_flip_msg(spark, sf):
    """All messages of a round in which attackers take their step on moved labels."""
    samples, theta = base.frame(spark, sf), _theta(spark, sf)
    shifts = base.nodes(spark).where("is_byz").select("node_id", (1 + F.col("node_id") % 9).alias("shift"))
    flips = attacks.flipped_step(samples, shifts, theta, 10, 0.4, 0.01)
    return coords(attacks.attack("label_flip", base.edges(spark), base.nodes(spark), training.half_step(samples, theta, 0.4), flips))


@register("node_loss", f"WITH {THETA}, {SQUARES} SELECT x.node_id, round(ce + 0.005e0 * sq, 6) + 0.0e0 AS loss FROM (SELECT node_id, avg(lse - z) AS ce FROM p WHERE cls = label GROUP BY 1) x JOIN sq ON sq.node_id = x.node_id")
def node_loss(spark, sf):
    return training.losses(base.frame(spark, sf), _theta(spark, sf)).select("node_id", tidy("loss").alias("loss"))


HITS = "ht AS (SELECT node_id, avg(CASE WHEN cls = label THEN 1.0e0 ELSE 0 END) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, cls) AS r FROM p) WHERE r = 1 GROUP BY 1)"


@register("accuracy_argmax", f"WITH {THETA}, {HITS} SELECT node_id, round(accuracy, 6) + 0.0e0 AS accuracy FROM ht")
def accuracy_argmax(spark, sf):
    return training.losses(base.frame(spark, sf), _theta(spark, sf)).select("node_id", tidy("accuracy").alias("accuracy"))


@register("node_extremes", f"""WITH {THETA}, {SQUARES}, {HITS}, lo AS (SELECT x.node_id, ce + 0.005e0 * sq AS loss, accuracy FROM (SELECT node_id, avg(lse - z) AS ce FROM p WHERE cls = label GROUP BY 1) x JOIN sq ON sq.node_id = x.node_id JOIN ht ON ht.node_id = x.node_id JOIN n ON n.node_id = x.node_id AND NOT is_byz)
SELECT round(avg(accuracy), 6) + 0.0e0 AS mean_test_acc, round(min(accuracy), 6) + 0.0e0 AS min_test_acc, round(max(accuracy), 6) + 0.0e0 AS max_test_acc, round(min(loss), 6) + 0.0e0 AS min_train_loss, round(max(loss), 6) + 0.0e0 AS max_train_loss FROM lo""")
def node_extremes(spark, sf):
    honest = base.nodes(spark).where("NOT is_byz").select("node_id")
    got = rounds.extremes(training.losses(base.frame(spark, sf), _theta(spark, sf)).join(honest, "node_id", "left_semi"))
    return got.select(*[tidy(c).alias(c) for c in got.columns])


def _averaged_sql(pi: str) -> str:
    return f"""(SELECT avg(CASE WHEN cls = label THEN 1.0e0 ELSE 0 END) FROM (SELECT s.vec_id, s.label, m.cls, row_number() OVER (PARTITION BY s.vec_id ORDER BY list_dot_product(s.x, m.t) DESC, m.cls) AS r
FROM s CROSS JOIN (SELECT cls, list(v ORDER BY c) AS t FROM (SELECT cls, c, sum(pi * t) / sum(pi) AS v FROM (SELECT th.cls, {pi} AS pi, unnest(range(len(t))) AS c, unnest(t) AS t FROM th JOIN n ON n.node_id = th.node_id AND NOT is_byz) GROUP BY 1, 2) GROUP BY 1) m) WHERE r = 1)"""


@register("averaged_accuracy", f"WITH {OWN_THETA.rstrip(',')} SELECT round({_averaged_sql('1.0e0')}, 6) + 0.0e0 AS test_acc, round({_averaged_sql('(th.node_id + 1) / 210.0e0')}, 6) + 0.0e0 AS test_acc_pi")
def averaged_accuracy(spark, sf):
    samples, theta = base.frame(spark, sf), _theta(spark, sf).join(base.nodes(spark).where("NOT is_byz").select("node_id"), "node_id", "left_semi")
    plain, weighted = (training.accuracy_of(samples, training.averaged_model(theta, pi)) for pi in (None, _pi(spark)))
    return plain.select(tidy("accuracy").alias("test_acc")).crossJoin(weighted.select(tidy("accuracy").alias("test_acc_pi")))


@register("global_ce", f"WITH {COMMON} SELECT round(avg(lse - z), 6) + 0.0e0 AS ce FROM p WHERE cls = label")
def global_ce(spark, sf):
    theta = _common_theta(spark, sf).where("node_id = 0").drop("node_id")
    return training.global_ce(_honest(spark, sf), theta).select(tidy("ce").alias("ce"))


@register("mean_losses", f"WITH {THETA}, {SQUARES}, lo AS (SELECT x.node_id, ce + 0.005e0 * sq AS loss FROM (SELECT node_id, avg(lse - z) AS ce FROM p WHERE cls = label GROUP BY 1) x JOIN sq ON sq.node_id = x.node_id) SELECT round(avg(loss), 6) + 0.0e0 AS f_unif, round(sum((lo.node_id + 1) / 210.0e0 * loss) / sum((lo.node_id + 1) / 210.0e0), 6) + 0.0e0 AS f_pi FROM lo JOIN n ON n.node_id = lo.node_id AND NOT is_byz")
def mean_losses(spark, sf):
    honest = _pi(spark).join(F.broadcast(base.nodes(spark).where("NOT is_byz")), "node_id", "left_semi")
    got = training.mean_losses(training.losses(base.frame(spark, sf), _theta(spark, sf)), honest)
    return got.select(tidy("f_unif").alias("f_unif"), tidy("f_pi").alias("f_pi"))


@register("local_optimum")
def local_optimum(spark, sf):
    out = []
    for name, pi in (("uniform", None), ("pi", _pi(spark))):
        _, objective, f_star = training.local_optimum(_honest(spark, sf), pi, rounds=50)
        out.append((name, round(objective, 4), round(f_star, 4)))
    return spark.createDataFrame(out, "weights string, objective double, f_star double")


@register("target_pi", f"WITH {GAMMA} SELECT node_id, round((1 - gamma) * pi, 6) + 0.0e0 AS pi FROM gn")
def target_pi(spark, sf):
    return _rated(spark).select("node_id", tidy((1 - F.col("gamma")) * F.col("pi")).alias("pi"))


@register("drawn_pi")
def drawn_pi(spark, sf):
    """A stationary distribution drawn from a Dirichlet of 2."""
    return training.drawn_pi(spark, base.N, 2.0).select("node_id", tidy("pi").alias("pi"))


@register("capacity_shard")
def capacity_shard(spark, sf):
    shares = spark.range(10).select(F.col("id").cast("int").alias("label")).crossJoin(base.nodes(spark).select("node_id")).withColumn("share", F.when(F.col("node_id") < 4, 0.13).otherwise(0.03))
    got = training.capacity_partition(base.frame(spark, sf), shares, base.N)
    return got.groupBy("node_id").agg(F.count("*").alias("n"))


@register("sigma_sq", f"""WITH {COMMON},
a AS (SELECT node_id, avg(sq) AS a FROM (SELECT node_id, vec_id, sum(r * r) * any_value(list_dot_product(x, x)) AS sq FROM rs GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT node_id, sum(g0 * g0) AS b FROM gr GROUP BY 1)
SELECT round(max(a - b), 6) + 0.0e0 AS sigma_sq FROM a JOIN b ON a.node_id = b.node_id""")
def sigma_sq(spark, sf):
    return training.variance_within(_honest(spark, sf), _common_theta(spark, sf)).select(tidy("sigma_sq").alias("sigma_sq"))


def _zeta_sql(pi: str) -> str:
    return f"""WITH {COMMON}, q AS (SELECT gr.*, {pi} AS pi FROM gr), mn AS (SELECT cls, c, sum(pi * g0) / sum(pi) AS mean FROM q GROUP BY 1, 2),
d AS (SELECT node_id, any_value(pi) AS pi, sum((g0 - mean) * (g0 - mean)) AS d FROM q JOIN mn ON mn.cls = q.cls AND mn.c = q.c GROUP BY 1)
SELECT round(sum(pi * d) / sum(pi), 6) + 0.0e0 AS zeta_sq FROM d"""


def _shared_gradients(spark, sf):
    return training.gradient(_honest(spark, sf), _common_theta(spark, sf), 0.0)


@register("zeta_sq", _zeta_sql("1.0e0"))
def zeta_sq(spark, sf):
    return training.variance_between(_shared_gradients(spark, sf)).select(tidy("zeta_sq").alias("zeta_sq"))


@register("zeta_sq_pi", _zeta_sql("(node_id + 1) / 210.0e0"))
def zeta_sq_pi(spark, sf):
    return training.variance_between(_shared_gradients(spark, sf), _pi(spark)).select(tidy("zeta_sq").alias("zeta_sq"))


@register("smoothness")
def smoothness(spark, sf):
    return training.smoothness(_honest(spark, sf)).select(tidy("L").alias("L"), tidy("mu").alias("mu"))


# ---- features ----

FEAT = """
ev AS (SELECT src, dst, own_t AS own, other, gr AS g FROM pairs WHERE src <> dst),
dd AS (SELECT *, list_transform(list_zip(own, other), lambda p: p[1] - p[2]) AS d FROM ev),
dl AS (SELECT src, dst, CAST(unnest(range(len(d))) AS INTEGER) AS c, unnest(d) AS v FROM dd),
md AS (SELECT a.src, a.dst, a.c, any_value(a.v) AS v, median(b.v) AS med FROM dl a JOIN dl b ON a.src = b.src AND a.c = b.c AND a.dst <> b.dst GROUP BY 1, 2, 3)"""


@register("cos_features", f"""WITH {FEAT},
n2 AS (SELECT src, dst, list_sum(list_transform(list_zip(d, g), lambda p: p[1] * p[2])) AS dg, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS nd, sqrt(list_sum(list_transform(g, lambda x: x * x))) AS ng FROM dd)
SELECT src, dst, round(dg / (nd * ng + 1e-12), 6) + 0.0e0 AS cos_g, round(ln(nd / (0.5e0 * ng) + 1e-12), 6) + 0.0e0 AS log_norm_ratio, round(ln(0.5e0 + 1e-12), 6) + 0.0e0 AS log_alpha FROM n2""")
def cos_features(spark, sf):
    got = features.direction(base.edge_vectors(spark, sf), 0.5)
    return got.select("src", "dst", *[tidy(c).alias(c) for c in ("cos_g", "log_norm_ratio", "log_alpha")])


@register("loo_median", f"WITH {FEAT} SELECT src, dst, c, round(med, 6) + 0.0e0 AS med FROM md")
def loo_median(spark, sf):
    d = base.edge_vectors(spark, sf).select("src", "dst", F.posexplode(V.minus("own", "other")).alias("c", "v"))
    return features.left_out_median(d, "v", ["src", "c"]).where("med IS NOT NULL").select("src", "dst", "c", tidy("med").alias("med"))


@register("consensus_features", f"""WITH {FEAT},
sm AS (SELECT src, dst, sum(v * med) AS dot, sqrt(sum(v * v)) AS nv, sqrt(sum(med * med)) AS nm, sqrt(sum((v - med) * (v - med))) AS dev FROM md GROUP BY 1, 2),
ty AS (SELECT src, median(dev) AS typical, count(*) AS k FROM sm GROUP BY 1)
SELECT sm.src, dst, round(CASE WHEN k < 3 THEN 0 ELSE dot / (nv * nm + 1e-12) END, 6) + 0.0e0 AS cos_gbar, round(CASE WHEN k < 3 THEN 0 ELSE ln(dev / (typical + 1e-12) + 1e-12) END, 6) + 0.0e0 AS log_dev_norm FROM sm JOIN ty ON ty.src = sm.src""")
def consensus_features(spark, sf):
    got = features.consensus(base.edge_vectors(spark, sf))
    return got.select("src", "dst", tidy("cos_gbar").alias("cos_gbar"), tidy("log_dev_norm").alias("log_dev_norm"))


@register("shift_margin", f"""WITH {THETA},
cs AS (SELECT node_id AS src, label AS cls, c, sum(v) AS v FROM e GROUP BY 1, 2, 3),
tl AS (SELECT node_id, cls, CAST(unnest(range(len(t))) AS INTEGER) AS c, unnest(t) AS t FROM th),
dc AS (SELECT g.src, g.dst, a.cls, a.c, a.t - b.t AS v FROM g JOIN tl a ON a.node_id = g.src JOIN tl b ON b.node_id = g.dst AND b.cls = a.cls AND b.c = a.c),
sc AS (SELECT cs.src, dc.dst, k.range AS s, cs.cls, sum(cs.v * dc.v) / (sqrt(sum(cs.v * cs.v)) * sqrt(sum(dc.v * dc.v)) + 1e-12) AS cos FROM cs CROSS JOIN range(10) k JOIN dc ON dc.src = cs.src AND dc.cls = (cs.cls + k.range) % 10 AND dc.c = cs.c GROUP BY 1, 2, 3, 4),
ro AS (SELECT src, dst, s, -avg(cos) AS rho FROM sc GROUP BY 1, 2, 3)
SELECT src, dst, round(max(rho) - max(rho) FILTER (WHERE s = 0), 6) + 0.0e0 AS margin FROM ro GROUP BY 1, 2""")
def shift_margin(spark, sf):
    sums = V.wide_form(tables.coordinates(base.frame(spark, sf)).groupBy(F.col("node_id").alias("src"), F.col("label").alias("cls"), "c").agg(F.sum("v").alias("v")), "src", "cls")
    th = _theta(spark, sf)
    own = th.select(F.col("node_id").alias("src"), "cls", F.col("t").alias("a"))
    other = th.select(F.col("node_id").alias("dst"), "cls", F.col("t").alias("b"))
    columns = base.edges(spark).join(own, "src").join(other, ["dst", "cls"]).select("src", "dst", "cls", V.minus("a", "b").alias("x"))
    return features.shift_margin(sums, columns, 10).select("src", "dst", tidy("margin").alias("margin"))


@register("stable_rank")
def stable_rank(spark, sf):
    return features.stable_rank(base.edge_vectors(spark, sf), 8).select("src", "dst", tidy("stable_rank").alias("stable_rank"))


NEIGHBOUR = """
zn AS (SELECT g.src, g.dst, s.vec_id, s.label, th.cls, list_dot_product(s.x, th.t) AS z FROM g JOIN s ON s.node_id = g.src JOIN th ON th.node_id = g.dst),
zt AS (SELECT *, max(z) OVER (PARTITION BY src, dst, vec_id) AS top FROM zn),
zp AS (SELECT *, top + ln(sum(exp(z - top)) OVER (PARTITION BY src, dst, vec_id)) AS lse, row_number() OVER (PARTITION BY src, dst, vec_id ORDER BY z DESC, cls) AS r FROM zt),
cw AS (SELECT node_id, label, 1.0e0 / (count(*) OVER (PARTITION BY node_id) * n) AS wt FROM (SELECT node_id, label, count(*) AS n FROM s GROUP BY 1, 2))"""


@register("neighbour_loss", f"""WITH {THETA}, {NEIGHBOUR}, {SQUARES},
ce AS (SELECT src, dst, sum(wt * (lse - z)) AS ce FROM zp JOIN cw ON cw.node_id = src AND cw.label = zp.label WHERE cls = zp.label GROUP BY 1, 2),
ac AS (SELECT src, dst, avg(CASE WHEN cls = label THEN 1.0e0 ELSE 0 END) AS acc FROM zp WHERE r = 1 GROUP BY 1, 2),
lo AS (SELECT ce.src, ce.dst, ce + 0.005e0 * sq AS loss FROM ce JOIN sq ON sq.node_id = ce.dst),
mm AS (SELECT a.src, a.dst, any_value(a.loss) AS loss, median(b.loss) AS med, count(*) AS k FROM lo a JOIN lo b ON a.src = b.src AND a.dst <> b.dst GROUP BY 1, 2)
SELECT lo.src, lo.dst, round(acc, 6) + 0.0e0 AS acc, round(CASE WHEN coalesce(k, 0) < 2 THEN 0 ELSE lo.loss - med END, 6) + 0.0e0 AS ce_diff_nbr FROM lo JOIN ac ON ac.src = lo.src AND ac.dst = lo.dst LEFT JOIN mm ON mm.src = lo.src AND mm.dst = lo.dst""")
def neighbour_loss(spark, sf):
    got = features.neighbour_loss(base.edges(spark), base.frame(spark, sf), _theta(spark, sf))
    return features.finite(got.select("src", "dst", tidy("acc").alias("acc"), tidy("ce_diff_nbr").alias("ce_diff_nbr")), "acc", "ce_diff_nbr")


# ---- rounds ----

@register("consensus_distance", """WITH p AS (SELECT node_id, (node_id + 1) / 210.0e0 AS pi FROM n), mn AS (SELECT c, sum(pi * v) / sum(pi) AS mean FROM m JOIN p ON p.node_id = m.node_id GROUP BY 1),
d AS (SELECT m.node_id, sum((v - mean) * (v - mean)) AS d2 FROM m JOIN mn ON mn.c = m.c GROUP BY 1)
SELECT round(sum(pi * d2), 6) + 0.0e0 AS c_pi, round(avg(d2), 6) + 0.0e0 AS c_unif FROM d JOIN p ON p.node_id = d.node_id""")
def consensus_distance(spark, sf):
    got = rounds.consensus_distance(base.messages(spark, sf), _pi(spark))
    return got.select(tidy("c_pi").alias("c_pi"), tidy("c_unif").alias("c_unif"))


@register("optimality_gap", """WITH p AS (SELECT node_id, (node_id + 1) / 210.0e0 AS pi FROM n), mn AS (SELECT c, sum(pi * v) / sum(pi) AS mean FROM m JOIN p ON p.node_id = m.node_id GROUP BY 1), go AS (SELECT c, avg(v) AS v FROM e GROUP BY 1)
SELECT round(sqrt(sum((mean - v) * (mean - v))), 6) + 0.0e0 AS opt_gap FROM mn JOIN go ON go.c = mn.c""")
def optimality_gap(spark, sf):
    goal = tables.coordinates(base.frame(spark, sf)).groupBy("c").agg(F.avg("v").alias("v"))
    return rounds.optimality_gap(base.messages(spark, sf), _pi(spark), goal).select(tidy("opt_gap").alias("opt_gap"))


DECISIONS = "dc AS (SELECT w0.src, w0.dst, w0.w, b.is_byz AND w0.dst <> 3 AS is_adv, NOT b.is_byz AS is_hon, (w0.src * 3 + w0.dst * 5) % 4 = 0 AS flagged FROM w0 JOIN n a ON a.node_id = w0.src AND NOT a.is_byz JOIN n b ON b.node_id = w0.dst)"
CONF = DECISIONS + ", cf AS (SELECT src AS node_id, sum(w) AS row_w, " + ", ".join(f"count(*) FILTER (WHERE {e}) AS {k}, coalesce(sum(w) FILTER (WHERE {e}), 0) AS {k}_w" for k, e in (("tp", "flagged AND is_adv"), ("fp", "flagged AND is_hon"), ("tn", "NOT flagged AND is_hon"), ("fn", "NOT flagged AND is_adv"))) + " FROM dc GROUP BY src)"


def _decisions(spark):
    n = base.nodes(spark)
    w = base.weights(spark).where("src <> dst").join(n.where("NOT is_byz").select(F.col("node_id").alias("src")), "src", "left_semi")
    far = n.select(F.col("node_id").alias("dst"), F.expr("is_byz AND node_id <> 3").alias("is_adv"), (~F.col("is_byz")).alias("is_hon"))
    return w.join(far, "dst").withColumn("flagged", F.expr("(src * 3 + dst * 5) % 4 = 0"))


@register("edge_confusion", f"WITH {CONF} SELECT node_id, tp, fp, tn, fn, " + ", ".join(f"round({k}_w, 6) + 0.0e0 AS {k}_w" for k in ("tp", "fp", "tn", "fn")) + " FROM cf")
def edge_confusion(spark, sf):
    return rounds.edge_confusion(_decisions(spark)).select("node_id", "tp", "fp", "tn", "fn", *[tidy(f"{k}_w").alias(f"{k}_w") for k in ("tp", "fp", "tn", "fn")])


@register("realized_rates", f"""WITH {CONF} SELECT round(sum(fp) / (sum(fp) + sum(tn) + 1e-12), 6) + 0.0e0 AS gamma_k, round(sum(fn) / (sum(fn) + sum(tp) + 1e-12), 6) + 0.0e0 AS beta_k,
round(sum((node_id + 1) / 210.0e0 * fn_w * (0.1e0 + 0.01e0 * node_id)), 6) + 0.0e0 AS byz_w_k, round(sum((node_id + 1) / 210.0e0 * (row_w - fp_w) * (1 - 0.005e0 * node_id)), 6) + 0.0e0 AS hon_w_k FROM cf""")
def realized_rates(spark, sf):
    got = rounds.realized_rates(rounds.edge_confusion(_decisions(spark)), _pi(spark), _own_rates(spark))
    return got.select(*[tidy(c).alias(c) for c in got.columns])


@register("node_rates", f"WITH {CONF} SELECT node_id, round(fp / (fp + tn + 1e-12), 6) + 0.0e0 AS gamma_k_node FROM cf")
def node_rates(spark, sf):
    return rounds.node_rates(rounds.edge_confusion(_decisions(spark))).select("node_id", tidy("gamma_k_node").alias("gamma_k_node"))


@register("attacker_pull", _near_sql(*OWN_RATES) + """, nl AS (SELECT src, dst, w, CAST(unnest(range(len(p))) AS INTEGER) AS c, unnest(p) AS v FROM near WHERE src <> dst),
pl AS (SELECT nl.src, nl.c, sum(nl.w * (nl.v - o.th)) AS d FROM nl JOIN n b ON b.node_id = nl.dst AND b.is_byz JOIN m o ON o.node_id = nl.src AND o.c = nl.c GROUP BY 1, 2)
SELECT round(sum((src + 1) / 210.0e0 * d * d), 9) + 0.0e0 AS rho2_k FROM pl""")
def attacker_pull(spark, sf):
    near = mixing.projected(base.weights(spark), base.messages(spark, sf), _before(spark, sf), _flags(spark, _own_rates(spark)), 0.1)
    return rounds.attacker_pull(near, _pi(spark), base.nodes(spark), _before(spark, sf)).select(V.tidy(F.col("rho2_k"), 9).alias("rho2_k"))


@register("theory_bounds", """WITH t AS (SELECT node_id, 2.0e0 AS L, 0.5e0 AS mu, 0.001e0 AS nu2, 0.6e0 AS lam, 0.8e0 AS sigma_sq, 0.3e0 AS zeta_sq, 1.5e0 AS pc, 0.25e0 AS db_max, 0.1e0 AS db_pi, 0.02e0 * (node_id + 1) AS fnr, 17.0e0 AS h, 25.0e0 AS nl, 0.05e0 AS alpha, 0.09e0 AS pi_max, 0.004e0 AS pd FROM n)
SELECT node_id, round(1 - lam * lam - nu2, 6) + 0.0e0 AS g, round(lam * lam + nu2, 6) + 0.0e0 AS s2, round(pc * alpha, 6) + 0.0e0 AS tau, round((1 - lam * lam - nu2) / (6 * L), 6) + 0.0e0 AS alpha_max_conv, round(2 / (mu + L), 6) + 0.0e0 AS alpha_max_stab,
round(8 * L * (1 + fnr * db_max) / (mu * h * nl), 6) + 0.0e0 AS eps_opt, round(8 * h * (pc * alpha) * fnr * db_pi / (alpha * mu * nl), 6) + 0.0e0 AS eps_byz, round(8 * L * (1 + fnr * db_max) / (mu * h * nl) + 8 * h * (pc * alpha) * fnr * db_pi / (alpha * mu * nl), 6) + 0.0e0 AS epsilon,
round(pc * pc * fnr * db_max * db_max / (mu * mu), 6) + 0.0e0 AS byz_cons_floor, round(3 / (mu * mu) * (zeta_sq * h * pd + sigma_sq / nl * (1 / h + pi_max)), 6) + 0.0e0 AS opt_gap_ub FROM t""")
def theory_bounds(spark, sf):
    fixed = {"L": 2.0, "mu": 0.5, "nu2": 0.001, "lam": 0.6, "sigma_sq": 0.8, "zeta_sq": 0.3, "proj_const": 1.5, "db_max": 0.25, "db_pi": 0.1, "alpha": 0.05, "h": 17.0, "n_loc": 25.0, "pi_max": 0.09, "pi_dist_sq": 0.004}
    t = base.nodes(spark).select("node_id", *[F.lit(v).alias(k) for k, v in fixed.items()], (0.02 * (F.col("node_id") + 1)).alias("fnr"))
    names = ("g", "s2", "tau", "alpha_max_conv", "alpha_max_stab", "eps_opt", "eps_byz", "epsilon", "byz_cons_floor", "opt_gap_ub")
    return rounds.bounds(t).select("node_id", *[tidy(c).alias(c) for c in names])


@register("simulated_runs")
def simulated_runs(spark, sf):
    from ..operators import reporting

    grid = reporting.grid(spark, graph=["complete", "random_regular"], attack=["sign_flip", "inner_product"], seed=[0], alg=["filtered", "median", "trimmed"])
    got = simulate.simulate(grid, base.frame(spark, sf), rounds=8)
    return got.select("graph", "attack", "seed", "alg", "k", tidy("test_acc").alias("test_acc"), tidy("c_unif").alias("c_unif"))


ROUND_FEATURES = ("cos_g", "log_norm_ratio", "margin", "stable_rank", "acc", "cos_gbar", "log_dev_norm", "ce_diff_nbr", "log_alpha")


@register("edge_feature_table")
def edge_feature_table(spark, sf):
    """The nine features of every edge of a round of half steps."""
    samples, theta = base.frame(spark, sf), _theta(spark, sf)
    grads = training.gradient(samples, theta)
    steps = V.wide_form(grads.join(theta.select("node_id", "cls", F.posexplode("t").alias("c", "tv")), ["node_id", "cls", "c"]).select("node_id", "cls", "c", (F.col("tv") - 0.4 * F.col("g")).alias("v")), "node_id", "cls", out="t")
    got = features.edge_features(base.edges(spark), samples, theta, steps, grads, 10, 0.4)
    return got.select("src", "dst", *[tidy(c).alias(c) for c in ROUND_FEATURES])


def _small(**how):
    return simulate.Config(rounds=8, batch=8, reg=0.1, **how)


def _edges_of_runs(spark, sf, attacks_=("sign_flip", "inner_product"), splits=tuple(simulate.SPLITS)):
    samples = base.frame(spark, sf)
    proj = experiment.projection_constants(spark, samples, ["complete"], _small())
    return proj, experiment.labelled_edges(spark, samples, proj, _small(), attacks_, splits=splits)


@register("proj_const_run")
def proj_const_run(spark, sf):
    got = experiment.projection_constants(spark, base.frame(spark, sf), ["complete", "random_regular"], _small())
    return spark.createDataFrame([(g, round(v, 4)) for g, v in sorted(got.items())], "graph string, proj_const double")


@register("labelled_edges")
def labelled_edges(spark, sf):
    _, edges = _edges_of_runs(spark, sf)
    return edges.select("graph", "split", "atk_id", "grp", "y", *[F.round(f, 4).alias(f) for f in ROUND_FEATURES])


@register("scaled_edges")
def scaled_edges(spark, sf):
    _, edges = _edges_of_runs(spark, sf, splits=("train", "test"))
    got = features.scale(edges, features.fit_scaler(edges.where("split = 'train'")))
    return got.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in got.dtypes])


def leave_one_attack_out(spark, sf):
    """Each attack is left out of training once and tested on."""
    samples, out = base.frame(spark, sf), []
    kinds = ("sign_flip", "gaussian", "inner_product")
    proj = experiment.projection_constants(spark, samples, ["complete"], _small())
    for left in kinds:
        edges = experiment.labelled_edges(spark, samples, proj, _small(), tuple(a for a in kinds if a != left), (left,), splits=("train", "test"))
        z = features.scale(edges, features.fit_scaler(edges.where("split = 'train'"))).cache()
        got = evaluate.auc(evaluate.fit_logistic(z.where("split = 'train'"), simulate.scaled_order())(z.where("split = 'test'")).select("y", "score")).head()
        out.append((left, round(float(got.auc or 0), 4)))
        z.unpersist()
    return spark.createDataFrame(out, "left_out string, roc_auc double")


_cycles: dict = {}


def _cycle(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _cycles:
        train, system, permute = experiment.experiments(_small(), _small())["tm_3_baseline"]
        _cycles[key] = experiment.run_cycle(spark, base.frame(spark, sf), train, system, ["complete"], ["sign_flip", "inner_product"], [111], permute=permute, grid=(1.0,), folds=2)
    return _cycles[key]


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in df.dtypes])


def clf_metrics(spark, sf):
    return _rounded(_cycle(spark, sf)["clf_metrics"])


def sys_sim(spark, sf):
    return _rounded(_cycle(spark, sf)["sys_sim"])


def sys_metrics(spark, sf):
    return _rounded(_cycle(spark, sf)["sys_metrics"])


def test_accuracy(spark, sf):
    return _rounded(_cycle(spark, sf)["test_accuracy"])
