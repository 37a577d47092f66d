"""Communication graphs as edge tables (src, dst[, w]), both directions present."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nodes(spark: SparkSession, n: int = 20, byz: str = "node_id % 7 = 3") -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("node_id")).withColumn("is_byz", F.expr(byz))


def edges_where(nodes: DataFrame, predicate: Column | str) -> DataFrame:
    """Every ordered pair (src, dst) of two nodes that the predicate joins."""
    a = nodes.select(F.col("node_id").alias("src"))
    b = nodes.select(F.col("node_id").alias("dst"))
    return a.join(b, (F.col("src") != F.col("dst")) & (F.expr(predicate) if isinstance(predicate, str) else predicate))


def ring_with_chords(n: int = 20) -> str:
    """A ring, and a fixed pseudo-random fifth of the other pairs."""
    return f"abs(src - dst) IN (1, {n - 1}) OR (least(src, dst) * 31 + greatest(src, dst) * 17) % 10 < 2"


def generate(kind: str, n: int, seed: int = 0, **kw) -> set[tuple[int, int]]:
    """Undirected edges (i < j) of a random graph; unknown kinds raise."""
    rng = random.Random(f"{kind}:{n}:{seed}")
    if kind == "complete":
        return {(i, j) for i in range(n) for j in range(i + 1, n)}
    if kind == "erdos_renyi":
        return {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < kw["p"]}
    if kind == "random_geometric":
        at = [(rng.random(), rng.random()) for _ in range(n)]
        return {(i, j) for i in range(n) for j in range(i + 1, n) if (at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2 <= kw["r"] ** 2}
    if kind == "random_regular":
        deg = kw["deg"]
        if n * deg % 2 or deg >= n:
            raise ValueError("no regular graph of this degree")
        while True:
            stubs, out = [i for i in range(n) for _ in range(deg)], set()
            rng.shuffle(stubs)
            for a, b in zip(stubs[::2], stubs[1::2], strict=True):
                if a == b or (min(a, b), max(a, b)) in out:
                    break
                out.add((min(a, b), max(a, b)))
            else:
                return out
    if kind == "watts_strogatz":
        k, p = kw["k"], kw["p"]
        if k < 2 or k % 2 or not 0.01 <= p <= 0.3:
            raise ValueError("k is even and at least 2, p is from 0.01 to 0.3")
        out = {tuple(sorted((i, (i + s) % n))) for i in range(n) for s in range(1, k // 2 + 1)}
        for a, b in sorted(out):
            free = [x for x in range(n) if x != a and tuple(sorted((a, x))) not in out]
            if free and rng.random() < p:
                out.remove((a, b))
                out.add(tuple(sorted((a, rng.choice(free)))))
        return out
    if kind == "barabasi_albert":
        m = kw["m"]
        out = {(i, m) for i in range(m)}
        ends = [x for e in out for x in e]
        for new in range(m + 1, n):
            to: set[int] = set()
            while len(to) < m:
                to.add(rng.choice(ends))
            for x in to:
                out.add((x, new))
                ends += [x, new]
        return out
    raise ValueError(f"unknown graph {kind!r}")


def connected(edges: set[tuple[int, int]], of: set[int]) -> bool:
    """Whether the graph that ``edges`` induce on these nodes is connected."""
    if not of:
        return False
    near: dict[int, set[int]] = {i: set() for i in of}
    for a, b in edges:
        if a in of and b in of:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [min(of)]
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += near[x] - seen
    return seen == of


def sample_until(kind: str, n: int, byz: set[int], seed: int = 0, attempts: int = 1000, **kw) -> set[tuple[int, int]]:
    """The first graph whose honest part is connected; raises after the last attempt."""
    honest = set(range(n)) - byz
    for t in range(attempts):
        if connected(out := generate(kind, n, seed + t, **kw), honest):
            return out
    raise ValueError("no graph with a connected honest part was found")


def as_edges(spark: SparkSession, undirected: set[tuple[int, int]]) -> DataFrame:
    rows = sorted(undirected | {(b, a) for a, b in undirected})
    return spark.createDataFrame(rows, "src int, dst int")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deg"))


def _with_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return edges.join(d.select(F.col("node_id").alias("src"), F.col("deg").alias("d_src")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("deg").alias("d_dst")), "dst")


def with_self(weights: DataFrame) -> DataFrame:
    """Adds (i, i, 1 - the row's sum)."""
    own = weights.groupBy("src").agg((1 - F.sum("w")).alias("w")).select("src", F.col("src").alias("dst"), "w")
    return weights.select("src", "dst", "w").unionByName(own)


def mh_weights(edges: DataFrame) -> DataFrame:
    """Metropolis-Hastings weights with self loops; degree tables have a row for each node."""
    return with_self(_with_degrees(edges).select("src", "dst", (1.0 / (1 + F.greatest("d_src", "d_dst"))).alias("w")))


def mh_weights_for(edges: DataFrame, pi: DataFrame) -> DataFrame:
    """Weights whose stationary distribution is pi (node_id, pi): proposal 1/d_i, accepted with min(1, (pi_j/d_j)/(pi_i/d_i)).

    A node of pi without an edge raises an error.
    """
    both = _with_degrees(edges).join(pi.select(F.col("node_id").alias("src"), F.col("pi").alias("pi_src")), "src").join(pi.select(F.col("node_id").alias("dst"), F.col("pi").alias("pi_dst")), "dst")
    accept = F.least(F.lit(1.0), (F.col("pi_dst") / F.col("d_dst")) / (F.col("pi_src") / F.col("d_src")))
    out = with_self(both.select("src", "dst", (accept / F.col("d_src")).alias("w")))
    lone = pi.join(edges, pi.node_id == edges.src, "left_anti").select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.raise_error(F.lit("a node has no neighbour")).cast("double").alias("w"))
    return out.unionByName(lone)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among keep.node_id."""
    ids = keep.select("node_id")
    return edges.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")


def is_connected(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """n_nodes, n_reached, connected: the smallest label is passed along the edges, twice as far each round, for graphs of a few hundred nodes."""
    n = keep.count()
    own = induced(edges, keep).select("src", "dst").unionByName(keep.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    labels = keep.select("node_id", F.col("node_id").alias("label"))
    while True:
        heard = own.join(labels, own.dst == labels.node_id).groupBy(F.col("src").alias("node_id")).agg(F.min("label").alias("label"))
        up = heard.select(F.col("node_id").alias("label"), F.col("label").alias("upper"))
        rows = heard.join(up, "label").select("node_id", F.col("upper").alias("label")).collect()
        before, labels = labels, keep.sparkSession.createDataFrame([(r.node_id, r.label) for r in rows], "node_id int, label int")
        if before.join(labels, ["node_id", "label"], "left_anti").isEmpty():
            break
    first = labels.agg(F.min("label").alias("label"))
    return labels.join(first, "label", "left_semi").agg(F.count("*").alias("n_reached")).select(F.lit(n).cast("long").alias("n_nodes"), "n_reached", (F.col("n_reached") == n).alias("connected"))


def attacker_mass(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, byz_mass, hon_mass, of honest nodes; 0 without such neighbours."""
    far = nodes.select(F.col("node_id").alias("dst"), "is_byz")
    mass = weights.where("src <> dst").join(far, "dst").groupBy(F.col("src").alias("node_id")).agg(F.sum(F.when(F.col("is_byz"), F.col("w")).otherwise(0.0)).alias("byz_mass"), F.sum(F.when(~F.col("is_byz"), F.col("w")).otherwise(0.0)).alias("hon_mass"))
    return nodes.where("NOT is_byz").select("node_id").join(mass, "node_id", "left").fillna(0.0, ["byz_mass", "hon_mass"])


def abstainers(edges: DataFrame, nodes: DataFrame, needs: dict[str, int]) -> DataFrame:
    """attack, node_id, n_honest, abstain: attackers with too few honest neighbours behave honestly."""
    far = nodes.select(F.col("node_id").alias("dst"), F.col("is_byz").alias("far_byz"))
    near = edges.join(far, "dst").groupBy(F.col("src").alias("node_id")).agg(F.count_if(~F.col("far_byz")).alias("n_honest"))
    attackers = nodes.where("is_byz").select("node_id").join(near, "node_id", "left").fillna(0, ["n_honest"])
    table = F.explode(F.create_map(*[F.lit(x) for pair in needs.items() for x in pair])).alias("attack", "need")
    return attackers.select("node_id", "n_honest", table).select("attack", "node_id", "n_honest", (F.col("n_honest") < F.col("need")).alias("abstain"))


def trim_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """q: mean number of attackers next to an honest node, rounded up; nodes without any count."""
    bad = nodes.where("is_byz").select(F.col("node_id").alias("dst"))
    counts = edges.join(bad, "dst", "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("k"))
    return nodes.where("NOT is_byz").join(counts, "node_id", "left").agg(F.ceil(F.avg(F.coalesce("k", F.lit(0)))).cast("int").alias("q"))


def effective_mixing(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, w of the honest part: off-diagonals times (1 - gamma of src), diagonals complete; nodes has gamma."""
    honest = nodes.where("NOT is_byz")
    inner = induced(weights.where("src <> dst"), honest).join(honest.select(F.col("node_id").alias("src"), "gamma"), "src")
    off = inner.select("src", "dst", ((1 - F.col("gamma")) * F.col("w")).alias("w"))
    lone = honest.select(F.col("node_id").alias("src")).join(off, "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))
    return with_self(off).unionByName(lone)


def stationary(nodes: DataFrame) -> DataFrame:
    """node_id, pi of honest nodes: proportional to their target over (1 - gamma)."""
    raw = nodes.where("NOT is_byz").select("node_id", (F.col("pi") / (1 - F.col("gamma"))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select("node_id", (F.col("raw") / F.col("total")).alias("pi"))


def detailed_balance(mixing: DataFrame, pi: DataFrame) -> DataFrame:
    """max_gap: largest |pi_i w_ij - pi_j w_ji|; max_row: largest |row sum - 1|."""
    a = pi.select(F.col("node_id").alias("src"), F.col("pi").alias("pi_src"))
    flow = mixing.join(a, "src").select("src", "dst", (F.col("pi_src") * F.col("w")).alias("flow"))
    back = flow.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("flow").alias("back"))
    gap = flow.join(back, ["src", "dst"], "left").agg(F.max(F.abs(F.col("flow") - F.coalesce("back", F.lit(0.0)))).alias("max_gap"))
    rows = mixing.groupBy("src").agg(F.sum("w").alias("total")).agg(F.max(F.abs(F.col("total") - 1)).alias("max_row"))
    return gap.crossJoin(rows)


def nu_entries(weights: DataFrame, pi: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, q = pi_a w^2 gamma (1 - gamma) of each honest edge a -> c."""
    honest = nodes.where("NOT is_byz")
    inner = induced(weights.where("src <> dst"), honest)
    own = honest.select("node_id", "gamma").join(pi, "node_id").select(F.col("node_id").alias("src"), "gamma", F.col("pi"))
    return inner.join(own, "src").select("src", "dst", (F.col("pi") * F.col("w") * F.col("w") * F.col("gamma") * (1 - F.col("gamma"))).alias("q"))


def nu_bound(weights: DataFrame, pi: DataFrame, nodes: DataFrame) -> DataFrame:
    """The bound on nu squared: 4 (largest over smallest pi) (largest weight between honest nodes) (largest gamma (1 - gamma))."""
    honest = nodes.where("NOT is_byz")
    ratio = pi.agg((F.max("pi") / F.min("pi")).alias("ratio"))
    top = induced(weights.where("src <> dst"), honest).agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("w_max"))
    rate = honest.agg(F.max(F.col("gamma") * (1 - F.col("gamma"))).alias("rate"))
    return ratio.crossJoin(top).crossJoin(rate).select((4 * F.col("ratio") * F.col("w_max") * F.col("rate")).alias("nu2_bound"))


def laplacian(rows) -> np.ndarray:
    """Row sums on the diagonal, minus the weights beside it; rows have src, dst, w."""
    at = {k: i for i, k in enumerate(sorted({r.src for r in rows} | {r.dst for r in rows}))}
    out = np.zeros((len(at), len(at)))
    for r in rows:
        out[at[r.src], at[r.dst]] -= r.w
        out[at[r.src], at[r.src]] += r.w
    return out


def spectral(weights: DataFrame, pi: DataFrame, nodes: DataFrame) -> dict[str, float]:
    """gap (second smallest real part of the spectrum of the whole graph's Laplacian, attackers included), lam, nu2, g = 1 - (lam^2 + nu2), for graphs of a few hundred nodes."""
    p = {r.node_id: r.pi for r in pi.collect()}
    at = {k: i for i, k in enumerate(sorted(p))}
    pv = np.array([p[k] for k in sorted(p)])
    w, q = np.zeros((len(at), len(at))), np.zeros((len(at), len(at)))
    for r in effective_mixing(weights, nodes).collect():
        w[at[r.src], at[r.dst]] = r.w
    for r in nu_entries(weights, pi, nodes).collect():
        a, c = at[r.src], at[r.dst]
        q[a, a] += r.q
        q[c, c] += r.q
        q[a, c] -= r.q
        q[c, a] -= r.q
    root = np.sqrt(pv)
    lam = float(np.linalg.norm(root[:, None] * (w - pv[None, :]) / root[None, :], 2))
    nu2 = float(np.linalg.eigvalsh(q / root[:, None] / root[None, :])[-1])
    ev = np.sort(np.linalg.eigvals(laplacian(weights.where("src <> dst").collect())).real)
    return {"spectral_gap": float(ev[1]) if len(ev) > 1 else 0.0, "lam_pi": lam, "nu2": nu2, "g": 1 - (lam * lam + nu2)}
