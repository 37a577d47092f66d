"""Whole runs: a grid of (graph, attack, seed, algorithm) as grouped-map jobs, a NumPy loop in each.

A run is a few dozen nodes over some hundred rounds whose steps depend on one
another; the parallelism is in the grid. One round of the loop equals the
DataFrame operators of ``mixing``, ``attacks`` and ``features`` (tests hold them
together). Samples go to each run whole: a run's nodes share them out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .attacks import z_of
from .features import FEATURES, HEAVY

RUN = "graph string, attack string, seed long, alg string"
METRICS = "test_acc double, test_acc_pi double, c_pi double, c_unif double, mean_test_acc double, min_test_acc double, max_test_acc double, min_train_loss double, max_train_loss double, opt_gap_pi double, opt_gap double, rho2_k double, gamma_k double, beta_k double, byz_w_k double, hon_w_k double, gamma_k_node array<double>"
OUT = f"{RUN}, k long, {METRICS}"
EDGES = "graph string, split string, atk_id int, grp int, y int, " + ", ".join(f"{f} double" for f in FEATURES)
GRAPHS = {"random_regular": {"deg": 6}, "erdos_renyi": {"p": 0.4}, "complete": {}, "watts_strogatz": {"k": 6, "p": 0.2}, "barabasi_albert": {"m": 3}, "random_geometric": {"r": 0.55}}
ATTACKS = ("label_flip", "sign_flip", "gaussian", "little_is_enough", "inner_product")
ALGORITHMS = ("filtered", "oracle_0", "oracle_1", "outlier_mean", "clipped", "trimmed", "median")
#: Honest neighbours that an attack needs; attackers with fewer abstain.
NEEDS = {"little_is_enough": 2, "inner_product": 1}
TINY = 1e-12
#: A descent is over when no weight moves by more.
SETTLED = 1e-13


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def stream(*path) -> np.random.Generator:
    """A generator addressed by a path of names and numbers."""
    return np.random.default_rng(crc32(repr((12345, *path)).encode()))


def softmax_gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    z = x @ theta
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-np.log(p[rows, y] + 1e-300).mean() + 0.5 * reg * (theta * theta).sum())
    p[rows, y] -= 1
    return loss, x.T @ p / len(y) + reg * theta


def toward(own: np.ndarray, other: np.ndarray, radius: float) -> np.ndarray:
    d = np.linalg.norm(other - own)
    return own if d == 0 else own + min(1.0, radius / d) * (other - own)


def combine(rule: str, i: int, msgs: np.ndarray, w: np.ndarray, near: list[int], q: int) -> np.ndarray:
    """One node's new model from its neighbours' messages."""
    own = msgs[i]
    if rule == "mean":
        return w[i, i] * own + sum(w[i, j] * msgs[j] for j in near)
    if rule == "clipped":
        out = own.copy()
        for j in near:
            d = msgs[j] - own
            n = np.linalg.norm(d)
            out += w[i, j] * d * min(1.0, 0.3 / n if n > 0 else 1.0)
        return out
    if rule == "trimmed":
        m = len(near)
        k = min(q, (m - 1) // 2)
        part = np.sort(msgs[near], axis=0)[k : m - k].mean(axis=0)
        r = 1 / (m + 1 - 2 * k)
        return (1 - r) * part + r * own
    if rule == "median":
        return (1 - w[i, i]) * np.median(msgs[near], axis=0) + w[i, i] * own
    if rule == "outlier_mean":
        trusted = [*near, i]
        for _ in range(q):
            ws = np.array([w[i, j] for j in trusted])
            if ws.sum() == 0 or len(trusted) < 2:
                break
            mean = np.tensordot(ws, msgs[trusted], 1) / ws.sum()
            others = [j for j in trusted if j != i]
            trusted.remove(max(others, key=lambda j: (np.linalg.norm(msgs[j] - mean), -j)))
        ws = np.array([w[i, j] for j in trusted])
        return w[i, i] * own if ws.sum() == 0 else np.tensordot(ws, msgs[trusted], 1) / ws.sum()
    raise ValueError(f"unknown algorithm {rule!r}")


@dataclass(frozen=True)
class Config:
    """Parameters of runs. Rates are per node; pi is the wanted stationary distribution."""

    n: int = 20
    b: int = 3
    rounds: int = 20
    batch: int = 16
    alpha: float = 0.5
    decay: float = 0.25
    reg: float = 0.01
    heterogeneity: float = 100.0
    weights: str = "mh_for"
    pi: tuple = ()
    fpr_mean: float = 0.2
    fpr_spread: float = 0.05
    sys_spread: float = 0.003
    beta: float = 0.1
    threat: str = "T3"
    proj: float = 2.0
    graphs: dict = field(default_factory=lambda: GRAPHS)

    def target(self) -> np.ndarray:
        return np.array(self.pi) if self.pi else np.full(self.n, 1 / self.n)

    def spread(self, mean: float, width: float) -> np.ndarray:
        return np.clip(mean + width * np.linspace(-1, 1, self.n), 0, 0.95)

    def alphas(self) -> np.ndarray:
        return self.alpha / (1 + np.arange(self.rounds) * self.decay)


@dataclass(frozen=True)
class Filter:
    """Decides about neighbours: a fitted linear model over scaled features with each node's threshold, or without one an oracle of the nodes' rates."""

    fnr: np.ndarray
    fpr: np.ndarray
    tau: np.ndarray | None = None
    scaler: dict | None = None
    coefficients: np.ndarray | None = None
    intercept: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        order = scaled_order()
        at = {f: i for i, f in enumerate(FEATURES)}
        z = np.column_stack([(rows[:, at[f]] - self.scaler[f][0]) / self.scaler[f][1] for f in order])
        return 1 / (1 + np.exp(-np.clip(z @ self.coefficients + self.intercept, -500, 500)))


def scaled_order() -> list[str]:
    """Columns of scaled features: heavy ones first."""
    return [*HEAVY, *(f for f in FEATURES if f not in HEAVY)]


def node_weights(near: list[list[int]], target: np.ndarray | None) -> np.ndarray:
    """Metropolis-Hastings weights, for the target distribution where one is given."""
    n = len(near)
    deg = np.array([len(v) for v in near])
    if (deg == 0).any():
        raise ValueError("a node has no neighbour")
    w = np.zeros((n, n))
    for i in range(n):
        for j in near[i]:
            w[i, j] = 1 / (1 + max(deg[i], deg[j])) if target is None else min(1.0, target[j] / deg[j] * deg[i] / target[i]) / deg[i]
    w[np.diag_indices(n)] = 1 - w.sum(axis=1)
    return w


def create_graph(kind: str, seed: int, n: int, b: int, target: np.ndarray | None = None, **kw) -> tuple[list[list[int]], np.ndarray, list[int], list[int]]:
    """(neighbours, weights, attackers, honest nodes): attackers are drawn first, then graphs until the honest part is connected."""
    byz = sorted(stream("graph", kind, seed).choice(n, b, replace=False).tolist())
    edges = graph.sample_until(kind, n, set(byz), seed * 1009, **kw)
    near = [sorted({c if a == i else a for a, c in edges if i in (a, c)}) for i in range(n)]
    return near, node_weights(near, target), byz, [i for i in range(n) if i not in byz]


def dealt(y: np.ndarray, train: np.ndarray, n: int, concentration: float, *path) -> list[np.ndarray]:
    """Each class's samples are cut at the shares of a Dirichlet draw; a node without any gets one."""
    shards: list[list[int]] = [[] for _ in range(n)]
    for c in np.unique(y[train]):
        own = stream("order", *path, int(c)).permutation(train[y[train] == c])
        ends = (np.cumsum(stream("shard", *path, int(c)).dirichlet([concentration] * n))[:-1] * len(own)).astype(int)
        for i, part in enumerate(np.split(own, ends)):
            shards[i] += part.tolist()
    return [np.array(s or [int(train[i % len(train)])]) for i, s in enumerate(shards)]


@dataclass
class State:
    """What a run starts from: the graph, its weights, the shards, and the effective mixing of the honest part."""

    config: Config
    kind: str
    seed: int
    x: np.ndarray
    y: np.ndarray
    fpr: np.ndarray
    b: int

    def __post_init__(self):
        c = self.config
        target = (1 - self.fpr) * c.target() if c.weights == "mh_for" else None
        self.near, self.w, self.byz, self.honest = create_graph(self.kind, self.seed, c.n, self.b, target, **c.graphs[self.kind])
        cut = stream("split").permutation(len(self.y))
        self.test, self.train = cut[: len(self.y) // 3], cut[len(self.y) // 3 :]
        self.shards = dealt(self.y, self.train, c.n, c.heterogeneity, self.seed)
        self.classes = int(self.y.max()) + 1
        own = c.target()[self.honest]
        self.pi = own / own.sum()
        self.q = int(np.ceil(np.mean([len(set(self.byz) & set(self.near[i])) for i in self.honest])))

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.x[self.shards[i]], self.y[self.shards[i]]

    def abstains(self, attack: str) -> np.ndarray:
        need, out = NEEDS.get(attack, 0), np.zeros(self.config.n, bool)
        for i in self.byz:
            out[i] = sum(j in self.honest for j in self.near[i]) < need
        return out

    def sent(self, attack: str, k: int, alpha: float, theta: np.ndarray, attackers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All half steps as they are sent, and the gradients that the nodes took."""
        c, grads, msgs = self.config, np.zeros_like(theta), np.zeros_like(theta)
        quiet = self.abstains(attack)
        for i in range(c.n):
            x, y = self.shard(i)
            pick = stream("batch", self.seed, i, k).permutation(len(y))[: c.batch]
            moved = attack == "label_flip" and i in attackers
            shift = int(stream("shift", self.seed, i).integers(1, max(2, self.classes))) if moved else 0
            _, grads[i] = softmax_gradient(x[pick], (y[pick] + shift) % self.classes, theta[i], c.reg)
            msgs[i] = theta[i] - alpha * grads[i]
        out = msgs.copy()
        for i in attackers:
            good = [j for j in self.near[i] if j in self.honest]
            if attack == "sign_flip":
                out[i] = theta[i] + alpha * grads[i]
            elif attack == "gaussian":
                out[i] = msgs[i] + stream("noise", self.seed, i, k).standard_normal(msgs[i].shape)
            elif attack == "little_is_enough" and not quiet[i]:
                z = z_of(len(self.near[i]) + 1, len(self.near[i]) - len(good) + 1)
                out[i] = msgs[good].mean(axis=0) - z * msgs[good].std(axis=0, ddof=1)
            elif attack == "inner_product" and not quiet[i]:
                out[i] = theta[i] + 0.5 * (theta[good] - msgs[good]).mean(axis=0)
        return out, grads

    def optimum(self, pi: np.ndarray, steps: int = 400) -> np.ndarray:
        """The softmax regression of the honest nodes, weighted by pi: accelerated descent under its own smoothness, to the step that moves no weight by more than SETTLED. All nodes' samples are one product, each weighted by its node's share."""
        c, data = self.config, [self.shard(i) for i in self.honest]
        L = c.reg + 0.5 * max(float(np.linalg.eigvalsh(x.T @ x / len(x))[-1]) for x, _ in data)
        rate = (1 - (c.reg / L) ** 0.5) / (1 + (c.reg / L) ** 0.5)
        x, y = np.concatenate([a for a, _ in data]), np.concatenate([b for _, b in data])
        share = np.repeat(pi / [len(b) for _, b in data], [len(b) for _, b in data])[:, None]
        rows, theta = np.arange(len(y)), np.zeros((self.x.shape[1], self.classes))
        ahead = theta
        for _ in range(steps):
            p = x @ ahead
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            p[rows, y] -= 1
            p *= share
            step = ahead - (x.T @ p + c.reg * ahead) / L
            theta, before = step, theta
            ahead = theta + rate * (theta - before)
            if np.abs(theta - before).max() <= SETTLED:
                break
        return theta

    def goals(self) -> tuple[np.ndarray, np.ndarray]:
        """The optima of equal nodes and of nodes weighted by pi."""
        equal = np.full(len(self.honest), 1 / len(self.honest))
        best = self.optimum(equal)
        return best, best if np.allclose(self.pi, equal, rtol=1e-12, atol=0) else self.optimum(self.pi)


def edge_rows(x: np.ndarray, y: np.ndarray, theta: np.ndarray, grad: np.ndarray, msgs: np.ndarray, alpha: float, reg: float) -> np.ndarray:
    """The nine features of each neighbour's message (m, d, classes), as the node with these samples, model and gradient sees them."""
    m, _, classes = msgs.shape
    d = theta - msgs
    flat, g = d.reshape(m, -1), grad.ravel()
    length, size = np.linalg.norm(flat, axis=1), np.linalg.norm(g) + TINY
    out = dict.fromkeys(FEATURES, np.zeros(m))
    out["cos_g"] = flat @ g / (length * size + TINY)
    out["log_norm_ratio"] = np.log(length / (alpha * size) + TINY)
    out["log_alpha"] = np.full(m, np.log(alpha + TINY))
    gram = np.einsum("mdc,mde->mce", d, d)
    out["stable_rank"] = np.trace(gram, axis1=1, axis2=2) / (np.linalg.eigvalsh(gram)[:, -1] + TINY)
    held = np.bincount(y, minlength=classes)
    present = np.flatnonzero(held)
    sums = np.stack([x[y == c].sum(axis=0) for c in present])
    cos = np.einsum("pd,mdc->mpc", sums, d) / (np.linalg.norm(sums, axis=1)[None, :, None] * np.linalg.norm(d, axis=1)[:, None, :] + TINY)
    turned = (present[:, None] + np.arange(classes)) % classes
    rho = -np.take_along_axis(cos, np.broadcast_to(turned, cos.shape), axis=2).mean(axis=1)
    out["margin"] = rho.max(axis=1) - rho[:, 0]
    z = np.einsum("nd,mdc->mnc", x, msgs)
    top = z.max(axis=2)
    lse = top + np.log(np.exp(z - top[..., None]).sum(axis=2))
    rows = np.arange(len(y))
    ce = (lse - z[:, rows, y]) @ (1 / (len(present) * held[y])) + 0.5 * reg * (msgs * msgs).sum(axis=(1, 2))
    out["acc"] = (z.argmax(axis=2) == y).mean(axis=1)
    if m >= 3:
        middle = np.stack([np.median(np.delete(flat, j, axis=0), axis=0) for j in range(m)])
        dev = np.linalg.norm(flat - middle, axis=1)
        out["cos_gbar"] = (flat * middle).sum(axis=1) / (length * np.linalg.norm(middle, axis=1) + TINY)
        out["log_dev_norm"] = np.log(dev / (np.median(dev) + TINY) + TINY)
        out["ce_diff_nbr"] = ce - np.array([np.median(np.delete(ce, j)) for j in range(m)])
    return np.nan_to_num(np.column_stack([out[f] for f in FEATURES]), nan=0.0, posinf=0.0, neginf=0.0)


def filtered_round(s: State, flags: Callable, sent: np.ndarray, theta: np.ndarray, radius: float, quiet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New models of the honest nodes; tp, fp, tn, fn and their weights for each; how far kept attackers pull each."""
    after, seen, pull = theta.copy(), np.zeros((len(s.honest), 8)), np.zeros(len(s.honest))
    for a, i in enumerate(s.honest):
        near = np.array(s.near[i])
        byz = np.isin(near, s.byz)
        adv, hon = byz & ~quiet[near], ~byz
        bad = flags(i, near, adv, hon)
        w = np.where(bad, 0.0, s.w[i, near])
        moved = [toward(theta[i], sent[j], radius) for j in near]
        after[i] = (1 - w.sum()) * toward(theta[i], sent[i], radius) + sum(v * p for v, p in zip(w, moved, strict=True))
        cases = [bad & adv, bad & hon, ~bad & hon, ~bad & adv]
        seen[a] = [x.sum() for x in cases] + [s.w[i, near][x].sum() for x in cases]
        drawn = sum((v * (p - theta[i]) for v, p, z in zip(w, moved, byz, strict=True) if z), np.zeros_like(theta[i]))
        pull[a] = float((drawn * drawn).sum())
    return after, seen, pull


def play(s: State, attack: str, alg: str, flt: Filter | None, proj: float, look: Callable | None = None, path: tuple = ("flag",)) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(k, models, decisions, pulls) after each round. look(k, theta, sent, grads) sees each round's messages before they are mixed."""
    if attack not in (*ATTACKS, "none"):
        raise ValueError(f"unknown attack {attack!r}")
    c = s.config
    theta = np.zeros((c.n, s.x.shape[1], s.classes))
    attackers, quiet = (s.byz, s.abstains(attack)) if attack != "none" else ([], np.zeros(c.n, bool))
    if attack == "none":  # nobody attacks: all nodes are honest workers
        quiet[s.byz] = True
    for k, alpha in enumerate(c.alphas()):
        sent, grads = s.sent(attack, k, alpha, theta, attackers)
        if look:
            look(k, theta, sent, grads)
        after, seen, pull = theta.copy(), None, None
        if flt is not None:

            def flags(i, near, adv, hon, k=k, alpha=alpha, theta=theta, sent=sent, grads=grads):
                if flt.tau is None:
                    u = stream(*path, s.seed, i, k).random((2, len(near)))
                    return (adv & (u[0] < 1 - flt.fnr[i])) | (hon & (u[1] < flt.fpr[i]))
                x, y = s.shard(i)
                return flt.scores(edge_rows(x, y, theta[i], grads[i], sent[near], alpha, c.reg)) >= flt.tau[i]

            after, seen, pull = filtered_round(s, flags, sent, theta, proj * alpha, quiet)
        else:
            for i in s.honest:
                after[i] = combine(alg, i, sent, s.w, s.near[i], s.q)
        for i in s.byz:
            # attackers mix what was sent, as the graph's weights say
            after[i] = combine("mean", i, sent, s.w, s.near[i], s.q) if attackers or flt is not None else combine(alg, i, sent, s.w, s.near[i], s.q)
        theta = after
        yield k, theta, seen, pull


def summary(s: State, theta: np.ndarray, seen: np.ndarray | None, pull: np.ndarray | None, flt: Filter | None, goals: tuple[np.ndarray, np.ndarray]) -> tuple:
    """METRICS of a round."""
    own, x, y = theta[s.honest], s.x[s.test], s.y[s.test]
    hit = lambda t: float((np.argmax(x @ t, axis=1) == y).mean())
    mean, weighted = own.mean(axis=0), np.tensordot(s.pi, own, 1)
    off = ((own - weighted) ** 2).sum(axis=(1, 2))
    accs = [hit(t) for t in own]
    losses = [softmax_gradient(*s.shard(i), theta[i], s.config.reg)[0] for i in s.honest]
    out = (hit(mean), hit(weighted), float(s.pi @ off), float(off.mean()), float(np.mean(accs)), min(accs), max(accs), min(losses), max(losses), float(np.linalg.norm(weighted - goals[1])), float(np.linalg.norm(weighted - goals[0])))
    if seen is None:
        return (*out, *[None] * 6)
    tp, fp, tn, fn = seen[:, :4].sum(axis=0)
    row = (s.w.sum(axis=1) - np.diag(s.w))[s.honest]
    missed, kept = s.pi @ (seen[:, 7] * flt.fnr[s.honest]), s.pi @ ((row - seen[:, 5]) * (1 - flt.fpr[s.honest]))
    rho = float(s.pi @ pull) if flt.tau is not None else None
    return (*out, rho, float(fp / (fp + tn + TINY)), float(fn / (fn + tp + TINY)), float(missed), float(kept), (seen[:, 1] / (seen[:, 1] + seen[:, 2] + TINY)).tolist())


def filter_of(alg: str, n: int, fitted: Filter | None = None) -> Filter | None:
    """The filter of an algorithm by name; other names are aggregation rules."""
    same = lambda v: np.full(n, float(v))
    known = {"oracle_0": Filter(same(0), same(0)), "oracle_1": Filter(same(1), same(0)), "filtered": fitted or Filter(same(0.1), same(0.05))}
    return known.get(alg)


def state_of(kind: str, seed: int, x: np.ndarray, y: np.ndarray, fitted: Filter | None, config: Config) -> State:
    return State(config, kind, seed, x, y, fitted.fpr if fitted is not None else np.zeros(config.n), config.b)


def run_one(kind: str, attack: str, seed: int, alg: str, x: np.ndarray, y: np.ndarray, fitted: Filter | None = None, proj: float | None = None, config: Config | None = None, goals: tuple[np.ndarray, np.ndarray] | None = None, **how) -> list[tuple]:
    """Rows of OUT. Under threat T0 nobody attacks. Without a fitted filter ``filtered`` is an oracle of fixed rates. goals: the state's, where they are known."""
    c = config or Config(**how)
    if c.threat not in ("T0", "T3"):
        raise ValueError(f"unknown threat model {c.threat!r}")
    s = state_of(kind, seed, x, y, fitted, c)
    attack_ = "none" if c.threat == "T0" else attack
    flt = filter_of(alg, c.n, fitted)
    goals = goals or s.goals()
    rounds = play(s, attack_, alg, flt, c.proj if proj is None else proj)
    return [(kind, attack, seed, alg, k, *summary(s, theta, seen, pull, flt, goals)) for k, theta, seen, pull in rounds]


def projection_constant(kind: str, seed: int, x: np.ndarray, y: np.ndarray, config: Config, b: int, factor: float = 1.2, share: float = 0.8) -> float:
    """factor times the quantile, over all rounds and edges of a run of honest nodes, of the distance between neighbours' half steps over the step size."""
    s = State(config, kind, seed, x, y, config.spread(config.fpr_mean, config.fpr_spread), b)
    alphas, out = config.alphas(), []

    def look(k: int, theta: np.ndarray, sent: np.ndarray, grads: np.ndarray) -> None:
        out.extend(np.linalg.norm(sent[j] - sent[i]) / alphas[k] for i in range(config.n) for j in s.near[i])

    for _ in play(s, "none", "mean", None, 0.0, look):
        pass
    return factor * float(np.quantile(out, share))


#: Seeds of the four sets, as (factor, offset) of the run's.
SPLITS = {"train": (17, 23), "val": (11, 1), "thr": (617, 37), "test": (217, 31)}


def labelled_edges(kind: str, split: str, attack: str, number: int, seed: int, x: np.ndarray, y: np.ndarray, config: Config, b: int, proj: float) -> list[tuple]:
    """Rows of EDGES: features of every neighbour that doesn't abstain, seen by each honest node on half of the rounds, of a run that an oracle of the training rates filters; groups are nodes, apart for each attack."""
    factor, offset = SPLITS[split]
    own = seed * factor + offset
    rates = config.spread(config.fpr_mean, config.fpr_spread)
    s = State(config, kind, own, x, y, rates, b)
    chosen = set(stream("rounds", own).choice(config.rounds, config.rounds // 2, replace=False).tolist())
    alphas, quiet, out = config.alphas(), s.abstains(attack), []

    def look(k: int, theta: np.ndarray, sent: np.ndarray, grads: np.ndarray) -> None:
        if k not in chosen:
            return
        for i in s.honest:
            rows = edge_rows(*s.shard(i), theta[i], grads[i], sent[s.near[i]], alphas[k], config.reg)
            out.extend((kind, split, number, i + 1000 * number, int(j in s.byz), *map(float, row)) for j, row in zip(s.near[i], rows, strict=True) if not quiet[j])

    for _ in play(s, attack, "filtered", Filter(np.full(config.n, config.beta), rates), proj, look, ("label", attack)):
        pass
    return out


def constants(kind: str, seed: int, x: np.ndarray, y: np.ndarray, config: Config, flt: Filter, proj: float) -> dict:
    """The constants of a run's theory: mixing, smoothness, heterogeneity, optima and bounds; those that depend on a node's rate of missed attackers are lists over all nodes."""
    s, c = State(config, kind, seed, x, y, flt.fpr, config.b), config
    h, pi, gamma = len(s.honest), s.pi, flt.fpr[s.honest]
    wh = s.w[np.ix_(s.honest, s.honest)]
    bar = (1 - gamma)[:, None] * wh
    bar[np.diag_indices(h)] = 0
    bar[np.diag_indices(h)] = 1 - bar.sum(axis=1)
    root = np.sqrt(pi)
    lam = float(np.linalg.norm(root[:, None] * (bar - pi) / root, 2))
    edge = pi[:, None] * wh**2 * (gamma * (1 - gamma))[:, None]
    edge[np.diag_indices(h)] = 0
    q = np.diag(edge.sum(axis=1) + edge.sum(axis=0)) - edge - edge.T
    nu2 = float(np.linalg.eigvalsh(q / root[:, None] / root)[-1])
    off = wh - np.diag(np.diag(wh))
    data = [s.shard(i) for i in s.honest]
    L = c.reg + 0.5 * max(float(np.linalg.eigvalsh(a.T @ a / len(a))[-1]) for a, _ in data)
    uniform = np.full(h, 1 / h)
    best, best_pi = s.optimum(uniform), s.optimum(pi)
    union = np.concatenate([a for a, _ in data]), np.concatenate([b for _, b in data])

    def spread(theta: np.ndarray, weight: np.ndarray) -> float:
        g = np.stack([softmax_gradient(a, b, theta, 0.0)[1] for a, b in data])
        return float(weight @ ((g - np.tensordot(weight, g, 1)) ** 2).sum(axis=(1, 2)))

    def within(a: np.ndarray, b: np.ndarray) -> float:
        z = a @ best
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(b)), b] -= 1
        return float(((a * a).sum(axis=1) * (p * p).sum(axis=1)).mean() - ((a.T @ p / len(b)) ** 2).sum())

    toward_byz = s.w[np.ix_(s.honest, s.byz)].sum(axis=1) if s.byz else np.zeros(h)
    sigma, zeta, n, beta = max(within(a, b) for a, b in data), spread(best, uniform), min(len(b) for _, b in data), flt.fnr
    db, db_pi, tau, g = float(toward_byz.max()), float(pi @ toward_byz), proj * c.alpha, 1 - (lam**2 + nu2)
    eps_opt, eps_byz = 8 * L * (1 + beta * db) / (c.reg * h * n), 8 * h * tau * beta * db_pi / (c.alpha * c.reg * n)
    return {
        "g": g, "s2": 1 - g, "lam_pi": lam, "nu2": nu2, "nu2_bound": float(4 * pi.max() / pi.min() * off.max() * (gamma * (1 - gamma)).max()),
        "L": L, "mu": c.reg, "tau": tau, "h": h, "n_loc": n,
        "f_star": softmax_gradient(*union, best, c.reg)[0], "f_pi_star": softmax_gradient(*union, best_pi, c.reg)[0],
        "zeta_sq": zeta, "zeta_sq_pi": spread(best_pi, pi), "sigma_sq": sigma, "dB_max": db, "dB_pi": db_pi,
        "opt_gap_ub": 3 / c.reg**2 * (zeta * h * float(((pi - uniform) ** 2).sum()) + sigma / n * (1 / h + float(pi.max()))),
        "opt_gap_emp": float(((best - best_pi) ** 2).sum()),
        "eps_opt": eps_opt.tolist(), "eps_byz": eps_byz.tolist(), "epsilon": (eps_opt + eps_byz).tolist(), "byz_cons_floor": (proj**2 * beta * db**2 / c.reg**2).tolist(),
        "alpha_max_conv": g / (6 * L), "alpha_max_stab": 2 / (c.reg + L),
    }


def shared_samples(samples: DataFrame, most_bytes: int = 1 << 30):
    """The samples (vec_id, label, x) with a bias, as a broadcast of (x, y); their size is found first. A run's nodes hold all of them, so more than most_bytes raises: cut the samples by node with ``training.class_cuts`` and run the DataFrame operators."""
    size = samples.agg(F.sum(F.size("x") * 8 + 24)).head()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of samples are more than a run holds ({most_bytes})")
    rows = samples.orderBy("vec_id").toPandas()
    return samples.sparkSession.sparkContext.broadcast((np.column_stack([np.stack(rows["x"].to_numpy()), np.ones(len(rows))]), rows["label"].to_numpy().astype(int)))


def simulate(grid: DataFrame, samples: DataFrame, fitted: dict[str, tuple[Filter, float]] | None = None, config: Config | None = None, system_graph: dict[str, str] | None = None, **how) -> DataFrame:
    """Round metrics of every run of the grid (graph, attack, seed, alg), whose runs are listed on the driver; the optima, which attacks and algorithms don't change, are found once for each graph and seed. fitted holds each graph's filter and projection constant, system_graph the graph to run on where it is another one."""
    shared, fitted, c = shared_samples(samples), fitted or {}, config or Config(**how)
    on = system_graph or {}
    spark = grid.sparkSession
    runs = [(*r,) for r in grid.select("graph", "attack", F.col("seed").cast("long"), "alg").distinct().orderBy("graph", "attack", "seed", "alg").collect()]

    def best(part: Iterator[tuple]) -> Iterator[tuple]:
        for name, seed in part:
            flt, _ = fitted.get(name, (None, None))
            yield (name, seed), state_of(on.get(name, name), int(seed), *shared.value, flt, c).goals()

    states = sorted({(name, seed) for name, _, seed, _ in runs})
    goals = dict(spark.sparkContext.parallelize(states, max(1, len(states))).mapPartitions(best).collect())

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, attack, seed, alg in part.itertuples(index=False):
                flt, proj = fitted.get(name, (None, None))
                rows = run_one(on.get(name, name), attack, int(seed), alg, *shared.value, flt, proj, c, goals[name, seed])
                yield pd.DataFrame([(name, *r[1:]) for r in rows], columns=names(OUT))

    # a partition for each run: dealt by a key, Spark would put such small rows into one task
    table = spark.createDataFrame(spark.sparkContext.parallelize(runs, max(1, len(runs))), RUN)
    return table.mapInPandas(one, OUT)


def topology(spark, kinds: list[str], seeds: int, n: int = 20, b: int = 3, gamma: float = 0.05) -> DataFrame:
    """graph, seed, db_max, dh_max, spectral_gap, lam_pi, nu2, g of many sampled graphs."""
    schema = "graph string, seed long, db_max double, dh_max double, spectral_gap double, lam_pi double, nu2 double, g double"

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        kind, seed = key[0], int(key[1])
        _, w, byz, honest = create_graph(kind, seed, n, b, None, **GRAPHS[kind])
        off = w - np.diag(np.diag(w))
        db, dh = off[np.ix_(honest, byz)].sum(axis=1).max(), off[np.ix_(honest, honest)].sum(axis=1).max()
        ww = off[np.ix_(honest, honest)]
        inner = (1 - gamma) * ww
        inner[np.diag_indices(len(honest))] = 1 - inner.sum(axis=1)
        h = len(honest)
        lam = np.linalg.norm(inner - 1 / h, 2)
        edge = ww**2 * gamma * (1 - gamma)
        nu2 = np.linalg.eigvalsh(np.diag(edge.sum(axis=1) + edge.sum(axis=0)) - edge - edge.T)[-1]
        gap = np.sort(np.linalg.eigvals(np.diag(off.sum(axis=1)) - off).real)[1]
        return pd.DataFrame([(kind, seed, db, dh, gap, lam, nu2, 1 - (lam * lam + nu2))], columns=names(schema))

    table = spark.createDataFrame([(k,) for k in kinds], "graph string").crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))
    return table.groupBy("graph", "seed").applyInPandas(one, schema)
