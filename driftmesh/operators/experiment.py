"""Experiments: a classifier of messages for each graph, runs that filter with it, and their tables.

For each graph an honest run gives the projection constant, oracle-filtered runs
give labelled edges (train, val, thr, test), the edges a scaler and a linear
model, the thr set an operating point and each node's threshold, and the test
set the classifier's metrics. Then every (graph, attack, seed, algorithm) runs
under them. The runs of a stage are one grouped-map job.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import evaluate, features, reporting, simulate
from .simulate import Config, Filter


@dataclass
class Fitted:
    """A graph's classifier: model, scaler, operating point, thresholds and metrics."""

    proj_const: float
    scaler: dict
    coefficients: list
    intercept: float
    op_point: dict
    rates: dict
    metrics: dict

    def filter(self) -> Filter:
        as_array = lambda k: np.array(self.rates[k], float)
        return Filter(as_array("fnr"), as_array("fpr"), as_array("tau"), {f: tuple(v) for f, v in self.scaler.items()}, np.array(self.coefficients, float), self.intercept)


def projection_constants(spark, samples: DataFrame, graphs: list[str], config: Config, seed: int = 0) -> dict[str, float]:
    shared = simulate.shared_samples(samples)

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], simulate.projection_constant(key[0], seed, *shared.value, config, config.b))], columns=["graph", "proj_const"])

    rows = reporting.grid(spark, graph=graphs).groupBy("graph").applyInPandas(one, "graph string, proj_const double").collect()
    return {r.graph: r.proj_const for r in rows}


def labelled_edges(spark, samples: DataFrame, proj: dict[str, float], config: Config, train: tuple[str, ...] = simulate.ATTACKS, test: tuple[str, ...] | None = None, seed: int = 0, splits: tuple[str, ...] = tuple(simulate.SPLITS)) -> DataFrame:
    """simulate.EDGES of all graphs, splits and attacks; the test split has its own attacks."""
    shared = simulate.shared_samples(samples)

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        kind, split, attack, number = key
        rows = simulate.labelled_edges(kind, split, attack, int(number), seed, *shared.value, config, config.b, proj[kind])
        return pd.DataFrame(rows, columns=simulate.names(simulate.EDGES))

    jobs = [(g, s, a, i) for g in proj for s in splits for i, a in enumerate(test if s == "test" and test else train)]
    return spark.createDataFrame(jobs, "graph string, split string, attack string, number int").groupBy("graph", "split", "attack", "number").applyInPandas(one, simulate.EDGES)


def fit(edges: DataFrame, proj_const: float, config: Config, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 5) -> Fitted:
    """A graph's classifier from its labelled edges: the best strength by average precision over folds of groups, and what follows from it."""
    scaler = features.fit_scaler(edges.where("split = 'train'"))
    scaled = features.scale(edges, scaler).cache()
    order = simulate.scaled_order()
    train = scaled.where("split = 'train'")
    found = evaluate.search(train, order, "linear", [{"strength": s} for s in grid], folds).collect()
    best = max(found, key=lambda r: (r.cv_ap, r.setting))
    model = evaluate.fit_logistic(train, order, **json.loads(best.setting))
    thr, test = (model(scaled.where(F.col("split") == s)).select("y", "score").cache() for s in ("thr", "test"))
    at = evaluate.operating_point(thr).head()
    targets = config.spread(at.fpr, config.sys_spread)
    points = {round(r.target, 12): r for r in evaluate.threshold_at(thr, sorted({float(t) for t in targets})).collect()}
    own = [points[round(float(t), 12)] for t in targets]
    rates = {"tau": [min(p.threshold, 1.0) for p in own], "fpr": [p.fpr for p in own], "fnr": [1 - p.tpr for p in own]}
    seen = evaluate.confusion(test, at.tau).head().asDict()
    metrics = {"prevalence": seen["prevalence"], "tau": at.tau, **{k: seen[k] for k in ("tn", "fp", "fn", "tp", "op_prec", "op_rec")}, "beta_C": seen["fnr"], "gamma_C": seen["fpr"], "roc_auc": evaluate.auc(test).head().auc, "avg_prec": evaluate.average_precision(test).head().avg_precision}
    op = {"C_fpr": at.fpr, "C_fnr": at.fnr, "C_tau": at.tau, "C_auc": evaluate.auc(thr).head().auc, "cv_ap": best.cv_ap, "cv_params": best.setting}
    scaled.unpersist()
    return Fitted(proj_const, {f: list(v) for f, v in scaler.items()}, model.coefficients.tolist(), model.intercept, op, rates, metrics)


def save(fitted: dict[str, Fitted], edges: DataFrame, folder: str) -> None:
    """The labelled edges as Parquet by graph, and the models, scalers and feature order as JSON."""
    edges.write.mode("overwrite").partitionBy("graph").parquet(f"{folder}/edges")
    tables.write_config({"order": simulate.scaled_order(), "fitted": {g: asdict(f) for g, f in fitted.items()}}, f"{folder}/fitted", edges.sparkSession)


def restore(spark, folder: str) -> tuple[dict[str, Fitted], DataFrame]:
    got = tables.read_config(spark, f"{folder}/fitted")
    if got["order"] != simulate.scaled_order():
        raise ValueError("the stored features are in another order")
    return {g: Fitted(**f) for g, f in got["fitted"].items()}, spark.read.parquet(f"{folder}/edges")


def theory(spark, samples: DataFrame, fitted: dict[str, Fitted], attacks: list[str], config: Config, seed: int, system_graph: dict[str, str] | None = None) -> DataFrame:
    """simulate.constants of each graph, for each attack."""
    shared, on = simulate.shared_samples(samples), system_graph or {}
    lists = ("eps_opt", "eps_byz", "epsilon", "byz_cons_floor")
    plain = ("g", "s2", "lam_pi", "nu2", "nu2_bound", "L", "mu", "tau", "h", "n_loc", "f_star", "f_pi_star", "zeta_sq", "zeta_sq_pi", "sigma_sq", "dB_max", "dB_pi", "opt_gap_ub", "opt_gap_emp", "alpha_max_conv", "alpha_max_stab")
    schema = "graph string, atk string, " + ", ".join(f"{k} double" for k in plain) + ", " + ", ".join(f"{k} array<double>" for k in lists)

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        own = fitted[key[0]]
        got = simulate.constants(on.get(key[0], key[0]), seed, *shared.value, config, own.filter(), own.proj_const)
        return pd.DataFrame([(key[0], a, *(float(got[k]) for k in plain), *(got[k] for k in lists)) for a in attacks], columns=simulate.names(schema))

    return reporting.grid(spark, graph=list(fitted)).groupBy("graph").applyInPandas(one, schema)


def run_cycle(spark, samples: DataFrame, train: Config, system: Config, graphs: list[str], attacks: list[str], seeds: list[int], algorithms: tuple[str, ...] = simulate.ALGORITHMS, permute: bool = False, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 5) -> dict[str, DataFrame]:
    """clf_metrics, sys_sim (of the first seed), sys_metrics and test_accuracy (mean and deviation over seeds); with permute each graph's classifier filters on the next graph."""
    proj = projection_constants(spark, samples, graphs, train)
    edges = labelled_edges(spark, samples, proj, train, tuple(attacks)).cache()
    fitted = {g: fit(edges.where(F.col("graph") == g), proj[g], system, grid, folds) for g in graphs}
    on = dict(zip(graphs, [*graphs[1:], graphs[0]], strict=True)) if permute else None
    runs = simulate.simulate(reporting.grid(spark, graph=graphs, attack=attacks, seed=seeds, alg=list(algorithms)), samples, {g: (f.filter(), f.proj_const) for g, f in fitted.items()}, system, on)
    rows = [(g, f.proj_const, json.dumps({**f.op_point, **f.metrics}, default=float)) for g, f in fitted.items()]
    fields = {**next(iter(fitted.values())).op_point, **next(iter(fitted.values())).metrics}
    schema = ", ".join(f"{k} {'string' if k == 'cv_params' else 'long' if k in ('tn', 'fp', 'fn', 'tp') else 'double'}" for k in fields)
    clf = spark.createDataFrame(rows, "graph string, proj_const double, m string").select("graph", "proj_const", F.from_json("m", schema).alias("m")).select("graph", "proj_const", "m.*")
    value = F.when(F.col("alg") == "filtered", F.col("test_acc_pi")).otherwise(F.col("test_acc"))
    final = reporting.last_value(runs, ["graph", "attack", "seed", "alg"], value, F.col("k"), "test_acc")
    return {"clf_metrics": clf, "sys_sim": runs.where(F.col("seed") == seeds[0]), "sys_metrics": theory(spark, samples, fitted, attacks, system, seeds[0], on), "test_accuracy": reporting.mean_std(final, ["graph", "attack", "alg"], "test_acc")}


def experiments(train: Config, system: Config) -> dict[str, tuple[Config, Config, bool]]:
    """The eight experiments by name: (training parameters, the system's, whether graphs are permuted)."""
    many = lambda c: replace(c, b=8, graphs={**c.graphs, "random_geometric": {"r": 0.6}})
    uneven = lambda c: replace(c, heterogeneity=2.0)
    drawn = simulate.stream("dir", "graphs").dirichlet(np.full(train.n, 2.0))
    skewed = lambda c: replace(c, pi=tuple((drawn / drawn.sum()).tolist()))
    both = lambda f: (f(train), f(system), False)
    return {
        "tm_0_baseline": (replace(train, b=1), replace(system, b=0, threat="T0"), False),
        "tm_3_baseline": (train, system, False),
        "high_byz": both(many),
        "high_data_het": both(uneven),
        "stress_test": both(lambda c: uneven(many(c))),
        "skewed_edge_weights": both(skewed),
        "worst_case": both(lambda c: skewed(uneven(many(c)))),
        "permute_graphs": (train, system, True),
    }
