"""Queries of curves, thresholds and classifiers: labels.quality scored by documents.n_chars."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources.tables import load
from .base import register, tidy

SCORED = "sc AS (SELECT d.doc_id, quality AS y, n_chars / 40000.0e0 AS score, source, lang, toxic, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
CURVE = SCORED + """,
bs AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY 1),
rn AS (SELECT score, p, n, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM bs WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
ROC = CURVE + """,
al AS (SELECT score AS threshold, fp, tp, pos, neg FROM rn UNION ALL SELECT 'inf'::DOUBLE, 0, 0, any_value(pos), any_value(neg) FROM rn),
ld AS (SELECT *, lead(fp) OVER o - 2 * fp + lag(fp) OVER o AS a, lead(tp) OVER o - 2 * tp + lag(tp) OVER o AS b FROM al WINDOW o AS (ORDER BY threshold DESC)),
roc AS (SELECT row_number() OVER (ORDER BY threshold DESC) - 1 AS idx, threshold, CAST(fp AS DOUBLE) / CAST(neg AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(pos AS DOUBLE) AS tpr FROM ld WHERE a IS NULL OR b IS NULL OR a <> 0 OR b <> 0)"""


def scored(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return load(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / 40000.0).alias("score"), "source", "lang", "toxic", "n_chars")


def _finite(c):
    return F.when(c == float("inf"), F.lit(9e9)).otherwise(c)


@register("roc_curve", f"WITH {ROC} SELECT idx, CASE WHEN isinf(threshold) THEN 9e9 ELSE round(threshold, 6) + 0.0e0 END AS threshold, round(fpr, 6) + 0.0e0 AS fpr, round(tpr, 6) + 0.0e0 AS tpr FROM roc", shared=False)
def roc_curve(spark, sf):
    got = evaluate.roc_curve(scored(spark, sf).select("y", "score"))
    return got.select(F.col("idx").cast("long").alias("idx"), F.when(F.col("threshold") == float("inf"), 9e9).otherwise(tidy("threshold")).alias("threshold"), tidy("fpr").alias("fpr"), tidy("tpr").alias("tpr"))


@register("roc_auc", f"WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0 AS r FROM sc) SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * sum(1 - y)), 6) + 0.0e0 AS auc FROM r", shared=False)
def roc_auc(spark, sf):
    return evaluate.auc(scored(spark, sf)).select(tidy("auc").alias("auc"))


@register("auc_by_lang", f"WITH {SCORED}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0e0 AS r FROM sc) SELECT lang, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0e0) / nullif(sum(y) * sum(1 - y), 0), 6) + 0.0e0 AS auc FROM r GROUP BY lang", shared=False)
def auc_by_lang(spark, sf):
    return evaluate.auc(scored(spark, sf), "lang").select("lang", tidy("auc").alias("auc"))


@register("avg_precision", f"WITH {CURVE} SELECT round(sum(CAST(p AS DOUBLE) / CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)), 6) + 0.0e0 AS avg_precision FROM rn", shared=False)
def avg_precision(spark, sf):
    return evaluate.average_precision(scored(spark, sf)).select(tidy("avg_precision").alias("avg_precision"))


@register("pr_curve", f"WITH {CURVE} SELECT round(score, 6) + 0.0e0 AS threshold, round(CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE), 6) + 0.0e0 AS precision, round(CAST(tp AS DOUBLE) / CAST(pos AS DOUBLE), 6) + 0.0e0 AS recall FROM rn", shared=False)
def pr_curve(spark, sf):
    got = evaluate.pr_curve(scored(spark, sf))
    return got.select(*[tidy(c).alias(c) for c in ("threshold", "precision", "recall")])


@register("op_point", f"""WITH {ROC}, pi AS (SELECT avg(CAST(y AS DOUBLE)) AS pi FROM sc)
SELECT round(least(greatest(threshold, 0), 1), 6) + 0.0e0 AS tau, round(fpr, 6) + 0.0e0 AS fpr, round(1 - tpr, 6) + 0.0e0 AS fnr FROM roc CROSS JOIN pi ORDER BY round(pi * (1 - tpr) + (1 - pi) * fpr, 12), threshold DESC LIMIT 1""", shared=False)
def op_point(spark, sf):
    got = evaluate.operating_point(scored(spark, sf).select("y", "score"))
    return got.select(*[tidy(c).alias(c) for c in ("tau", "fpr", "fnr")])


TARGETS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.9]
TARGET_SQL = "tg(target) AS (VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in TARGETS) + ")"
SHOW = "CASE WHEN isinf(threshold) THEN 9e9 ELSE round(threshold, 6) + 0.0e0 END AS threshold"


@register("threshold_asof", f"WITH {ROC}, {TARGET_SQL}, b AS (SELECT target, max(idx) AS idx FROM tg JOIN roc ON fpr <= target GROUP BY 1) SELECT target, b.idx, {SHOW} FROM b JOIN roc ON roc.idx = b.idx", shared=False)
def threshold_asof(spark, sf):
    got = evaluate.threshold_at(scored(spark, sf).select("y", "score"), TARGETS)
    return got.select("target", F.col("idx").cast("long").alias("idx"), F.when(F.col("threshold") == float("inf"), 9e9).otherwise(tidy("threshold")).alias("threshold"))


@register("threshold_nearest", f"""WITH {ROC}, {TARGET_SQL}, b AS (SELECT target, max(idx) AS idx FROM tg JOIN roc ON fpr <= target GROUP BY 1),
c AS (SELECT target, b.idx + CASE WHEN y.fpr IS NOT NULL AND y.fpr - target < target - x.fpr THEN 1 ELSE 0 END AS idx FROM b JOIN roc x ON x.idx = b.idx LEFT JOIN roc y ON y.idx = b.idx + 1)
SELECT target, c.idx, {SHOW} FROM c JOIN roc ON roc.idx = c.idx""", shared=False)
def threshold_nearest(spark, sf):
    got = evaluate.threshold_at(scored(spark, sf).select("y", "score"), TARGETS, "nearest")
    return got.select("target", F.col("idx").cast("long").alias("idx"), F.when(F.col("threshold") == float("inf"), 9e9).otherwise(tidy("threshold")).alias("threshold"))


@register("confusion_at_tau", f"""WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (WHERE score >= 0.05e0 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.05e0 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.05e0 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.05e0 AND y = 0) AS tn FROM sc GROUP BY 1)
SELECT lang, tp, fp, fn, tn, round((tp + fn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) + 0.0e0 AS prevalence, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) + 0.0e0 AS op_prec, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) + 0.0e0 AS op_rec,
round(coalesce(fn / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) + 0.0e0 AS fnr, round(coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0), 6) + 0.0e0 AS fpr FROM c""", shared=False)
def confusion_at_tau(spark, sf):
    got = evaluate.confusion(scored(spark, sf), 0.05, "lang")
    return got.select("lang", "tp", "fp", "fn", "tn", *[tidy(c).alias(c) for c in ("prevalence", "op_prec", "op_rec", "fnr", "fpr")])


@register("separability", f"""WITH {SCORED}, u AS (SELECT y, 'doc_id' AS feature, CAST(doc_id AS DOUBLE) AS score FROM sc UNION ALL SELECT y, 'n_chars', CAST(n_chars AS DOUBLE) FROM sc UNION ALL SELECT y, 'toxic', CAST(toxic AS DOUBLE) FROM sc),
r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2.0e0 AS r FROM u)
SELECT feature, round(2 * (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * sum(1 - y)) - 1, 6) + 0.0e0 AS separability FROM r GROUP BY 1""", shared=False)
def separability(spark, sf):
    return evaluate.separability(scored(spark, sf), ["doc_id", "n_chars", "toxic"]).select("feature", tidy("separability").alias("separability"))


def _features(spark, sf):
    s = scored(spark, sf).withColumn("grp", F.pmod("doc_id", F.lit(7))).withColumn("key", F.col("doc_id"))
    return s.select("key", "grp", "y", "toxic", F.col("toxic").cast("double").alias("f_toxic"), F.log1p("n_chars").alias("f_len"), (F.length("source") * 1.0).alias("f_src"), "lang")


def _models(spark, sf, names):
    rows = _features(spark, sf)
    names_f = ["f_toxic", "f_len", "f_src"]
    train, test = rows.where("grp < 5").cache(), rows.where("grp >= 5")
    out = []
    for name, how in names.items():
        got = evaluate.MODELS[name](train, names_f, **how)(test).select("y", "score").cache()
        a, p = evaluate.auc(got).head(), evaluate.average_precision(got).head()
        out.append((name, round(float(a.auc or 0), 4), round(float(p.avg_precision or 0), 4)))
    return spark.createDataFrame(out, "model string, roc_auc double, avg_prec double")


@register("model_table")
def model_table(spark, sf):
    return _models(spark, sf, {"linear": {}, "kernel": {"components": 8}, "network": {"layers": (8, 4), "rounds": 20}, "trees": {"rounds": 5, "depth": 3}})


@register("grid_search")
def grid_search(spark, sf):
    return evaluate.search(_features(spark, sf), ["f_toxic", "f_len"], "linear", [{"strength": 0.1}, {"strength": 1.0}], folds=2)


@register("permutation_importance")
def permutation_importance(spark, sf):
    """Of a fitted model, on rows that it wasn't fitted on."""
    rows, names = _features(spark, sf), ["f_toxic", "f_len", "f_src"]
    model = evaluate.fit_logistic(rows.where("grp < 4"), names)
    got = evaluate.permutation_importance(rows.where("grp >= 4"), names, model, "key", 3)
    return got.select("feature", "repeat", F.round("drop", 4).alias("drop"))


@register("leave_one_out_table")
def leave_one_out_table(spark, sf):
    """Each language is left out of training once and tested on."""
    rows = _features(spark, sf).cache()
    out = []
    for lang in [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]:
        model = evaluate.fit_logistic(rows.where(F.col("lang") != lang), ["f_toxic", "f_len"])
        got = evaluate.auc(model(rows.where(F.col("lang") == lang)).select("y", "score")).head()
        out.append((lang, round(float(got.auc or 0), 4)))
    return spark.createDataFrame(out, "left_out string, roc_auc double")


@register("train_test_matrix")
def train_test_matrix(spark, sf):
    """Every language's model against every test language: each is trained on the language's first groups, and tested on the others."""
    rows = _features(spark, sf).cache()
    langs = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]
    parts = []
    for lang in langs:
        model = evaluate.fit_logistic(rows.where((F.col("lang") == lang) & (F.col("grp") < 4)), ["f_toxic", "f_len", "f_src"])
        parts.append(model(rows.where("grp >= 4")).select(F.lit(lang).alias("train"), F.col("lang").alias("test"), "y", "score"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return evaluate.auc(every, "train", "test").select("train", "test", F.round("auc", 4).alias("auc"))


@register("config_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, md5(event_type) AS key FROM events""", shared=False)
def config_json(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long").k.alias("k"), F.md5("event_type").alias("key"))


@register("seed_paths")
def seed_paths(spark, sf):
    """Seeds addressed by a path: the checksum of the path's text."""
    names = json.dumps(["graph", "shard", "batch", "noise"])
    paths = spark.range(5).select(F.explode(F.from_json(F.lit(names), "array<string>")).alias("name"), "id")
    return paths.select("name", "id", F.crc32(F.format_string("(12345, '%s', %d)", "name", "id").cast("binary")).alias("seed"))
