"""Quality rules judged with their host's record.

Each document is held against rules (below). Failures are added up by host
(``documents`` has ``source`` for it), each host's failure rate is shrunk by a
beta prior fitted to all hosts (moments of the rates, so a host with few
documents leans on the rest), and the verdicts go back to the documents. A host
is good if its rate is below the pool's with probability ``sure``, bad if above
with that probability (normal form of the beta posterior), else neither:

* a base failure rejects;
* a document failing a rule outright (``STRICT``) is rejected;
* a document failing only a mild rule is rejected unless its host is good;
* a document that fails none but one of ``NEAR`` (half the mild limits) is
  rejected if its host is bad;
* every other document is kept, whatever its host.

Null and empty texts have no words and fail the base rule. A null host is a
host like any other. Repeated rows are judged (and count) each by themselves,
and so are rows of one id. An empty table gives an empty table. Only the named
columns are read, so no other can clash. Texts of any length are read whole, in
time in proportion to n log n of their words. Each text is read once; the
measures, a few numbers for each, are written down between the two steps.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, load, map_rows, only

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long"

#: Rules as (name, SQL) of a limit's share: mild ones need a host that isn't good, near ones a bad host, strict ones neither.
LIMITS = (
    ("symbols", "n_symbols > {x} * 0.1 * n_words"),
    ("dup_lines", "n_dup_lines > {x} * 0.3 * n_lines"),
    ("repeats", "n_repeat_words > {x} * 0.2 * n_words"),
    ("upper", "n_upper > {x} * 0.3 * word_chars"),
)
MILD = (*((name, rule.format(x="1.0")) for name, rule in LIMITS), ("word_length", "word_chars > 12 * n_words OR word_chars < 3 * n_words"))
NEAR = tuple((name, rule.format(x="0.5")) for name, rule in LIMITS)
STRICT = (
    ("many_symbols", "n_symbols > n_words"),
    ("all_upper", "n_upper > 0.6 * word_chars"),
    ("many_dup_lines", "n_lines >= 4 AND n_dup_lines > 0.5 * n_lines"),
)
BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
#: The normal quantile of 0.9: how sure a host's verdict must be.
Z = 1.2815515655446004
UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
SYMBOL = re.compile("[#*$%&|<>]")
#: Lines end at \n only.
BLANK = " \t\n\x0b\x0c\r"


def repeated(words: list[str]) -> int:
    """Words that stand in a three-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    own: dict[str, int] = {}
    ids = np.fromiter((own.setdefault(w, len(own)) for w in words), dtype=np.int64, count=n)
    if len(own) == n:
        return 0
    pairs = ids[:-1] * len(own) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * len(own) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for step in range(3):
        covered[step : step + len(windows)] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    text = text or ""
    words = text.split() if text.isascii() and not re.search("[\x1c-\x1f]", text) else WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated(words), len(UPPER.findall(text)), len(lines))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    return map_rows(docs, [id_col, F.col(host_col).cast("string").alias("host"), text_col], lambda _, key, host, text: (key, host, *measure(text)), f"{id_col} long, host string, {MEASURES}")


def judge(measured: DataFrame, z: float = Z) -> DataFrame:
    """Adds base_failed, mild, near, strict, host_rate, good_host, bad_host and kept; z is the normal quantile of ``sure``."""
    cond = lambda rules: F.expr(" OR ".join(f"({sql})" for _, sql in rules))
    flags = durable(measured).withColumns({"base_failed": F.expr(BASE), "mild": cond(MILD), "near": cond(NEAR), "strict": cond(STRICT)})
    flags = flags.withColumn("failed", (F.col("base_failed") | F.col("mild") | F.col("strict")).cast("int"))
    # one row for each host and partition is shuffled; hosts stay distributed
    hosts = flags.groupBy("host").agg(F.sum("failed").alias("bad"), F.count("*").alias("n"))
    prior = hosts.agg(F.sum("bad").alias("sb"), F.sum("n").alias("sn"), F.var_pop(F.col("bad") / F.col("n")).alias("spread"))
    mean = (F.col("sb") + 0.5) / (F.col("sn") + 1.0)
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / F.greatest(F.col("spread"), F.lit(1e-9)) - 1))
    prior = prior.select(mean.alias("mean"), weight.alias("weight"))
    rates = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("bad") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight")))
    # how many standard deviations of its posterior the host lies above the pool
    above = (F.col("host_rate") - F.col("mean")) / F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.col("weight") + 1))
    rates = rates.select(F.col("host").alias("host_"), "host_rate", (above <= -z).alias("good_host"), (above >= z).alias("bad_host"))
    joined = flags.join(rates, F.col("host").eqNullSafe(F.col("host_")), "left").drop("host_")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("strict") & (~F.col("mild") | F.col("good_host")) & (F.col("mild") | ~F.col("near") | ~F.col("bad_host")))


def query(spark, sf_dir: str) -> DataFrame:
    judged = judge(measures(load(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep, with all their columns. Rows are told apart by id, host and text, so rows of one id or of none are judged each by themselves."""
    key = fresh("row_key", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    return only(keyed, judge(measures(keyed, key)).where("kept").select(key).distinct(), key).drop(key)


def sql(z: float = Z) -> str:
    """The query's rows in DuckDB SQL."""
    cond = lambda rules: " OR ".join(f"({x})" for _, x in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, host, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-ÞΑ-ΩА-Я]', '', 'g')) AS n_upper, len(ls) AS n_lines
  FROM w LEFT JOIN cov ON cov.r = w.r),
f AS (SELECT *, {BASE} AS base_failed, {cond(MILD)} AS mild, {cond(STRICT)} AS strict, {cond(NEAR)} AS near FROM m),
h AS (SELECT host, sum(CASE WHEN base_failed OR mild OR strict THEN 1 ELSE 0 END)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM f GROUP BY host),
p AS (SELECT (sum(bad) + 0.5e0) / (sum(n) + 1) AS mean, var_pop(bad / n) AS spread FROM h),
q AS (SELECT mean, greatest(1, least(1e6, mean * (1 - mean) / greatest(spread, 1e-9) - 1)) AS weight FROM p),
rated AS (SELECT host, (bad + mean * weight) / (n + weight) AS host_rate, n + weight + 1 AS size, mean FROM h CROSS JOIN q),
rates AS (SELECT host, (host_rate - mean) / sqrt(host_rate * (1 - host_rate) / size) AS above FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT strict AND (NOT mild OR above <= -({z!r}::DOUBLE)) AND (mild OR NOT near OR above < {z!r}::DOUBLE) AS kept
FROM f JOIN rates ON f.host IS NOT DISTINCT FROM rates.host"""
