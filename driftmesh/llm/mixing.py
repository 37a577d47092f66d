"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A document of source s is written k times, k drawn from a Poisson distribution
whose mean is the source's repetition rate: (target share x budget) / documents
of s. The draw inverts the distribution at a uniform number made from the MD5
of the document's id and the seed, so it is the same in every run and on every
executor. A rate above MOST is the sum of equal parts, each drawn by itself at a
number of its own (a sum of Poisson draws is one of the sum of the rates), so the
steps to look through stay few, and a document costs time in proportion to its
copies. The copies are then dealt to partitions by a hash of (id, copy) and
sorted by it inside each: a global shuffle in one exchange that no hot source
can skew.

Only as many counts and rates as there are target weights (a parameter), plus
one for all other sources, are made, so the rates are broadcast. A target
source without documents leaves its share to the others. Null ids draw like
the empty id; a null source counts among the others. Repeated rows (same id)
draw the same count each. Empty tables give empty tables. Where the documents
have a column ``copy`` or ``shuffle_key``, the new one has an underscore behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, load

#: Target weights of the query and the pipeline's stage; "" is all other sources.
TARGETS = {"src0": 2.0, "src1": 1.0, "src2": 1.0, "src3": 0.5, "src4": 1.5, "": 14.0}
#: The largest rate of one draw.
MOST = 64.0
#: 12 hexadecimal digits of a digest, as a number in [0, 1).
DIGITS, SPAN = 12, float(1 << 48)


def uniform(key: Column, seed: int, part: Column | None = None) -> Column:
    """In [0, 1), by the id, the seed and, from the second on, the part's number."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    text = text if part is None else F.concat(text, F.when(part == 0, "").otherwise(F.concat(F.lit(":"), part.cast("string"))))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(SPAN)


def rates(docs: DataFrame, targets: dict[str, float], budget: float, source_col: str = "source") -> DataFrame:
    """grp, n, rate, parts and cdf (the steps of a part's distribution up to the resolution of the draw); a row for each weight at most."""
    named = [s for s in targets if s]
    grp = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise("")
    counts = docs.select(grp.alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))
    weights = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    counts = counts.withColumn("w", F.coalesce(weights[F.col("grp")], F.lit(0.0)))
    whole = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    rated = counts.crossJoin(F.broadcast(whole)).withColumn("rate", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") * F.lit(float(budget)) / F.col("n")).otherwise(0.0))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST).cast("int")))
    own = F.col("rate") / F.col("parts")
    # beyond this many steps less than one step of the draw is left
    steps = F.sequence(F.lit(0), F.ceil(own + 12 * F.sqrt(own) + 24).cast("int"))
    logs = F.transform(steps, lambda k: F.when(own > 0, k * F.log(own) - own).otherwise(F.when(k == 0, 0.0).otherwise(F.lit(-1e9))))
    grown = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("log_f"), F.array().cast("array<double>").alias("cdf")),
        lambda a, k: F.struct(
            (a["total"] + F.exp(F.element_at("logs", k + 1) - a["log_f"])).alias("total"),
            (a["log_f"] + F.log(k + 1.0)).alias("log_f"),
            F.concat(a["cdf"], F.array(a["total"] + F.exp(F.element_at("logs", k + 1) - a["log_f"]))).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return rated.withColumn("logs", logs).withColumn("cdf", grown).select("grp", "n", "rate", "parts", "cdf")


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The documents' columns, and ``copy`` (0, 1, ...) and ``shuffle_key``; budget is rows out per row in, on average."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_")
    named = [s for s in targets if s]
    grp = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise("")
    drawn = docs.select(row, grp.alias("grp_"), F.col(id_col).cast("string").alias("id_"))
    table = rates(docs, targets, budget, source_col).select(F.col("grp").alias("grp_"), F.col("parts").alias("parts_"), F.col("cdf").alias("cdf_"))
    one = lambda u: F.size(F.filter("cdf_", lambda c: c <= u))
    several = F.aggregate(F.sequence(F.lit(0), F.col("parts_") - 1), F.lit(0), lambda k, part: k + one(uniform(F.col("id_"), seed, part)))
    single = drawn.join(F.broadcast(table), "grp_").withColumn("u_", uniform(F.col("id_"), seed))
    counted = single.select("row_", F.when(F.col("parts_") == 1, one(F.col("u_"))).otherwise(several).alias("k_"))
    copies = counted.where("k_ > 0").select("row_", F.explode(F.sequence(F.lit(0), F.col("k_") - 1)).alias("copy_"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(f"row_.`{id_col}`").cast("string"), F.lit("")), F.col("copy_").cast("string"), F.lit(str(seed + 1))))
    copies = copies.withColumn("key_", key)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.repartition(n, "key_").sortWithinPartitions("key_")
    return dealt.select(*[F.col(f"row_.`{c}`").alias(c) for c in names], F.col("copy_").alias(fresh("copy", docs)), F.col("key_").alias(fresh("shuffle_key", docs)))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def sql(table: str = "documents", targets: dict[str, float] = TARGETS, budget: float = 1.0, seed: int = 17, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same rows in DuckDB SQL, by the same inversion of the same draw."""
    listed = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in targets.items())
    named = ", ".join(f"'{s}'" for s in targets if s)
    return f"""
WITH RECURSIVE weights(grp, w) AS (VALUES {listed}),
base AS (
  SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '' END AS grp,
    coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}' AS key
  FROM {table}),
counts AS (SELECT b.grp, count(*) AS n, any_value(coalesce(w.w, 0)) AS w FROM base b LEFT JOIN weights w ON b.grp = w.grp GROUP BY b.grp),
rates AS (SELECT grp, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () * sum(n) OVER () * {float(budget)!r}::DOUBLE / n ELSE 0 END AS rate FROM counts),
split AS (SELECT grp, rate, greatest(1, CAST(ceil(rate / {MOST!r}::DOUBLE) AS INTEGER)) AS parts FROM rates),
cdf(grp, rate, k, p, total) AS (
  SELECT grp, rate / parts, 0, exp(-rate / parts), exp(-rate / parts) FROM split
  UNION ALL
  SELECT grp, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
steps AS (SELECT grp, list(total) AS steps FROM cdf GROUP BY grp),
drawn AS (
  SELECT b.*, CAST(list_sum(list_transform(range(parts), lambda j: len(list_filter(s.steps, lambda c: c <=
    ('0x' || substr(md5(b.key || CASE WHEN j = 0 THEN '' ELSE ':' || j END), 1, {DIGITS}))::BIGINT::DOUBLE / {SPAN!r}::DOUBLE)))) AS INTEGER) AS k
  FROM base b JOIN steps s ON b.grp = s.grp JOIN split p ON b.grp = p.grp),
copies AS (SELECT *, unnest(range(k)) AS copy_ FROM drawn)
SELECT {columns}, CAST(copy_ AS INTEGER) AS copy,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy_ AS VARCHAR) || ':{seed + 1}') AS shuffle_key
FROM copies"""
