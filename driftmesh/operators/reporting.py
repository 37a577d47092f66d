"""Result tables: pivots, slices, windows and comparisons."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Rows of all frames, with the frame's name in a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in frames.items()])


def beside(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Two tables side by side by their keys; rows of either alone stay."""
    return a.join(b, on, "full")


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def means(df: DataFrame, by: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    return df.groupBy(*by).agg(*[(F.round(F.avg(c), digits) + F.lit(0.0)).alias(c) for c in columns])


def pivot(df: DataFrame, by: list[str], column: str, values: list[str], value: Column) -> DataFrame:
    """Named values become columns in this order; the list saves a pass that would look for them."""
    return df.groupBy(*by).pivot(column, values).agg(value)


def unpivot(df: DataFrame, by: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(by, columns, name, value)


def cross_section(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value).drop(column)


def from_round(df: DataFrame, least: int, k: str = "k") -> DataFrame:
    """Rounds from ``least`` on; by label, so a negative one keeps all."""
    return df.where(F.col(k) >= least)


def last_rounds(df: DataFrame, by: list[str], n: int, k: str = "k") -> DataFrame:
    """The last n rounds of each group."""
    return df.withColumn("top_", F.max(k).over(Window.partitionBy(*by))).where(F.col(k) > F.col("top_") - n).drop("top_")


def last_value(df: DataFrame, by: list[str], value: Column, order: Column, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, order).alias(name))


def row_best(columns: list[str]) -> Column:
    return F.greatest(*columns)


def where_best(df: DataFrame, columns: list[str], one: str, best: bool = True) -> DataFrame:
    """Rows where ``one`` equals (or differs from) the largest of the columns."""
    same = F.col(one).eqNullSafe(row_best(columns))
    return df.where(same if best else ~same)


def gap_to_best(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *[(F.col(c) - row_best(columns)).alias(c) for c in columns])


def numbered(df: DataFrame, by: list[str], order: list[str], coarse: Column, name: str = "k_") -> DataFrame:
    """Adds each row's place in its group from 0, in the given order. Rows are numbered inside blocks of ``coarse``, which rises with the order; the blocks' counts are summed over one row for each block, so that no group is one task."""
    cut = df.withColumn("cut_", coarse)
    sizes = cut.groupBy(*by, "cut_").agg(F.count("*").alias("n_"))
    before = sizes.select(*by, "cut_", F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("cut_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy(*by, "cut_").orderBy(*order))
    return cut.withColumn("in_", inside).join(before, [*by, "cut_"]).withColumn(name, F.col("before_") + F.col("in_") - 1).drop("cut_", "in_", "before_")


def ewma(df: DataFrame, by: list[str], order: list[str], value: str, span: int, out: str = "ewma", block: int = 512, coarse: Column | None = None) -> DataFrame:
    """Exponentially weighted mean with adjusted weights, a = 2 / (span + 1). ``coarse`` rises with the order and cuts long groups into blocks (see ``numbered``).

    Weights (1 - a)^-k are summed as running sums from the start of each block of
    rows, so that they stay in range; each block's end is carried on to the next
    by the powers that lie between, over one row for each block.
    """
    q = 1 - 2.0 / (span + 1)
    rows = numbered(df, by, order, F.lit(0) if coarse is None else coarse)
    rows = rows.withColumn("b_", F.floor(F.col("k_") / block)).withColumn("j_", F.col("k_") % block)
    up = F.pow(F.lit(q), -F.col("j_"))
    inside = Window.partitionBy(*by, "b_").orderBy("j_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s_", F.sum(F.col(value) * up).over(inside) * F.pow(F.lit(q), F.col("j_"))).withColumn("t_", F.sum(up).over(inside) * F.pow(F.lit(q), F.col("j_")))
    ends = rows.groupBy(*by, "b_").agg(F.max_by("s_", "j_").alias("s"), F.max_by("t_", "j_").alias("t"))
    # two blocks back weigh q^block less each: below double precision after a few
    back = max(1, int(-40 / (block * __import__("math").log(q))) + 1)
    prior = Window.partitionBy(*by).orderBy("b_")
    carry_s = reduce(lambda a, b: a + b, [F.coalesce(F.lag("s", i).over(prior), F.lit(0.0)) * q ** (block * (i - 1)) for i in range(1, back + 1)])
    carry_t = reduce(lambda a, b: a + b, [F.coalesce(F.lag("t", i).over(prior), F.lit(0.0)) * q ** (block * (i - 1)) for i in range(1, back + 1)])
    ends = ends.select(*by, "b_", carry_s.alias("cs_"), carry_t.alias("ct_"))
    decay = F.pow(F.lit(q), F.col("j_") + 1)
    done = rows.join(ends, [*by, "b_"]).withColumn(out, (F.col("s_") + decay * F.col("cs_")) / (F.col("t_") + decay * F.col("ct_")))
    return done.drop("k_", "b_", "j_", "s_", "t_", "cs_", "ct_")


def centre_and_half(lo: str, hi: str) -> tuple[Column, Column, Column]:
    return ((F.col(lo) + F.col(hi)) / 2).alias("centre"), ((F.col(hi) - F.col(lo)) / 2).alias("half"), (F.col(hi) - F.col(lo)).alias("span")


def mapped(column: str, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)], F.col(column))


def parse_vector(text: Column | str) -> Column:
    """Numbers of a bracketed text, ``[0.1 2.  3e-1]``."""
    clean = F.trim(F.regexp_replace(text, r"[\[\],\s]+", " "))
    return F.when(clean == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(clean, " +"), lambda x: x.cast("double")))


def grid(spark, **axes: list) -> DataFrame:
    """All combinations of named values, listed here: a join of each axis's table would multiply their partitions."""
    return spark.createDataFrame(list(product(*axes.values())), list(axes))


def floor_series(df: DataFrame, proj_const: float, db_pi: float, mu: float, test_fnr: float, enough: int = 130, small: float = 0.02, span: int = 30) -> DataFrame:
    """floor: proj_const^2 * EWMA(beta) * db_pi^2 / mu^2 by (grp, k); beta is the test rate where more than ``enough`` rounds have both rates below ``small``."""
    calm = df.groupBy("grp").agg((F.count_if((F.col("beta") < small) & (F.col("gamma") < small)) > enough).alias("calm"))
    smooth = ewma(df, ["grp"], ["k"], "beta", span, coarse=F.floor(F.col("k") / 4096)).join(calm, "grp")
    beta = F.when(F.col("calm"), F.lit(test_fnr)).otherwise(F.col("ewma"))
    return smooth.select("grp", "k", (proj_const**2 * beta * db_pi**2 / mu**2).alias("floor"))
