"""Queries of the reporting layer: lineitem and events stand for tables of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting as R
from ..sources.tables import load
from .base import register, tidy

FLAGS = ["A", "N", "R"]


def items(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("graph"), F.col("l_linestatus").alias("attack"), F.col("l_linenumber").alias("k"), "l_orderkey", (F.col("l_extendedprice") / 100000).alias("acc"))


ITEMS = "it AS (SELECT l_returnflag AS graph, l_linestatus AS attack, l_linenumber AS k, l_orderkey, l_extendedprice / 100000 AS acc FROM lineitem)"


@register("group_mean_std", f"WITH {ITEMS} SELECT graph, attack, round(avg(acc), 6) + 0.0e0 AS mean, round(stddev_samp(acc), 6) + 0.0e0 AS std FROM it GROUP BY 1, 2", shared=False)
def group_mean_std(spark, sf):
    return R.mean_std(items(spark, sf), ["graph", "attack"], "acc").select("graph", "attack", tidy("mean").alias("mean"), tidy("std").alias("std"))


@register("group_means", "SELECT l_returnflag, round(avg(l_quantity), 4) + 0.0e0 AS l_quantity, round(avg(l_discount), 4) + 0.0e0 AS l_discount, round(avg(l_tax), 4) + 0.0e0 AS l_tax FROM lineitem GROUP BY 1", shared=False)
def group_means(spark, sf):
    return R.means(load(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])


@register("group_ranges", f"WITH {ITEMS} SELECT graph, k, round(min(acc), 6) + 0.0e0 AS lo, round(max(acc), 6) + 0.0e0 AS hi, round((min(acc) + max(acc)) / 2, 6) + 0.0e0 AS centre, round((max(acc) - min(acc)) / 2, 6) + 0.0e0 AS half, round(max(acc) - min(acc), 6) + 0.0e0 AS span FROM it GROUP BY 1, 2", shared=False)
def group_ranges(spark, sf):
    got = items(spark, sf).groupBy("graph", "k").agg(F.min("acc").alias("lo"), F.max("acc").alias("hi"))
    wide = got.select("graph", "k", "lo", "hi", *R.centre_and_half("lo", "hi"))
    return wide.select("graph", "k", *[tidy(c).alias(c) for c in ("lo", "hi", "centre", "half", "span")])


PIVOT = ITEMS + ", pv AS (SELECT attack, k, avg(acc) FILTER (WHERE graph = 'A') AS A, avg(acc) FILTER (WHERE graph = 'N') AS N, avg(acc) FILTER (WHERE graph = 'R') AS R FROM it GROUP BY 1, 2)"


def pivoted(spark, sf):
    return R.pivot(items(spark, sf), ["attack", "k"], "graph", FLAGS, F.avg("acc"))


@register("pivot_alg", f'WITH {PIVOT} SELECT attack, k, round(A, 6) + 0.0e0 AS "A", round(N, 6) + 0.0e0 AS "N", round(R, 6) + 0.0e0 AS "R" FROM pv', shared=False)
def pivot_alg(spark, sf):
    return pivoted(spark, sf).select("attack", "k", *[tidy(c).alias(c) for c in FLAGS])


@register("unpivot_ranges", f"WITH {ITEMS}, x AS (SELECT graph, attack, min(acc) AS lo, max(acc) AS hi FROM it GROUP BY 1, 2) SELECT graph, attack, 'lo' AS stat, round(lo, 6) + 0.0e0 AS value FROM x UNION ALL SELECT graph, attack, 'hi', round(hi, 6) + 0.0e0 FROM x", shared=False)
def unpivot_ranges(spark, sf):
    got = items(spark, sf).groupBy("graph", "attack").agg(tidy(F.min("acc")).alias("lo"), tidy(F.max("acc")).alias("hi"))
    return R.unpivot(got, ["graph", "attack"], ["lo", "hi"], "stat", "value")


@register("outer_concat", "WITH a AS (SELECT o_custkey AS key, count(*) AS n_orders FROM orders GROUP BY 1), b AS (SELECT s_suppkey AS key, count(*) AS n_supp FROM supplier GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, n_orders, n_supp FROM a FULL JOIN b ON a.key = b.key", shared=False)
def outer_concat(spark, sf):
    a = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n_orders"))
    b = load(spark, sf, "supplier").groupBy(F.col("s_suppkey").alias("key")).agg(F.count("*").alias("n_supp"))
    return R.beside(a, b, ["key"])


@register("tagged_union", "SELECT 'customer' AS tag, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2", shared=False)
def tagged_union(spark, sf):
    count = lambda t, c: load(spark, sf, t).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n"))
    return R.tagged_union({"customer": count("customer", "c_nationkey"), "supplier": count("supplier", "s_nationkey")}, "tag")


@register("last_round", "SELECT l_orderkey, arg_max(CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_discount END, l_linenumber) AS final_acc FROM lineitem l JOIN (SELECT l_orderkey AS k FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_linenumber)) u ON u.k = l.l_orderkey GROUP BY 1", shared=False)
def last_round(spark, sf):
    rows = load(spark, sf, "lineitem")
    unique = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("d")).where("n = d").select("l_orderkey")
    value = F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(F.col("l_discount"))
    return R.last_value(rows.join(unique, "l_orderkey", "left_semi"), ["l_orderkey"], value, F.col("l_linenumber"), "final_acc")


@register("best_alg_filter", f"WITH {PIVOT} SELECT attack, k FROM pv WHERE N IS NOT DISTINCT FROM greatest(A, N, R)", shared=False)
def best_alg_filter(spark, sf):
    return R.where_best(pivoted(spark, sf), FLAGS, "N").select("attack", "k")


@register("not_best_filter", f"WITH {PIVOT} SELECT attack, k FROM pv WHERE A IS DISTINCT FROM greatest(A, N, R)", shared=False)
def not_best_filter(spark, sf):
    return R.where_best(pivoted(spark, sf), FLAGS, "A", False).select("attack", "k")


@register("gap_to_best", f'WITH {PIVOT} SELECT attack, k, round(A - greatest(A, N, R), 6) + 0.0e0 AS "A", round(N - greatest(A, N, R), 6) + 0.0e0 AS "N", round(R - greatest(A, N, R), 6) + 0.0e0 AS "R" FROM pv', shared=False)
def gap_to_best(spark, sf):
    return R.gap_to_best(pivoted(spark, sf), FLAGS).select("attack", "k", *[tidy(c).alias(c) for c in FLAGS])


EWMA = """x AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events)"""


@register("ewma", f"""WITH RECURSIVE {EWMA},
w AS (SELECT event_type, event_id, k, value AS s, 1.0e0 AS t FROM x WHERE k = 0 UNION ALL SELECT x.event_type, x.event_id, x.k, w.s * (1 - 2.0e0 / 31) + x.value, w.t * (1 - 2.0e0 / 31) + 1 FROM w JOIN x ON x.event_type = w.event_type AND x.k = w.k + 1)
SELECT event_type, event_id, round(s / t, 6) + 0.0e0 AS ewma FROM w""", shared=False)
def ewma(spark, sf):
    got = R.ewma(load(spark, sf, "events").select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"], "value", 30, coarse=F.to_date("ts"))
    return got.select("event_type", "event_id", tidy("ewma").alias("ewma"))


@register("floor_series", """WITH RECURSIVE x AS (SELECT user_id % 10 AS grp, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS k, value / 5000 AS beta, value / 20000 AS gamma FROM events),
w AS (SELECT grp, k, beta AS s, 1.0e0 AS t FROM x WHERE k = 0 UNION ALL SELECT x.grp, x.k, w.s * (1 - 2.0e0 / 31) + x.beta, w.t * (1 - 2.0e0 / 31) + 1 FROM w JOIN x ON x.grp = w.grp AND x.k = w.k + 1),
c AS (SELECT grp, count(*) FILTER (WHERE beta < 0.02 AND gamma < 0.02) > 600 AS calm FROM x GROUP BY 1)
SELECT w.grp, w.k, round(2.25e0 * CASE WHEN calm THEN 0.01e0 ELSE s / t END * 0.04e0 / 0.01e0, 6) + 0.0e0 AS floor FROM w JOIN c ON c.grp = w.grp""", shared=False)
def floor_series(spark, sf):
    e = load(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), "ts", "event_id", "value")
    rows = R.numbered(e, ["grp"], ["ts", "event_id"], F.to_date("ts"), "k").select("grp", F.col("k").cast("long").alias("k"), (F.col("value") / 5000).alias("beta"), (F.col("value") / 20000).alias("gamma"))
    return R.floor_series(rows, 1.5, 0.2, 0.1, 0.01, 600).select("grp", "k", tidy("floor").alias("floor"))


@register("stability_series", """WITH RECURSIVE x AS (SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, 4 * 17 * (2.0e0 * 0.9e0 * (value / 500) / 17 + 1.5e0 * 25 * 0.05e0 * (value / 1000)) / (0.5e0 * 25) AS eps FROM events),
w AS (SELECT grp, k, eps AS s, 1.0e0 AS t FROM x WHERE k = 0 UNION ALL SELECT x.grp, x.k, w.s * (1 - 2.0e0 / 41) + x.eps, w.t * (1 - 2.0e0 / 41) + 1 FROM w JOIN x ON x.grp = w.grp AND x.k = w.k + 1)
SELECT grp, k, round(s / t, 6) + 0.0e0 AS bound FROM w""", shared=False)
def stability_series(spark, sf):
    from ..operators import rounds

    e = load(spark, sf, "events").select(F.col("user_id").alias("grp"), "ts", "event_id", "value")
    rows = R.numbered(e, ["grp"], ["ts", "event_id"], F.to_date("ts"), "k").select("grp", F.col("k").cast("long").alias("k"), (F.col("value") / 500).alias("hon_w_k"), (F.col("value") / 1000).alias("byz_w_k"))
    return rounds.stability_series(rows, 2.0, 0.5, 17, 25, 1.5, 0.1, 0.05).select("grp", "k", tidy("bound").alias("bound"))


@register("lyapunov", f"WITH {ITEMS}, x AS (SELECT graph, k, var_pop(acc) AS c, avg(acc) AS g FROM it GROUP BY 1, 2) SELECT graph, k, round(c + g * g, 6) + 0.0e0 AS lyapunov FROM x", shared=False)
def lyapunov(spark, sf):
    got = items(spark, sf).groupBy("graph", "k").agg(F.var_pop("acc").alias("c"), F.avg("acc").alias("g"))
    return got.select("graph", "k", tidy(F.col("c") + F.col("g") * F.col("g")).alias("lyapunov"))


@register("count_below", "SELECT event_type, count(*) FILTER (WHERE value < 50) AS n_below, count(*) AS n FROM events GROUP BY 1", shared=False)
def count_below(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 50).alias("n_below"), F.count("*").alias("n"))


@register("range_slice", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber >= -20 GROUP BY 1", shared=False)
def range_slice(spark, sf):
    return R.from_round(load(spark, sf, "lineitem"), -20, "l_linenumber").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("last_rounds", "SELECT l.l_orderkey, l_linenumber, l_quantity FROM lineitem l JOIN (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) t ON t.l_orderkey = l.l_orderkey WHERE l_linenumber > top - 2", shared=False)
def last_rounds(spark, sf):
    return R.last_rounds(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], 2, "l_linenumber")


@register("cross_section", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'", shared=False)
def cross_section(spark, sf):
    return R.cross_section(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", "R")


@register("key_lookup", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2", shared=False)
def key_lookup(spark, sf):
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "n")


@register("anti_attack", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)", shared=False)
def anti_attack(spark, sf):
    rich = load(spark, sf, "supplier").where("s_acctbal > 5000")
    return load(spark, sf, "nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey", "n_name")


@register("other_events", "SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2", shared=False)
def other_events(spark, sf):
    """All kinds but one."""
    e = load(spark, sf, "events")
    left = e.select("event_type").distinct().join(spark.createDataFrame([("view",)], "event_type string"), "event_type", "left_anti")
    return e.join(left, "event_type", "left_semi").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register("membership", "SELECT s_suppkey FROM supplier SEMI JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R'", shared=False)
def membership(spark, sf):
    return load(spark, sf, "supplier").join(load(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@register("param_grid", "SELECT a.r_name AS graph, b.r_name AS attack, CAST(s.range AS BIGINT) AS seed FROM region a CROSS JOIN region b CROSS JOIN range(5) s", shared=False)
def param_grid(spark, sf):
    r = load(spark, sf, "region")
    return r.select(F.col("r_name").alias("graph")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("attack")))).crossJoin(F.broadcast(spark.range(5).select(F.col("id").alias("seed"))))


@register("name_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'CL' WHEN 'purchase' THEN 'PU' WHEN 'signup' THEN 'SU' ELSE event_type END AS short FROM events", shared=False)
def name_map(spark, sf):
    return load(spark, sf, "events").select("event_id", R.mapped("event_type", {"click": "CL", "purchase": "PU", "signup": "SU"}).alias("short"))


@register("renamed_columns", "SELECT p_partkey AS part, p_size AS size, round(p_retailprice, 4) + 0.0e0 AS price FROM part", shared=False)
def renamed_columns(spark, sf):
    return load(spark, sf, "part").withColumnsRenamed({"p_partkey": "part", "p_size": "size"}).select("part", "size", (F.round("p_retailprice", 4) + 0.0).alias("price"))


@register("top_one", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r = 1", shared=False)
def top_one(spark, sf):
    best = F.min(F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("b")
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(best).select("l_suppkey", "b.l_orderkey", "b.l_linenumber")


@register("quantiles", "SELECT event_type, round(quantile_cont(value, 0.8), 6) + 0.0e0 AS q80, round(median(value), 6) + 0.0e0 AS mid FROM events GROUP BY 1", shared=False)
def quantiles(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(tidy(F.percentile("value", F.lit(0.8))).alias("q80"), tidy(F.median("value")).alias("mid"))


@register("vector_parse", "SELECT vec_id, len(embedding) AS d, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4))), 4) + 0.0e0 AS total FROM embeddings", shared=False)
def vector_parse(spark, sf):
    text = F.concat(F.lit("["), F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.format_string("%.12f", F.round(x, 4))), "\n "), F.lit("]"))
    parsed = load(spark, sf, "embeddings").select("vec_id", R.parse_vector(text).alias("v"))
    return parsed.select("vec_id", F.size("v").cast("long").alias("d"), (F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x), 4) + 0.0).alias("total"))


@register("sorted_keys", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders", shared=False)
def sorted_keys(spark, sf):
    """Every order's place by falling date: orders are numbered inside a day, and the days' counts are summed."""
    rows = load(spark, sf, "orders").select(F.lit(0).alias("all"), "o_orderkey", "o_orderdate", (-F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("late"))
    got = R.numbered(rows, ["all"], ["late", "o_orderkey"], F.floor(F.col("late") / 86400), "place")
    return got.select("o_orderkey", (F.col("place") + 1).cast("long").alias("place"))


@register("feature_columns", "SELECT c AS feature, max(v) FILTER (WHERE label = 0) AS c0, max(v) FILTER (WHERE label = 1) AS c1, max(v) FILTER (WHERE label = 2) AS c2 FROM (SELECT label, 'f' || c AS c, round(avg(v), 6) + 0.0e0 AS v FROM (SELECT label, unnest(range(len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2) GROUP BY 1", shared=False)
def feature_columns(spark, sf):
    """A table turned over: features become rows and groups become columns, in a given order."""
    long = load(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("c", "v")).groupBy("label", F.concat(F.lit("f"), "c").alias("feature")).agg(tidy(F.avg("v")).alias("v"))
    return R.pivot(long, ["feature"], "label", [0, 1, 2], F.max("v")).withColumnsRenamed({"0": "c0", "1": "c1", "2": "c2"})


