"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are Python objects at one time; a batch itself may hold more.
ROWS_AT_ONCE = 256


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_many(df: DataFrame, columns: list, rows: Callable[..., list[tuple]], schema: str, setup: Callable | None = None, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """One output tuple for each row, from the named columns only; rows(state, *lists) gets up to at_once rows.

    setup() runs once in each task and gives the state (None without it).
    Columns that the operator doesn't name are neither read nor passed on.
    """
    fields = [x.split() for x in schema.split(", ")]
    names, types = [x[0] for x in fields], [ARROW[x[1]] for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                out = rows(state, *(c.to_pylist() for c in part.columns))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def map_rows(df: DataFrame, columns: list, row: Callable[..., tuple], schema: str, setup: Callable | None = None) -> DataFrame:
    """map_many for functions of one row: row(state, *values)."""
    return map_many(df, columns, lambda state, *lists: [row(state, *values) for values in zip(*lists, strict=True)], schema, setup)


ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def fresh(name: str, df: DataFrame) -> str:
    """The name, or with underscores behind it until no column has it (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The documents whose id is (left_semi) or isn't (left_anti) in the one column of ids, with all their columns."""
    key = fresh("wanted_id", docs)
    return docs.join(ids.toDF(key), F.col(id_col) == F.col(key), how)


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the checkpoint folder that all executors share.

    The session names the folder in ``spark.checkpoint.dir``. Only a session on one
    machine may name none; it gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-", dir=os.environ.get("TMPDIR")))
    return df.checkpoint(eager=True)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label): the smallest node of each connected component, for every node of an edge (a, b).

    Each round a node takes the smallest label among its own and its neighbours',
    then the label's own label (pointer jumping), so a chain of n nodes needs
    about log n rounds. The labels are written to the checkpoint folder after each.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    # labels only fall, so they are as before if their sum is; hashes stand in for text, decimals can't run over
    value = F.xxhash64("node", "label") if dict(both.dtypes)["a"] == "string" else F.col("label")
    total = lambda df: df.agg(F.sum(value.cast("decimal(20,0)"))).head()[0]
    before = total(labels)
    while rounds:
        heard = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        # the old label hears of the new one too, which keeps hubs' fans from being walked one by one
        least = heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("least"))
        hooked = labels.join(least, "node").select(F.col("label").alias("node"), F.col("least").alias("label")).where("node <> label")
        merged = least.withColumnRenamed("least", "label").unionByName(hooked).groupBy("node").agg(F.min("label").alias("label"))
        up = merged.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        after = durable(merged.join(up, "label", "left").select("node", F.coalesce("upper", "label").alias("label")))
        now = total(after)
        if now == before:
            return after
        labels, before, rounds = after, now, rounds - 1
    raise RuntimeError("components did not settle")


class Codes(dict):
    """Integers by word, made by ``make`` when first asked for; forgotten when there are too many."""

    def __init__(self, make: Callable[[str], int], most: int = 1 << 19):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = self.make(word)
        return x
