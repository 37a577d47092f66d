"""Samples, shards and models from Parquet tables; CSV, JSON and Parquet sinks."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str, nodes: int = 20) -> DataFrame:
    """vec_id, label, node_id (arithmetic shard), x (doubles)."""
    table = load(spark, sf_dir, "embeddings")
    return table.select("vec_id", "label", F.pmod(F.col("vec_id") * 7919, F.lit(nodes)).cast("int").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"))


def split(df: DataFrame, key: str = "vec_id", share: float = 0.33) -> DataFrame:
    """Adds ``split`` by integer arithmetic on the key: the same rows are the test set in every run."""
    return df.withColumn("split", F.when(F.pmod(F.col(key) * 40503 + 12345, F.lit(1000)) < int(share * 1000), "test").otherwise("train"))


def coordinates(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", "node_id", F.posexplode("x").alias("c", "v"))


def models(coords: DataFrame) -> DataFrame:
    """node_id, c, v (the half step: mean of the shard), th (the model before: mean of its older half)."""
    older = F.expr("(vec_id div 20) % 2 = 0")
    return coords.groupBy("node_id", "c").agg(F.avg("v").alias("v"), F.avg(F.when(older, F.col("v"))).alias("th"))


def config_key(config: dict) -> str:
    """Names a cached result by its whole configuration."""
    return sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, config: dict, make) -> DataFrame:
    """make()'s rows, from Parquet if they were written under the same configuration before."""
    path = f"{folder}/{config_key(config)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, folder: str, experiment: str, kind: str = "csv") -> None:
    """One directory for each experiment, so that readers discover it as a partition."""
    writer = df.write.mode("overwrite")
    path = f"{folder}/experiment={experiment}"
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def read_results(spark: SparkSession, folder: str, schema: str, kind: str = "csv") -> DataFrame:
    """All experiments below folder, with their name as a column; empty CSV cells are null."""
    if kind == "csv":
        return spark.read.schema(f"{schema}, experiment string").option("header", True).option("basePath", folder).csv(folder)
    return spark.read.option("basePath", folder).parquet(folder)


def write_config(config: dict, path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(json.dumps(config, default=str),)], "config string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
