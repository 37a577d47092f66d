import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftmesh.streaming import rounds

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def folder(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drained(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return query_df.sparkSession.table(name)


def test_windows(spark, sf, folder):
    got = drained(rounds.windowed(rounds.stream(spark, folder, SCHEMA), "1 day", late="60 days"), "day_counts", "update")
    last = got.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).head()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_smoothed(spark, sf, folder):
    spark.read.parquet(folder).coalesce(1).orderBy("ts", "event_id").write.parquet(folder + "1")
    got = drained(rounds.smoothed(rounds.stream(spark, folder + "1", SCHEMA), 30), "smooth", "update")
    rows = {r.event_type: r.ewma for r in got.collect()}
    events = spark.read.parquet(folder).toPandas().sort_values(["ts", "event_id"])
    for kind, g in events.groupby("event_type"):
        assert rows[kind] == pytest.approx(pd.Series(g["value"]).ewm(span=30).mean().iloc[-1])
