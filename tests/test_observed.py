import time

import pandas as pd
from doctally.operators.observed import Funnel, Gathered, latency, timed_calls
from pyspark.sql import functions as F


def test_figures_of_one_pass(spark):
    funnel = Funnel()
    rows = funnel.step(spark.range(1000), "read", odd=F.count_if(F.col("id") % 2 == 1))
    rows = funnel.step(rows.where("id % 4 = 0"), "kept")
    rows = funnel.step(rows.where("id > 900"), "last")
    rows.write.format("noop").mode("overwrite").save()
    assert funnel.figures() == {"read": {"rows": 1000, "odd": 500}, "kept": {"rows": 250}, "last": {"rows": 24}}
    assert funnel.reductions() == {"kept": 0.75, "last": 0.904}


def test_times_of_calls_are_measured(spark):
    def slow(a: pd.Series, b: pd.Series) -> pd.Series:
        time.sleep(0.002 * len(a))
        return a + b

    funnel = Funnel()
    rows = timed_calls(spark.range(60).select(F.col("id").alias("a"), F.lit(1).alias("b")), slow, ("a", "b"), "long", "sum")
    assert sorted(r["sum"] for r in latency(rows, funnel).collect()) == list(range(1, 61))
    seen = funnel.figures()["latency"]
    assert seen["rows"] == 60 and 2 <= seen["mean"] < 50 and seen["total"] >= 120 and seen["largest"] >= seen["mean"]


def test_a_streams_figures_are_gathered(spark, tmp_path):
    listener = Gathered()
    spark.streams.addListener(listener)
    try:
        for n in (3, 5):
            spark.range(n).write.mode("append").parquet(str(tmp_path / "in"))
            rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("rows"), F.max("id").alias("most"))
            rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        end = time.time() + 20
        while time.time() < end and listener.totals("seen").get("rows", 0) < 8:
            time.sleep(0.2)
        assert listener.totals("seen")["rows"] == 8
    finally:
        spark.streams.removeListener(listener)
