import json
import time

from doctally.streaming.debounce import debounced
from pyspark.sql import functions as F


def test_a_burst_fires_once_across_a_restart(spark, tmp_path):
    """Five events of one organisation within the delay, a restart between them, are one firing; another organisation has its own."""
    (tmp_path / "in").mkdir()
    written = iter(range(100))

    def event(org, n=1):
        i = next(written)
        part = tmp_path / f"{i}.tmp"
        part.write_text("\n".join(json.dumps({"org_id": org, "doc": k}) for k in range(n)))
        part.rename(tmp_path / "in" / f"{i}.json")

    def start():
        rows = spark.readStream.schema("org_id string, doc long").json(str(tmp_path / "in"))
        out = debounced(rows, "org_id", delay=15, hold=15).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        return out.trigger(processingTime="500 milliseconds").start()

    def fired():
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).groupBy("org_id").agg(F.count(F.lit(1)), F.sum("events")).collect())) if (tmp_path / "out/_spark_metadata").exists() else []

    def until(condition, seconds):
        end = time.time() + seconds
        while time.time() < end and not condition():
            time.sleep(0.3)
        return condition()

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = start()
    try:
        event("a", 2)
        event("b")
        assert until(lambda: query.lastProgress and sum(p["numInputRows"] for p in query.recentProgress) == 3, 60)
        query.stop()
        assert fired() == []
        query = start()
        event("a", 2)
        event("a")
        assert until(lambda: len(fired()) == 2, 60)
        assert fired() == [("a", 1, 5), ("b", 1, 1)]
        # an event after the firing is a new burst
        event("a")
        assert until(lambda: ("a", 2, 6) in fired(), 60)
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
