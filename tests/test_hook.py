import json
import shutil

from doctally.streaming.hook import alert_hook, urgent

ALERTS = "alert_id string, org_id string, alert_type string, severity string, title string, description string"


def test_one_call_for_each_alert_when_a_batch_is_repeated(spark, tmp_path):
    calls, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    (tmp_path / "calls").mkdir()

    def deliver(key, payload):
        import os
        import uuid

        if payload["title"] == "fails once" and not os.path.exists(f"{calls}/failed"):
            open(f"{calls}/failed", "w").close()
            raise OSError("receiver is away")
        with open(f"{calls}/{uuid.uuid4().hex}.json", "w") as file:
            json.dump([key, payload], file)

    spark.dataSource.register(alert_hook(deliver))
    rows = [(f"a{i}", "o", "CONTRADICTION", s, f"t{i}", None) for i, s in enumerate(["high", "medium", "critical", "low", "high"])] + [("b", "o", "CONTRADICTION", "high", "fails once", "d")]
    spark.createDataFrame(rows, ALERTS).repartition(3).write.json(str(tmp_path / "in"))

    def run():
        stream = urgent(spark.readStream.schema(ALERTS).json(str(tmp_path / "in")))
        stream.writeStream.format("alert_hook").option("ledger", ledger).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(json.loads(p.read_text())[1]["alert_id"] for p in (tmp_path / "calls").glob("*.json"))

    assert run() == ["a0", "a2", "a4"]  # the last one's receiver was away
    notes = json.loads((tmp_path / "ledger/batches/0-commit.json").read_text())
    assert notes == {"called": 3, "known": 0, "failed": 1}
    for f in (tmp_path / "check/commits").glob("*0*"):
        f.unlink()  # the batch was not known to have ended
    assert run() == ["a0", "a2", "a4", "b"]
    assert json.loads((tmp_path / "ledger/batches/0-commit.json").read_text()) == {"called": 1, "known": 3, "failed": 0}
    keys = {json.loads(p.read_text())[0] for p in (tmp_path / "calls").glob("*.json")}
    assert len(keys) == 4 and {p.name for p in (tmp_path / "ledger/delivered").iterdir()} == keys


def test_nothing_is_posted_by_itself(spark, tmp_path):
    spark.dataSource.register(alert_hook(name="silent_hook"))
    spark.createDataFrame([("a", "o", "X", "high", "t", "d")], ALERTS).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(ALERTS).json(str(tmp_path / "in"))
    stream.writeStream.format("silent_hook").option("ledger", str(tmp_path / "ledger")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(list((tmp_path / "ledger/delivered").iterdir())) == 1
    shutil.rmtree(tmp_path / "in")
