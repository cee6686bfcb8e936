import time

import pytest
from doctally.streaming import lifecycle as L
from pyspark.sql import functions as F

FILE = "org_id string, path string, content binary, created_at timestamp, owner_department string"
SOLAR = "Solar electricity output has exceeded the northern regional target of {} percent during spring months."
AS_OF = "2024-06-01 00:00:00"
TABLES = ("documents", "chunks", "claims", "pairs", "alerts", "scanned")


def upload(spark, rows):
    return spark.createDataFrame([(org, f"/in/{org}/{name}", text.encode() if isinstance(text, str) else text, at, dept) for org, name, text, at, dept in rows], FILE).withColumn("created_at", F.col("created_at").cast("timestamp"))


@pytest.fixture
def files():
    from datetime import datetime

    day = lambda d: datetime(2024, 5, d)
    return [
        ("a", "x.txt", SOLAR.format(40), day(1), ""), ("a", "y.txt", SOLAR.format(25), day(2), ""), ("a", "copy.txt", SOLAR.format(40), day(3), ""), ("b", "x.txt", SOLAR.format(40), day(1), ""),
        ("b", "broken.pdf", b"%PDF-1.4 nothing", day(1), ""), ("b", "other.txt", "The cafeteria serves twelve kinds of bread during the winter months.", day(1), ""),
    ]


def seen(store):
    return {t: sorted(map(repr, (r.asDict() for r in store.table(t).drop("run", "embedding", "tables", "page_map").collect()))) for t in TABLES}


def names(store):
    return {r["doc_id"]: (r["org_id"], r["filename"]) for r in store.table("documents").collect()}


def test_two_tenants_that_share_a_text(spark, tmp_path, files):
    store = L.Store(spark, str(tmp_path / "store"), AS_OF)
    L.process(store, upload(spark, files), 0)
    by = names(store)
    assert sorted(by.values()) == [("a", "x.txt"), ("a", "y.txt"), ("b", "other.txt"), ("b", "x.txt")]  # a copy goes within its organisation only
    pairs = store.table("pairs").collect()
    assert [{by[r["doc_a"]], by[r["doc_b"]]} for r in pairs] == [{("a", "x.txt"), ("a", "y.txt")}] and not pairs[0]["is_evolution"]
    alerts = store.table("alerts").collect()
    assert len(alerts) == 1 and alerts[0]["org_id"] == "a" and alerts[0]["severity"] == "high" and alerts[0]["title"].startswith("Contradiction detected in ")
    assert all(by[r["doc_a"]][0] == by[r["doc_b"]][0] == r["org_id"] for r in store.table("scanned").collect())
    states = {(r["org_id"], r["path"].rpartition("/")[2]): r["status"] for r in L.statuses(store).collect()}
    assert states["b", "broken.pdf"] == "FAILED" and {states[k] for k in states if k[1] != "broken.pdf"} == {"COMPLETE"}
    L.recalculate(store, 0)
    scores = {by[r["doc_id"]]: r for r in L.drift(store).collect()}
    assert scores["a", "x.txt"]["contradictions"] == 1 and scores["a", "x.txt"]["combined"] > 30 and scores["b", "x.txt"]["contradictions"] == 0
    assert scores["a", "x.txt"]["factual"] > 0 == scores["b", "x.txt"]["factual"]


def test_each_stage_killed_once(spark, tmp_path, files):
    """Whether a stage dies before or after it wrote, the next run begins there and the tables are those of a run without failure."""
    whole, cut = (L.Store(spark, str(tmp_path / n), AS_OF) for n in ("whole", "cut"))
    L.process(whole, upload(spark, files), 0)
    L.process(cut, upload(spark, files[:0]), 0)
    for run, (name, work) in enumerate(L.STAGES, 1):
        def dies(store, due, number, work=work):
            if number != 2:
                work(store, due, number)
            raise RuntimeError("killed")

        stages = tuple((n, dies if n == name else w) for n, w in L.STAGES)
        if run == 1:
            L.parse(cut, upload(spark, files), run)
        with pytest.raises(RuntimeError, match="killed"):
            L.resume(cut, run, stages)
        states = {(r["status"], r["failed_stage"]) for r in L.statuses(cut).collect() if r["status"] != "FAILED"}
        assert states == {("PARTIAL", name)}
    L.resume(cut, 9)
    assert seen(cut) == seen(whole)
    L.resume(cut, 10)  # nothing is left to do
    assert seen(cut) == seen(whole) and {r["status"] for r in L.statuses(cut).collect()} == {"FAILED", "COMPLETE"}


def test_versions_tables_and_repeated_batches(spark, tmp_path):
    from datetime import datetime

    store = L.Store(spark, str(tmp_path / "store"), AS_OF)
    first = [("a", "plan.txt", SOLAR.format(40), datetime(2024, 1, 1), "legal")]
    L.process(store, upload(spark, first), 0)
    second = [("a", "plan.txt", SOLAR.format(70), datetime(2024, 3, 1), "legal"), ("a", "empty.txt", "", datetime(2024, 3, 1), None)]
    for _ in range(2):
        L.process(store, upload(spark, second), 1)
    rows = store.table("pairs").collect()
    assert len(rows) == 0  # a replaced version is no candidate
    assert {r["filename"]: r["version"] for r in store.live().collect()} == {"plan.txt": 2, "empty.txt": 1}
    assert L.reconcile(store, 0) == 1 and L.reconcile(store, 1) == 0
    # both versions looked at by hand: one that another replaces is evolution
    old, new = (next(r["doc_id"] for r in store.versions().collect() if (r["filename"], r["version"]) == ("plan.txt", v)) for v in (1, 2))
    L.scan_pairs(store, spark.createDataFrame([("a", old, new)], "org_id string, doc_a string, doc_b string"), 77)
    pair = store.raw("pairs").where("run = 77").collect()
    assert [(r["is_evolution"], r["explanation"][:18]) for r in pair] == [(True, "[Policy Evolution]")]
    assert store.table("pairs").count() == 0  # what no stage vouches for is not seen


def test_stream_with_restart_bursts_and_lost_scans(spark, tmp_path, files):
    """Uploads in two starts of the stream; the bursts' stream scans what was lost and scores each organisation once."""
    store = L.Store(spark, str(tmp_path / "store"), AS_OF)

    def drop(org, name, text):
        (tmp_path / "in" / org).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / org / name).write_text(text)

    drop("a", "x.txt", SOLAR.format(40))
    drop("b", "x.txt", SOLAR.format(40))
    L.watch(store, L.uploads(spark, str(tmp_path / "in"))).awaitTermination()
    drop("a", "y.txt", SOLAR.format(25))
    L.watch(store, L.uploads(spark, str(tmp_path / "in"))).awaitTermination()
    by = names(store)
    assert sorted(by.values()) == [("a", "x.txt"), ("a", "y.txt"), ("b", "x.txt")] and store.table("pairs").count() == 1
    invalid = [r["explanation_valid"] for r in L.pairs(store).collect()]
    assert invalid == [True]
    drop("a", "z.txt", "Water is measured in tanks of the southern district offices every single morning.")
    L.watch(store, L.uploads(spark, str(tmp_path / "in"))).awaitTermination()
    assert [r["explanation_valid"] for r in L.pairs(store).collect()] == [False]
    assert L.missing_pairs(store).count() > 0
    query = L.follow(store, 1, 2, processingTime="1 second")
    end = time.time() + 120
    try:
        while time.time() < end and (L.missing_pairs(store).count() or not (tmp_path / "store/drift").exists()):
            time.sleep(1)
    finally:
        time.sleep(3)
        query.stop()
    assert L.missing_pairs(store).count() == 0
    scores = {names(store)[r["doc_id"]]: r["contradictions"] for r in L.drift(store).collect()}
    assert scores == {("a", "x.txt"): 1, ("a", "y.txt"): 1, ("a", "z.txt"): 0, ("b", "x.txt"): 0}


def test_tables_of_files_are_claims(spark, tmp_path):
    """Two files with the same table but for a figure: its cells are claims, and contradict each other, with the pages that the text stands on."""
    from datetime import datetime

    from tests.test_pdf import classic, pages

    def sheet(price: bytes) -> bytes:
        rows = [(b"Item", b"Yearly price"), (b"Green tea pot", price), (b"Copper kettle", b"9.10 euros")]
        drawn = b"100 500 200 90 re S 100 530 m 300 530 l S 100 560 m 300 560 l S 200 500 m 200 590 l S BT /F1 10 Tf "
        cells = b"".join(b"1 0 0 1 %d %d Tm (%s) Tj " % (110 + 100 * j, 570 - 30 * i, c) for i, row in enumerate(rows) for j, c in enumerate(row))
        return classic(pages(drawn + cells + b"ET"))

    store = L.Store(spark, str(tmp_path / "store"), AS_OF)
    L.process(store, upload(spark, [("a", "one.pdf", sheet(b"4.50 euros"), datetime(2024, 5, 1), ""), ("a", "two.pdf", sheet(b"7.25 euros"), datetime(2024, 5, 2), "")]), 0)
    claims = {(r["content"], r["source"]) for r in store.table("claims").collect() if r["source"] == "table"}
    assert ("In page 1, for Green tea pot, the Yearly price is 4.50 euros.", "table") in claims and len(claims) == 3
    found = [{r["a"], r["b"]} for r in store.table("pairs").collect()]
    assert {f"In page 1, for Green tea pot, the Yearly price is {x} euros." for x in ("4.50", "7.25")} in found
    assert {(r["start_page"], r["end_page"]) for r in store.table("chunks").collect()} == {(1, 1)}
