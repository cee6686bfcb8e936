"""A document's way from upload to drift score, for many organisations at once: stages with a ledger, resumed at the first one that is unfinished.

Tables are Parquet folders under a store, a folder for each run (`run=N`). A stage takes the documents whose stage before is done and whose own is not, writes its tables under the run's number, and
then the ledger's rows; rows count only if the ledger names their document and run for the stage that wrote them. So whatever a killed run has left behind is not seen, the next one begins
where it ended, and a batch that is repeated leaves the same tables.

Every table has org_id, and nothing crosses it: documents are the same only within an organisation, candidates, claims and chunks are compared within it, and scores are its own.

States of a document: PENDING (known, nothing done), PROCESSING (parsed, claims not yet there), COMPLETE (claims are there), PARTIAL (a stage after parsing failed), FAILED (it can't be parsed).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import Config
from ..operators import drift as D
from ..operators import pairs as P
from ..operators import reports as R
from ..operators import scan as S
from ..operators import text as T
from ..operators import vectors as V
from ..sources import files
from ..storage import exists, stored
from .debounce import debounced
from .ingest import INGEST

DOCUMENT = "org_id string, doc_id string"
SCHEMAS = {
    "documents": f"{DOCUMENT}, path string, filename string, title string, text string, page_map map<int,int>, tables array<struct<caption:string,cells:array<array<string>>>>, created_at timestamp, owner_department string, authority_level int",
    "chunks": f"{DOCUMENT}, chunk_id string, chunk_index long, content string, token_count long, start_page int, end_page int, embedding array<double>",
    "claims": f"{DOCUMENT}, claim_id string, ord long, content string, source string, importance_weight double, embedding array<double>",
    "pairs": f"{DOCUMENT}, pair_id string, doc_a string, doc_b string, claim_a string, claim_b string, a string, b string, confidence double, band string, scan_path string, is_evolution boolean, inferred boolean, explanation string",
    "alerts": f"{DOCUMENT}, alert_id string, alert_type string, severity string, source_doc_id string, target_doc_id string, title string, description string, status string",
    "scanned": f"{DOCUMENT}, doc_a string, doc_b string",
    "drift": f"{DOCUMENT}, contradictions long, ratio double, mean_confidence double, shift double, decay double, factual double, semantic double, combined double, drift_type string",
}
LEDGER = f"{DOCUMENT}, path string, ok boolean, error string"
#: Runs of retries and reconciliations are numbered from here on.
LATER = 1 << 20


@dataclass
class Store:
    spark: SparkSession
    path: str
    as_of: str
    config: Config = INGEST

    def put(self, name: str, run: int, rows: DataFrame) -> None:
        rows.select(*StructType.fromDDL(SCHEMAS[name]).names).write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")

    def raw(self, name: str) -> DataFrame:
        folder, schema = f"{self.path}/{name}", SCHEMAS[name]
        return self.spark.read.schema(f"{schema}, run long").parquet(folder) if exists(self.spark, folder) else self.spark.createDataFrame([], f"{schema}, run long")

    def ledger(self) -> DataFrame:
        """org_id, doc_id, path, ok, error, stage, run."""
        folder, schema = f"{self.path}/ledger", f"{LEDGER}, stage string, run long"
        return self.spark.read.schema(schema).parquet(folder) if exists(self.spark, folder) else self.spark.createDataFrame([], schema)

    def commit(self, stage: str, run: int, rows: DataFrame) -> None:
        """One file: it is there as a whole or not at all. A run's commit replaces what the same run noted of a failure."""
        rows.select("org_id", "doc_id", "path", "ok", "error").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/stage={stage}/run={run}")

    def done(self, *stages: str) -> DataFrame:
        """org_id, doc_id, run of the documents that a stage is done with."""
        return self.ledger().where(F.col("stage").isin(*stages) & F.col("ok")).select("org_id", "doc_id", "run")

    def table(self, name: str) -> DataFrame:
        """The rows that the ledger vouches for, with their run."""
        return self.raw(name).join(self.done(*WRITES[name]), ["org_id", "doc_id", "run"], "left_semi")

    def versions(self) -> DataFrame:
        """Documents with what they replace, their version and until when they hold."""
        rows = R.version_chain(self.table("documents").drop("text", "tables", "page_map").withColumnRenamed("doc_id", "document_id"))
        return rows.withColumnRenamed("document_id", "doc_id")

    def live(self) -> DataFrame:
        """Documents that no later version has replaced."""
        return self.versions().where("effective_until is null")


# --- stages: each takes the store, the documents that it is due for (org_id, doc_id) and the run ---


def parse(store: Store, batch: DataFrame, run: int) -> None:
    """Files (org_id, path, content, created_at, and if known owner_department, authority_level) to documents; a text that its organisation has already is passed over. Its ledger names every file."""
    for c, kind in (("owner_department", "string"), ("authority_level", "int")):
        batch = batch if c in batch.columns else batch.withColumn(c, F.lit(None).cast(kind))
    found = stored(files.parsed(batch.select("path", "content")).join(batch.drop("content"), "path"))
    text = F.coalesce("text", F.lit(""))
    keyed = found.withColumn("doc_id", F.sha2(F.concat_ws("\n", "org_id", F.when(F.col("error").isNull(), text).otherwise(F.col("path"))), 256))
    filename = F.regexp_extract("path", r"([^/]*)$", 1)
    keyed = stored(keyed.withColumns({"filename": filename, "title": F.regexp_replace(filename, r"\.[^.]*$", ""), "text": text}))
    first = F.row_number().over(Window.partitionBy("org_id", "doc_id").orderBy("created_at", "path"))
    good = keyed.where("error is null").withColumn("_n", first).where("_n = 1").drop("_n")
    known = store.done("parse").where(F.col("run") != run).select("org_id", "doc_id")
    new = good.join(known, ["org_id", "doc_id"], "left_anti")
    store.put("documents", run, new)
    noted = new.select("org_id", "doc_id", "path", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    bad = keyed.where("error is not null").select("org_id", "doc_id", "path", F.lit(False).alias("ok"), "error")
    store.commit("parse", run, stored(noted.unionByName(bad)))


def _of(rows: DataFrame, due: DataFrame) -> DataFrame:
    return rows.join(due.select("org_id", "doc_id"), ["org_id", "doc_id"], "left_semi")


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of a key made of organisation and document with both as columns."""
    return rows.select("doc_id.*", *(c for c in rows.columns if c != "doc_id"))


def chunk(store: Store, due: DataFrame, run: int) -> None:
    docs = _of(store.table("documents"), due)
    rows = _whole(T.chunk_pages(docs.select(F.struct("org_id", "doc_id").alias("doc_id"), "text", "page_map"), store.config))
    store.put("chunks", run, V.hash_embed(rows.withColumn("chunk_id", F.concat_ws("_chunk_", "doc_id", "chunk_index")), "content"))


def claim(store: Store, due: DataFrame, run: int) -> None:
    """Claims of the text and of its tables; a document without any has its chunks as claims."""
    docs = stored(_of(store.table("documents"), due))
    keyed = docs.select(F.struct("org_id", "doc_id").alias("doc_id"), "text", "tables")
    texts = _whole(T.extract_claims(keyed.select("doc_id", "text"))).select("org_id", "doc_id", F.col("pos").alias("ord"), "content", F.lit("text").alias("source"), "importance_weight")
    grids = keyed.select("doc_id", F.posexplode("tables").alias("_n", "_t")).select(F.struct("doc_id", "_n").alias("table_id"), "_t.*")
    cells = T.table_claims(grids, store.config).select("table_id.doc_id", (F.col("table_id._n") * 100_000 + F.col("ord") + 1_000_000_000).alias("ord"), F.col("sentence").alias("content"), F.lit("table").alias("source"), F.lit(1.0).alias("importance_weight"))
    found = stored(texts.unionByName(_whole(cells).select(*texts.columns)))
    bare = _of(store.table("chunks"), due).join(found.select("org_id", "doc_id").distinct(), ["org_id", "doc_id"], "left_anti")
    rows = found.unionByName(bare.select("org_id", "doc_id", F.col("chunk_index").alias("ord"), "content", F.lit("chunk").alias("source"), F.lit(1.0).alias("importance_weight")))
    store.put("claims", run, V.hash_embed(rows.withColumn("claim_id", F.concat_ws("_claim_", "doc_id", "ord")), "content"))


def candidates(store: Store, due: DataFrame) -> DataFrame:
    """org_id, doc_a (due), doc_b: the live documents whose claims are nearest to a due document's chunks."""
    config = store.config
    live = store.live().select("org_id", "doc_id")
    claims = store.table("claims").join(live, ["org_id", "doc_id"], "left_semi").select("org_id", F.col("claim_id").alias("vec_id"), "doc_id", "embedding")
    chunks = _of(store.table("chunks"), due).select("org_id", F.col("chunk_id").alias("query_id"), "doc_id", "embedding")
    found = V.nearest_within(chunks, claims, "org_id", max(4 * config.shortlist_documents, 40), config.shortlist_similarity, apart="doc_id")
    found = found.join(chunks.select("org_id", "query_id", F.col("doc_id").alias("doc_a")), ["org_id", "query_id"]).join(claims.select("org_id", "vec_id", F.col("doc_id").alias("doc_b")), ["org_id", "vec_id"])
    best = found.groupBy("org_id", "doc_a", "doc_b").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("org_id", "doc_a").orderBy(F.desc("similarity"), "doc_b"))
    return best.withColumn("_n", rank).where(F.col("_n") <= config.shortlist_documents).select("org_id", "doc_a", "doc_b")


def scan(store: Store, due: DataFrame, run: int) -> None:
    """Due documents against their candidates."""
    scan_pairs(store, stored(candidates(store, due)), run)


def scan_pairs(store: Store, wanted: DataFrame, run: int) -> None:
    """Each pair (org_id, doc_a, doc_b) by the path that both structures allow: contradictions, what of them is evolution, alerts, and the pairs that were looked at."""
    both = wanted.select("org_id", F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    docs = stored(_of(store.table("documents"), both))
    regular = T.structure_confidence(docs.select("doc_id", "text"))  # ids tell organisations apart
    routed = wanted
    for s in "ab":
        routed = routed.join(regular.select(F.col("doc_id").alias(f"doc_{s}"), F.col("structure_confidence").alias(f"confidence_{s}")), f"doc_{s}", "left")
    routed = stored(P.scan_route(routed.fillna(0.0, ["confidence_a", "confidence_b"]), store.config).select("org_id", "doc_a", "doc_b", "route"))
    columns = ("org_id", "doc_a", "doc_b", "claim_a", "claim_b", "a", "b", "confidence", "band", "scan_path")
    by_structure = S.structured_scan(routed.where("route = 'structured'").select("doc_a", "doc_b"), docs.select("doc_id", "text"), config=store.config).join(routed.drop("route"), ["doc_a", "doc_b"])
    no_claim = F.lit(None).cast("string")
    by_structure = by_structure.withColumnsRenamed({"sentence_a": "a", "sentence_b": "b"}).withColumns({"claim_a": no_claim, "claim_b": no_claim, "scan_path": F.lit("structured")})
    claims = store.table("claims").withColumnRenamed("doc_id", "document_id")
    mine = claims.join(routed.where("route = 'embedding'").select("org_id", F.col("doc_a").alias("document_id")).distinct(), ["org_id", "document_id"], "left_semi")
    partners = claims.join(both.withColumnRenamed("doc_id", "document_id"), ["org_id", "document_id"], "left_semi")
    found = S.claim_pairs(partners.drop("run", "source"), new=mine.drop("run", "source"), config=store.config, within="org_id")
    sides = routed.where("route = 'embedding'").select("org_id", F.least("doc_a", "doc_b").alias("_x"), F.greatest("doc_a", "doc_b").alias("_y")).distinct()
    found = found.withColumns({"_x": F.least("doc_a", "doc_b"), "_y": F.greatest("doc_a", "doc_b")}).join(sides, ["_x", "_y"])
    found = found.withColumnsRenamed({"a_id": "claim_a", "b_id": "claim_b", "score": "confidence"}).withColumn("scan_path", F.lit("embedding"))
    pairs = found.select(*columns).unionByName(by_structure.select(*columns))
    pairs = pairs.withColumn("pair_id", F.sha2(F.concat_ws("\n", "org_id", F.coalesce("claim_a", F.concat_ws("\t", "doc_a", "a")), F.coalesce("claim_b", F.concat_ws("\t", "doc_b", "b"))), 256)).dropDuplicates(["pair_id"])
    pairs = pairs.join(store.table("pairs").where(F.col("run") != run).select("pair_id"), "pair_id", "left_anti")
    contexts = store.versions().select(
        F.col("doc_id").alias("id"), "supersedes", F.col("created_at").alias("from"), F.col("effective_until").alias("until"), F.col("created_at").alias("created"), "version", F.col("owner_department").alias("department"), "title"
    )
    dated = S.split_by_time(pairs, contexts, store.as_of, store.config).withColumn("is_evolution", F.col("class") != "contradiction")
    told = S.explained(dated.withColumn("score", F.col("confidence"))).drop("score")
    told = told.withColumn("explanation", F.when(F.col("is_evolution"), F.concat(F.lit("[Policy Evolution] "), "explanation")).otherwise(F.col("explanation")))
    # what the ledger vouches for goes by a document: that which was due, or the smaller one
    wanted_by = wanted.select("org_id", F.least("doc_a", "doc_b").alias("_x"), F.greatest("doc_a", "doc_b").alias("_y"), F.col("doc_a").alias("doc_id")).groupBy("org_id", "_x", "_y").agg(F.min("doc_id").alias("doc_id"))
    rows = stored(told.withColumns({"_x": F.least("doc_a", "doc_b"), "_y": F.greatest("doc_a", "doc_b")}).join(wanted_by, ["org_id", "_x", "_y"]))
    store.put("pairs", run, rows)
    severe = P.alert_severity(rows.withColumn("requires_review", F.col("band") == "borderline")).join(contexts.select(F.col("id").alias("doc_id"), "title"), "doc_id")
    title = F.concat(F.when(F.col("is_evolution"), "Policy evolution").otherwise("Contradiction"), F.lit(" detected in "), "title")
    other = F.when(F.col("doc_id") == F.col("doc_a"), F.col("doc_b")).otherwise(F.col("doc_a"))
    alerts = severe.select(
        "org_id", "doc_id", F.sha2(F.concat(F.lit("alert "), "pair_id"), 256).alias("alert_id"), F.lit("CONTRADICTION").alias("alert_type"), "severity", F.col("doc_id").alias("source_doc_id"), other.alias("target_doc_id"),
        title.alias("title"), F.col("explanation").alias("description"), F.lit("OPEN").alias("status"),
    )
    store.put("alerts", run, alerts)
    store.put("scanned", run, wanted_by.select("org_id", "doc_id", F.col("_x").alias("doc_a"), F.col("_y").alias("doc_b")))


def score(store: Store, due: DataFrame, run: int) -> None:
    """Drift of every live document of the due documents' organisations."""
    orgs = due.select("org_id").distinct()
    live = stored(store.live().join(orgs, "org_id", "left_semi").select("org_id", "doc_id", "created_at", "authority_level"))
    claims = store.table("claims").where("source != 'chunk'").groupBy("org_id", "doc_id").agg(F.count(F.lit(1)).alias("aligned_claims"))
    docs = live.join(claims, ["org_id", "doc_id"], "left").withColumn("aligned_claims", F.coalesce("aligned_claims", F.lit(0))).withColumnRenamed("doc_id", "document_id")
    ids = live.select("doc_id")
    pairs = store.table("pairs").join(ids.withColumnRenamed("doc_id", "doc_a"), "doc_a", "left_semi").join(ids.withColumnRenamed("doc_id", "doc_b"), "doc_b", "left_semi")
    stats = R.doc_contradiction_stats(docs, pairs.select("doc_a", "doc_b", "is_evolution", "confidence", F.lit(None).cast("string").alias("review_status")))
    chunks = stored(store.table("chunks").join(live, ["org_id", "doc_id"], "left_semi").select("org_id", "chunk_id", "doc_id", "embedding"))
    near = V.nearest_within(chunks.withColumnRenamed("chunk_id", "query_id"), chunks.withColumnRenamed("chunk_id", "vec_id"), "org_id", 10)
    far = near.withColumn("_d", 1 - F.col("similarity")).where("_d > 0.01").join(chunks.select("org_id", F.col("chunk_id").alias("query_id"), F.col("doc_id").alias("document_id")), ["org_id", "query_id"])
    shift = far.groupBy("document_id").agg(F.least(F.lit(1.0), F.avg("_d")).alias("shift"))
    days = F.datediff(F.lit(store.as_of).cast("timestamp"), "created_at").cast("double")
    rows = stats.join(shift, "document_id", "left").withColumns({"shift": F.coalesce("shift", F.lit(0.0)), "decay": D.age_decay(F.coalesce(days, F.lit(0.0)))})
    store.put("drift", run, D.drift_scores(rows).withColumnRenamed("document_id", "doc_id"))


STAGES = (("chunk", chunk), ("claim", claim), ("scan", scan))
#: The stages that vouch for a table's rows.
WRITES = {"documents": ["parse"], "chunks": ["chunk"], "claims": ["claim"]} | dict.fromkeys(("pairs", "alerts", "scanned"), ["scan", "reconcile"])


def resume(store: Store, run: int, stages=STAGES) -> None:
    """Bring every parsed document through the stages that it has not passed yet, whichever run left it. A stage that fails is noted with its error, and raised."""
    before = "parse"
    for name, work in stages:
        due = store.done(before).select("org_id", "doc_id").join(store.done(name).select("org_id", "doc_id"), ["org_id", "doc_id"], "left_anti").distinct()
        due = stored(due.withColumns({"path": F.lit(None).cast("string"), "ok": F.lit(True), "error": F.lit(None).cast("string")}))
        before = name
        if not due.take(1):
            continue
        try:
            work(store, due, run)
        except Exception as problem:
            store.commit(f"{name}_failed", run, due.withColumns({"ok": F.lit(False), "error": F.lit(f"{type(problem).__name__}: {problem}"[:500])}))
            raise
        store.commit(name, run, due)


def process(store: Store, batch: DataFrame, run: int) -> None:
    """One batch of uploads, and what earlier ones left unfinished."""
    if not exists(store.spark, f"{store.path}/ledger/stage=parse/run={run}"):
        parse(store, batch, run)
    resume(store, run)


def statuses(store: Store) -> DataFrame:
    """org_id, doc_id, path, status, failed_stage, error of every file that was parsed or could not be."""
    rows = store.ledger()
    ok = lambda stage: F.max((F.col("stage") == stage) & F.col("ok"))
    kinds = [ok(s) for s in ("parse", "chunk", "claim", "scan")]
    each = rows.groupBy("org_id", "doc_id").agg(
        F.max("path").alias("path"), *(k.alias(f"_{i}") for i, k in enumerate(kinds)), F.max_by(F.when(~F.col("ok"), F.struct("stage", "error")), F.when(~F.col("ok"), F.col("run"))).alias("_bad")
    )
    stage = F.regexp_replace("_bad.stage", "_failed$", "")
    open_ = F.col("_bad").isNotNull() & ~F.element_at(F.create_map(*(x for i, s in enumerate(("parse", "chunk", "claim", "scan")) for x in (F.lit(s), F.col(f"_{i}")))), stage)
    status = F.when(~F.col("_0"), "FAILED").when(open_, "PARTIAL").when(F.col("_2"), "COMPLETE").otherwise("PROCESSING")
    return each.select("org_id", "doc_id", "path", status.alias("status"), F.when(open_, stage).alias("failed_stage"), F.when(open_, F.col("_bad.error")).alias("error"))


def missing_pairs(store: Store, most: int = 200) -> DataFrame:
    """org_id, doc_a < doc_b: the first `most` pairs of live documents of each organisation that no scan has looked at."""
    live = store.live().join(store.done("claim").select("org_id", "doc_id"), ["org_id", "doc_id"], "left_semi").select("org_id", "doc_id")
    a, b = (live.withColumnRenamed("doc_id", f"doc_{s}") for s in "ab")
    missing = a.join(b, "org_id").where("doc_a < doc_b").join(store.table("scanned").select("org_id", "doc_a", "doc_b"), ["org_id", "doc_a", "doc_b"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("org_id").orderBy("doc_a", "doc_b"))
    return missing.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def reconcile(store: Store, run: int, orgs: DataFrame | None = None, most: int = 200) -> int:
    """Scan the first `most` pairs of each organisation that were missed, and note them, so that the next call goes on behind them; how many there were. Repeated until 0 it has looked at all."""
    pairs = missing_pairs(store, most)
    pairs = stored(pairs if orgs is None else pairs.join(orgs, "org_id", "left_semi"))
    n = pairs.count()
    if n:
        number = LATER + run
        scan_pairs(store, pairs, number)
        noted = pairs.select("org_id", F.col("doc_a").alias("doc_id")).distinct()
        store.commit("reconcile", number, noted.withColumns({"path": F.lit(None).cast("string"), "ok": F.lit(True), "error": F.lit(None).cast("string")}))
    return n


def recalculate(store: Store, run: int, orgs: DataFrame | None = None) -> None:
    """Scores of some organisations, or of all."""
    score(store, store.live().select("org_id").distinct() if orgs is None else orgs, run)


def drift(store: Store) -> DataFrame:
    """The last score of each live document."""
    last = F.row_number().over(Window.partitionBy("org_id", "doc_id").orderBy(F.desc("run")))
    rows = store.raw("drift").withColumn("_n", last).where("_n = 1").drop("_n", "run")
    return rows.join(store.live().select("org_id", "doc_id"), ["org_id", "doc_id"], "left_semi")


def pairs(store: Store) -> DataFrame:
    """All pairs; an explanation is valid until its organisation gets a new document."""
    newest = store.done("parse").where(F.col("run") < LATER).groupBy("org_id").agg(F.max("run").alias("_last"))
    return store.table("pairs").join(newest, "org_id", "left").withColumn("explanation_valid", (F.col("run") >= LATER) | (F.col("run") >= F.coalesce("_last", F.lit(0)))).drop("_last")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files <folder>/<organisation>/<file>."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("org_id"), "path", "content", F.col("modificationTime").alias("created_at"))


def watch(store: Store, rows: DataFrame, **trigger) -> StreamingQuery:
    """Bring uploads through the stages as they come; trigger as for DataStreamWriter.trigger (default: what is there, then stop)."""
    query = rows.writeStream.foreachBatch(lambda batch, run: process(replace(store, spark=batch.sparkSession), batch, run)).option("checkpointLocation", f"{store.path}/_uploads")
    return query.trigger(**(trigger or {"availableNow": True})).start()


def follow(store: Store, delay: float = 45, hold: float = 120, **trigger) -> StreamingQuery:
    """Reconcile and score an organisation once for each burst of its documents: the ledger's rows are the events."""
    events = store.spark.readStream.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{store.path}/ledger/stage=scan")

    def settle(batch: DataFrame, run: int) -> None:
        own, orgs = replace(store, spark=batch.sparkSession), stored(batch.select("org_id").distinct())
        if orgs.take(1):
            reconcile(own, run, orgs)
            recalculate(own, run, orgs)

    query = debounced(events.select("org_id"), "org_id", delay, hold).writeStream.foreachBatch(settle).option("checkpointLocation", f"{store.path}/_bursts")
    return query.trigger(**(trigger or {"processingTime": "5 seconds"})).start()
