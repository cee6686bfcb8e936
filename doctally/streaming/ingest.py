"""Incremental ingest: a folder of uploads as a stream; each micro-batch is parsed, deduplicated, turned into claims and scanned against the corpus.

Tables are Parquet folders under `store`. A batch writes its rows under its own number (batch=N, overwritten when a batch is run again), so a batch that is repeated after a failure
leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import drift as D
from ..operators import scan as S
from ..operators import text as T
from ..operators import vectors as V
from ..sources import files
from ..storage import exists, stored

DOCUMENTS = "doc_id string, path string, text string"
CLAIMS = "document_id string, claim_id string, content string, embedding array<double>"
PAIR = ("a_id", "b_id", "doc_a", "doc_b", "similarity", "label", "score", "band", "explanation")
#: Batches of reconciliation are numbered from here on.
LATER = 1 << 20
TOPICS = "topic_id int, center array<double>, weight double"
#: Gates that fit hashed words, whose cosines are lower than those of a trained encoder.
INGEST = Config(gate_similarity=0.4, gate_sample=0.0)


def _stored(spark: SparkSession, folder: str, schema: str, before: int) -> DataFrame:
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", folder).parquet(folder)
    return rows.where(F.col("batch") < before).drop("batch")


def _put(rows: DataFrame, store: str, name: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")


def ingest(batch: DataFrame, number: int, store: str, config: Config = INGEST) -> None:
    """One micro-batch of binary files into documents, claims, pairs and topics. Only its own claims are compared with what is stored, and the ledger names the documents that were."""
    spark = batch.sparkSession
    read = files.parsed(batch).where("error is null and text is not null").withColumn("doc_id", F.sha2("text", 256))
    old = _stored(spark, f"{store}/documents", DOCUMENTS, number)
    _put(read.select("doc_id", "path", "text").dropDuplicates(["doc_id"]).join(old.select("doc_id"), "doc_id", "left_anti"), store, "documents", number)
    new = spark.read.schema(DOCUMENTS).parquet(f"{store}/documents/batch={number}")
    claims = T.extract_claims(new).select(F.col("doc_id").alias("document_id"), F.concat_ws("_claim_", "doc_id", "pos").alias("claim_id"), "content")
    coded = V.hash_embed(claims, "content")
    _put(coded, store, "claims", number)
    added = spark.read.schema(CLAIMS).parquet(f"{store}/claims/batch={number}")
    everything = added.unionByName(_stored(spark, f"{store}/claims", CLAIMS, number))
    found = S.claim_pairs(everything, new=added, config=config)
    _put(found.select(*PAIR), store, "pairs", number)
    _put(new.select("doc_id"), store, "scanned", number)
    update_topics(added, number, store)


def update_topics(claims: DataFrame, number: int, store: str, topics: int = 20) -> None:
    """Topic centers (topic_id, center, weight) of the batch: fitted on the first batch with enough claims, moved by each later one."""
    spark = claims.sparkSession
    seen = _stored(spark, f"{store}/topics", f"{TOPICS}, at int", number)
    last = seen.agg(F.max("at")).first()[0]
    points = claims.select(F.col("claim_id").alias("vec_id"), "embedding")
    if last is None:
        centers = V.cluster_fit(points, topics).withColumn("weight", F.lit(1.0))
    else:
        centers = D.minibatch_step(seen.where(F.col("at") == last).drop("at"), points)
    _put(centers.withColumn("at", F.lit(number)), store, "topics", number)


def reconcile(spark: SparkSession, store: str, most: int = 200, config: Config = INGEST) -> DataFrame:
    """Pairs of the first `most` documents whose scan was lost: stored, but not in the ledger. They are written with their documents' place in the ledger, so that the next call goes on behind them.

    To be run now and then, beside the stream; its batches are numbered from LATER on.
    """
    every = 1 << 30
    documents, scanned = _stored(spark, f"{store}/documents", DOCUMENTS, every), _stored(spark, f"{store}/scanned", "doc_id string", every)
    claims = _stored(spark, f"{store}/claims", CLAIMS, every)
    missed = stored(documents.select("doc_id").join(scanned, "doc_id", "left_anti").orderBy("doc_id").limit(most))
    found = stored(S.claim_pairs(claims, new=claims.join(missed.withColumnRenamed("doc_id", "document_id"), "document_id", "left_semi"), config=config).select(*PAIR))
    if missed.take(1):
        number = LATER
        while exists(spark, f"{store}/scanned/batch={number}"):
            number += 1
        known = _stored(spark, f"{store}/pairs", "a_id string, b_id string", every)
        _put(found.join(known, ["a_id", "b_id"], "left_anti").select(*PAIR), store, "pairs", number)
        _put(missed, store, "scanned", number)
    return found


def watch(spark: SparkSession, folder: str, store: str, **trigger) -> StreamingQuery:
    """Ingest files as they appear in folder; trigger as for DataStreamWriter.trigger (default: what is there, then stop). processingTime="15 seconds" gathers uploads, so that each is scanned once."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    query = stream.writeStream.foreachBatch(lambda rows, number: ingest(rows, number, store)).option("checkpointLocation", f"{store}/_checkpoint")
    return query.trigger(**(trigger or {"availableNow": True})).start()
