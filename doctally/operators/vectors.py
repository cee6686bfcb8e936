"""Vector retrieval: exact nearest neighbours, greedy deduplication, clusters, lexical and hybrid search.

Up to BLOCK queries are broadcast and meet every stored vector in matrix products where it is read. More of them are cut into blocks; each block's task walks the stored vectors in
batches, so neither the driver nor a task ever holds more than two blocks. What leaves are the best k of each query.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..storage import filesystem, shared_folder, stored

BLOCK = 2000
#: Terms of queries that are sent to every executor at most (some 20 MB).
BROADCAST_TERMS = 200_000
#: Cosines that a task holds at once (32 MB, and a few copies of them).
COSINES = 4 << 20
DIGITS = 6


def unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 1e-8)


def _best(asked: tuple, there: np.ndarray, groups, stored: np.ndarray, k: int, least: float, skip_self: bool) -> pd.DataFrame:
    """The k best stored vectors of each of asked (ids, groups, unit vectors), at most one row a pair; so many queries at once that no matrix holds more than COSINES."""
    ids, own, matrix = asked
    step = max(1, COSINES // max(1, len(there)))
    if len(ids) > step:
        parts = ((ids[i : i + step], own[i : i + step], matrix[i : i + step]) for i in range(0, len(ids), step))
        return pd.concat([_best(p, there, groups, stored, k, least, skip_self) for p in parts], ignore_index=True)
    sims = np.round(matrix @ stored.T, DIGITS)
    if skip_self:
        sims[ids[:, None] == there[None, :]] = -2.0
    if groups is not None:
        sims[own[:, None] == groups[None, :]] = -2.0
    if k < len(there):  # the ids decide among equal ones, so all that reach the k-th are ordered
        edge = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero((sims >= np.maximum(edge, least)) & (sims >= -1.0))
    else:
        rows, columns = np.nonzero((sims >= least) & (sims >= -1.0))
    order = np.lexsort((there[columns], -sims[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows, "left")
    kept = np.arange(len(rows)) - first < k
    rows, columns = rows[kept], columns[kept]
    return pd.DataFrame({"query_id": ids[rows], "vec_id": there[columns], "similarity": sims[rows, columns]})


def _matrix(embeddings) -> np.ndarray:
    return unit(np.stack(embeddings.to_numpy()).astype(np.float64))


def _walked(asked: DataFrame, there: DataFrame, count: int, k: int, least: float, skip_self: bool, apart: str | None, block: int, schema: str) -> DataFrame:
    """The k best of many queries: vectors are stored once, and a task for each `block` queries walks them in batches, with the best so far in hand. Neither side is copied for the other's blocks."""
    path = shared_folder(there.sparkSession)
    there.write.parquet(path)
    # every task reads all vectors, so no more of them than cores need
    blocks = max(-(-count // block), min(2 * there.sparkSession.sparkContext.defaultParallelism, count // 250))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side, best = (rows["query_id"].to_numpy(), rows["_group"].to_numpy(), _matrix(rows["embedding"])), None
        for batch in _batches(path, block):
            if len(batch):
                best = _better(side, best, batch["vec_id"].to_numpy(), batch["_group"].to_numpy() if apart else None, _matrix(batch["embedding"]), k, least, skip_self)
        if best is None:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        at, ids, sims = best
        return pd.DataFrame({"query_id": side[0][at], "vec_id": ids, "similarity": sims})

    dealt = asked.withColumn("_i", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition(blocks, "_i")
    return dealt.groupBy("_i").applyInPandas(run, schema)


def _batches(path: str, size: int) -> Iterator[pd.DataFrame]:
    """A stored table in batches of at most so many rows, one file after another."""
    from pyarrow import dataset

    system, folder = filesystem(path)
    for batch in dataset.dataset(folder, format="parquet", filesystem=system).to_batches(batch_size=size, batch_readahead=1, fragment_readahead=1, use_threads=False):
        yield batch.to_pandas()


def _better(asked: tuple, best: tuple | None, there: np.ndarray, groups, stored: np.ndarray, k: int, least: float, skip_self: bool) -> tuple:
    """best (places of queries, ids, similarities: the k best so far) after some more vectors; only what reaches a query's k-th so far is looked at."""
    ids, own, matrix = asked
    limit, full = np.full(len(ids), max(least, -1.0)), np.zeros(len(ids), bool)
    if best is not None:
        full = np.bincount(best[0], minlength=len(ids)) >= k
        lowest = np.full(len(ids), np.inf)
        np.minimum.at(lowest, best[0], best[2])
        limit[full] = np.maximum(limit[full], lowest[full])
    step, found = max(1, COSINES // max(1, len(there))), [best] if best is not None else []
    for i in range(0, len(ids), step):
        part = slice(i, i + step)
        sims = matrix[part] @ stored.T
        if skip_self:
            sims[ids[part, None] == there[None, :]] = -2.0
        if groups is not None:
            sims[own[part, None] == groups[None, :]] = -2.0
        if k < len(there) and not full[part].all():
            limit[part] = np.maximum(limit[part], np.round(-np.partition(-sims, k - 1, axis=1)[:, k - 1], DIGITS))
        rows, columns = np.nonzero(sims >= limit[part, None] - 10.0**-DIGITS)
        near = np.round(sims[rows, columns], DIGITS)
        kept = near >= limit[part][rows]
        found.append((rows[kept] + i, there[columns[kept]], near[kept]))
    return _first(*(np.concatenate(x) for x in zip(*found, strict=True)), k)


def _first(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple:
    """The k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -sims, rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[kept], ids[kept], sims[kept]


def nearest(queries: DataFrame, stored: DataFrame, k: int, least: float = -1.0, skip_self: bool = False, apart: str | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest by cosine of each query (query_id, embedding) among the stored (vec_id, embedding).

    Similarities are rounded to six digits; ties go to the smaller id. apart: a column of both sides that a pair must not share.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), stored.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double"
    group = (F.col(apart) if apart else F.lit(0)).alias("_group")
    asked, there = queries.select("query_id", group, "embedding"), stored.select("vec_id", group, "embedding")
    count = asked.count()
    if count <= block:
        rows = asked.toPandas()
        shared = queries.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), rows["_group"].to_numpy(), _matrix(rows["embedding"]) if len(rows) else None))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(shared.value[0]):
                    yield _best(shared.value, batch["vec_id"].to_numpy(), batch["_group"].to_numpy() if apart else None, _matrix(batch["embedding"]), k, least, skip_self)

        found = there.mapInPandas(scan, schema)
    else:
        found = _walked(asked, there, count, k, least, skip_self, apart, block, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest_within(queries: DataFrame, stored: DataFrame, within: str, k: int, least: float = -1.0, skip_self: bool = False, apart: str | None = None, block: int = BLOCK) -> DataFrame:
    """As nearest, among the stored vectors that share the column `within` (an organisation, say) with the query; the result has it too.

    Queries and vectors of each value are dealt into as many blocks as they need, and two blocks of one value meet in a task: values never meet, and a value with a third of all vectors is many tasks.
    """
    kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((queries, within), (queries, "query_id"), (stored, "vec_id"))]
    group = (F.col(apart) if apart else F.lit(0)).alias("_group")
    asked, there = queries.select(within, "query_id", group, "embedding"), stored.select(within, "vec_id", group, "embedding")
    blocks = lambda rows, name: rows.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = blocks(asked, "_m").join(blocks(there, "_n"), within)
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, within).withColumn("_i", spread("query_id", "_m")).withColumn("_j", every("_n"))
    right = there.join(sizes, within).withColumn("_j", spread("vec_id", "_n")).withColumn("_i", every("_m"))
    # fresh columns: both sides may come from one frame
    left, right = (t.select(*(F.col(c).alias(c) for c in (within, "_i", "_j", c, "_group", "embedding"))) for t, c in ((left, "query_id"), (right, "vec_id")))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({within: [], "query_id": [], "vec_id": [], "similarity": []})
        side = (a["query_id"].to_numpy(), a["_group"].to_numpy(), _matrix(a["embedding"]))
        found = _best(side, b["vec_id"].to_numpy(), b["_group"].to_numpy() if apart else None, _matrix(b["embedding"]), k, least, skip_self)
        found.insert(0, within, a[within].iloc[0])
        return found

    found = left.groupBy(within, "_i", "_j").cogroup(right.groupBy(within, "_i", "_j")).applyInPandas(meet, f"{', '.join(kinds)}, similarity double")
    rank = F.row_number().over(Window.partitionBy(within, "query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def similar_within(vectors: DataFrame, within: str, least: float, block: int = 1000) -> DataFrame:
    """a_id < b_id, similarity: all pairs of vectors (vec_id, embedding, and a column `within` that both must share) that reach `least`.

    The vectors of each value are dealt into as many blocks as they need, and each two blocks meet in a task; only the pairs that reach the limit leave.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.where("embedding is not null and vec_id is not null").select(within, "vec_id", "embedding")
    sizes = rows.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    rows = rows.join(sizes, within).withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")}).drop("_other", "_n")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["_low"].iloc[0], rows["_high"].iloc[0]
        a, b = rows[rows["_own"] == low], rows[rows["_own"] == high]
        if not len(a) or not len(b):
            return pd.DataFrame({"a_id": [], "b_id": [], "similarity": []})
        x, y = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        sims = np.round(_matrix(a["embedding"]) @ _matrix(b["embedding"]).T, DIGITS)
        i, j = np.nonzero((sims >= least) & ((x[:, None] < y[None, :]) if low == high else (x[:, None] != y[None, :])))
        return pd.DataFrame({"a_id": np.minimum(x[i], y[j]), "b_id": np.maximum(x[i], y[j]), "similarity": sims[i, j]})

    return rows.groupBy(within, "_low", "_high").applyInPandas(meet, f"a_id {kind}, b_id {kind}, similarity double")


def partner_ranks(queries: DataFrame, stored: DataFrame, block: int = BLOCK) -> DataFrame:
    """query_id, rank: where each query's partner (query_id, embedding, partner_id) comes among all stored vectors; a partner that isn't stored has no rank.

    Each batch of stored vectors only counts, for at most about `block` queries, how many come before the partner; more queries take further passes.
    """
    parts, found = max(1, -(-queries.count() // block)), None
    for i in range(parts):
        rows = _partner_ranks(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), stored)
        found = rows if found is None else found.unionByName(rows)
    return found


def _partner_ranks(queries: DataFrame, stored: DataFrame) -> DataFrame:
    partner = stored.select(F.col("vec_id").alias("partner_id"), F.col("embedding").alias("_partner"))
    rows = queries.select("query_id", "embedding", "partner_id").join(partner, "partner_id")
    asked = rows.toPandas()
    kind = queries.schema["query_id"].dataType.simpleString()
    if not len(asked):
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, rank long")
    mine = _matrix(asked["embedding"])
    reach = np.round((mine * _matrix(asked["_partner"])).sum(1), DIGITS)
    shared = queries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), asked["partner_id"].to_numpy(), mine, reach))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, partners, matrix, limit = shared.value
        before = np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                sims, there = np.round(matrix @ _matrix(batch["embedding"]).T, DIGITS), batch["vec_id"].to_numpy()
                before += ((sims > limit[:, None]) | ((sims == limit[:, None]) & (there[None, :] < partners[:, None]))).sum(1)
        yield pd.DataFrame({"query_id": ids, "n": before})

    counted = stored.select("vec_id", "embedding").mapInPandas(run, f"query_id {kind}, n long")
    return counted.groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))


def semantic_search(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """The nearest with score: the similarity, not below zero, to four digits."""
    return nearest(queries, stored, k).withColumn("score", F.round(F.greatest(F.lit(0.0), "similarity"), 4))


def shortlist(queries: DataFrame, stored: DataFrame, live: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Candidate documents of each document: queries hold (query_id, source_id, embedding), stored (vec_id, document_id, embedding), live document_id."""
    k = max(4 * config.shortlist_documents, 40)
    found = nearest(queries, stored, k, config.shortlist_similarity)
    found = found.join(queries.select("query_id", "source_id"), "query_id").join(stored.select("vec_id", "document_id"), "vec_id").where("document_id != source_id")
    best = found.groupBy("source_id", "document_id").agg(F.max("similarity").alias("similarity")).join(live, "document_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("similarity"), "document_id"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= config.shortlist_documents)


def _kept_first(rows: DataFrame, limit: float) -> DataFrame:
    """group_id, vec_id, representative by order of ids, each group in one task: a matrix product for each 512 vectors against what is kept so far."""
    group, vec = (rows.schema[c].dataType.simpleString() for c in ("group_id", "vec_id"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        matrix, ids = _matrix(rows["embedding"]), rows["vec_id"].to_numpy()
        kept: list[int] = []
        stands = np.arange(len(ids))
        for start in range(0, len(ids), 512):
            stop = min(start + 512, len(ids))
            before = list(kept)
            old = np.round(matrix[start:stop] @ matrix[before].T, DIGITS) >= limit if before else np.zeros((stop - start, 0), bool)
            own = np.round(matrix[start:stop] @ matrix[start:stop].T, DIGITS) >= limit
            for i in range(start, stop):
                hits = np.flatnonzero(old[i - start])
                first = before[hits[0]] if len(hits) else next((j for j in kept[len(before) :] if own[i - start, j - start]), None)
                if first is None:
                    kept.append(i)
                else:
                    stands[i] = first
        return pd.DataFrame({"group_id": rows["group_id"].to_numpy(), "vec_id": ids, "representative": ids[stands]})

    return rows.groupBy("group_id").applyInPandas(run, f"group_id {group}, vec_id {vec}, representative {vec}")


def deduplicate(vectors: DataFrame, config: Config = DEFAULT, most: int = 4096) -> DataFrame:
    """group_id, vec_id, representative: in order of ids a vector is dropped if an earlier kept one of its group is as similar as the limit; the first such one represents it.

    Works in rounds: the first `most` open vectors of each group are settled in one task, then all others of the group are held, in blocks of as many, against what was kept, and those
    that are dropped leave. A group of up to `most` vectors takes one round; no task holds more than two blocks.
    """
    limit = config.dedup_similarity
    group, vec = (vectors.schema[c].dataType.simpleString() for c in ("group_id", "vec_id"))
    schema = f"group_id {group}, vec_id {vec}, representative {vec}"
    rows, done = vectors.select("group_id", "vec_id", "embedding"), None
    first = F.row_number().over(Window.partitionBy("group_id").orderBy("vec_id"))

    def drop(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """a: open vectors; b: kept ones, in order of ids the first that is near enough counts."""
        if not len(a) or not len(b):
            return pd.DataFrame({"group_id": [], "vec_id": [], "representative": []})
        b = b.sort_values("vec_id")
        near = np.round(_matrix(a["embedding"]) @ _matrix(b["embedding"]).T, DIGITS) >= limit
        hit = near.any(1)
        return pd.DataFrame({"group_id": a["group_id"][hit], "vec_id": a["vec_id"][hit], "representative": b["vec_id"].to_numpy()[near.argmax(1)[hit]]})

    while True:
        head = rows.withColumn("_n", first).where(F.col("_n") <= most).drop("_n")
        settled = _kept_first(head, limit)
        done = settled if done is None else done.unionByName(settled)
        edge = head.groupBy("group_id").agg(F.max("vec_id").alias("_edge"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == most)
        tail = rows.join(edge.hint("merge"), "group_id").where(F.col("vec_id") > F.col("_edge")).drop("_edge", "_n")
        blocks = tail.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_m"))
        if not blocks.take(1):
            return done
        settled = stored(settled)
        kept = head.join(settled.where("vec_id = representative").select("group_id", "vec_id"), ["group_id", "vec_id"], "left_semi")
        kept = kept.join(blocks, "group_id").select("group_id", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_b"))
        left = tail.join(blocks, "group_id").withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.col("_m")).cast("int")).drop("_m")
        # fresh columns: both sides come from one frame
        left, kept = (t.select(*(F.col(c).alias(c) for c in ("group_id", "_b", "vec_id", "embedding"))) for t in (left, kept))
        dropped = stored(left.groupBy("group_id", "_b").cogroup(kept.groupBy("group_id", "_b")).applyInPandas(drop, schema))
        done = done.unionByName(dropped)
        rows = stored(tail.join(dropped.select("group_id", "vec_id"), ["group_id", "vec_id"], "left_anti"))


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length of lower-cased white-space separated tokens."""
    each = rows.select(key, _tokens(text).alias("_t")).select(key, F.size("_t").alias("length"), "_t").select(key, "length", F.explode("_t").alias("term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, most: int = BROADCAST_TERMS) -> DataFrame:
    """query_id, doc_id, bm25 of queries (query_id, query) over docs (doc_id, text), all that share a term; a term in more than half of the documents has floor times the mean idf.

    One pass counts the documents of every term, pre-aggregated where they are read; a second one scores each document within its row, for `most` query terms at once.
    Repeated searches over one corpus, or only the best of each query, are for lexical_index.
    """
    sized = docs.select(_tokens("text").alias("_t")).select(F.array_distinct("_t").alias("_t"), F.size("_t").alias("_n"))
    distinct = sized.select("_n", F.posexplode_outer("_t").alias("_i", "term")).withColumn("_first", F.coalesce("_i", F.lit(0)) == 0)
    each = distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("_first"), F.col("_n"))).alias("_words"), F.count_if("_first").alias("_docs"))
    each = stored(each)
    n_docs = each.agg(F.sum("_docs")).first()[0] or 0
    idf = lambda df: F.log(F.lit(float(n_docs)) - df + 0.5) - F.log(df + 0.5)
    words, mean_idf = each.agg(F.sum("_words"), F.avg(F.when(F.col("term").isNotNull(), idf(F.col("df"))))).first()
    weight = F.when(idf(F.col("df")) < 0, floor * (mean_idf or 0.0)).otherwise(idf(F.col("df")))
    asked = terms(queries, "query_id", "query").select("query_id", "term", F.col("tf").alias("times"))
    weighted = stored(asked.join(each, "term").select("query_id", "term", (F.col("times") * weight).alias("weight")))
    mean = max((words or 0) / max(n_docs, 1), 1e-9)
    return _row_scores(docs, weighted, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), None, most).withColumnRenamed("score", "bm25")


def term_cosine(queries: DataFrame, docs: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """query_id, doc_id, similarity: the cosine of term counts for documents that share a term with the query; stands in for an encoder."""
    asked = terms(queries, "query_id", "query").select("query_id", "term", F.col("tf").alias("times"))
    length = F.sqrt(F.sum(F.col("times") * F.col("times")).over(Window.partitionBy("query_id")))
    weighted = stored(asked.select("query_id", "term", (F.col("times") / length).alias("weight")))
    return _row_scores(docs, weighted, lambda tf, length: tf, lambda counts: sum(n * n for n in counts.values()) ** 0.5, most).withColumnRenamed("score", "similarity")


def _row_scores(docs: DataFrame, weighted: DataFrame, part, divisor, most: int) -> DataFrame:
    """query_id, doc_id, score: sums of weight (query_id, term, weight) times part(count, document's length) over the terms that both have, by divisor(counts); each document's in its row.

    The weights of `most` terms at once go to every executor; more of them take further passes, whose scores are added up.
    """
    spark, kinds = docs.sparkSession, (weighted.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
    passes, found = max(1, -(-weighted.count() // most)), None
    for i in range(passes):
        some = weighted.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).toPandas()
        rows = docs.select("doc_id", _tokens("text").alias("_t")).mapInPandas(_scoring(spark, some, part, divisor), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
        found = rows if found is None else found.unionByName(rows)
    return found if passes == 1 else found.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def _scoring(spark, weighted: pd.DataFrame, part, divisor):
    queries = weighted["query_id"].drop_duplicates().to_numpy()
    places = {q: i for i, q in enumerate(queries)}
    by_term = {term: (np.array([places[q] for q in g["query_id"]]), g["weight"].to_numpy()) for term, g in weighted.groupby("term")}
    shared = spark.sparkContext.broadcast((queries, by_term))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        queries, by_term = shared.value
        for rows in batches:
            out = []
            for i, tokens in zip(rows["doc_id"], rows["_t"], strict=True):
                if tokens is None:
                    continue
                score, hit, counts = np.zeros(len(queries)), np.zeros(len(queries), bool), Counter(tokens.tolist())
                for term in counts.keys() & by_term.keys():
                    at, weight = by_term[term]
                    score[at] += weight * part(counts[term], len(tokens))
                    hit[at] = True
                at = np.flatnonzero(hit)
                if len(at):
                    out.append(pd.DataFrame({"query_id": queries[at], "doc_id": [i] * len(at), "score": score[at] / (divisor(counts) if divisor else 1.0)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int, config: Config = DEFAULT) -> DataFrame:
    """The blend of similarities (query_id, doc_id, similarity) and BM25, normalised by each query's best, over all ids that either side found."""
    best = lexical.groupBy("query_id").agg(F.max("bm25").alias("_max"))
    norm = lexical.join(best, "query_id").withColumn("_b", F.col("bm25") / F.when(F.col("_max") > 0, F.col("_max")).otherwise(1.0))
    both = semantic.select("query_id", "doc_id", "similarity").join(norm.select("query_id", "doc_id", "_b"), ["query_id", "doc_id"], "full")
    score = config.hybrid_weight * F.coalesce("similarity", F.lit(0.0)) + (1 - config.hybrid_weight) * F.coalesce("_b", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return both.withColumn("score", F.round(score, 6)).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def rerank(candidates: DataFrame, score, k: int = 5, least: float = 0.0) -> DataFrame:
    """The best k of candidates (query_id, query, doc_id, text) by a user's scorer of two series of texts."""
    scored = candidates.withColumn("score", F.pandas_udf(score, "double")("query", "text")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _hashed(text: str | None, size: int) -> np.ndarray:
    v = np.zeros(size)
    words = re.findall(r"[^\W_]+", (text or "").lower())
    for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
        h = zlib.crc32(w.encode())
        v[h % size] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def hash_similarity(a: Column, b: Column, size: int = 384) -> Column:
    """The cosine of two texts' vectors as of hash_embed, made and compared in one place; 0 without one of them."""

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        held = {t: _hashed(t, size) for t in {*a, *b}}
        return pd.Series([float(held[x] @ held[y]) for x, y in zip(a, b, strict=True)], dtype=float)

    cosine.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(cosine, "double")(a, b)


def hash_embed(rows: DataFrame, text: str, size: int = 384) -> DataFrame:
    """rows and embedding: signed hashes of lower-cased words and word pairs into `size` places, of unit length."""

    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([_hashed(t, size).tolist() for t in texts])

    encode.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return rows.withColumn("embedding", F.pandas_udf(encode, "array<double>")(text))


def cluster_fit(points: DataFrame, k: int = 20, seed: int = 42, sample: int = 2000) -> DataFrame:
    """topic_id, center of k-means on at most `sample` vectors, those of the smallest id hash; fewer clusters for few vectors, none below 20."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    n = chosen.count()
    spark = points.sparkSession
    schema = "topic_id int, center array<double>"
    if n < 20:
        return spark.createDataFrame([], schema)
    model = KMeans(k=k if n >= k else max(2, n // 3), seed=seed).fit(chosen.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], schema)


def without_ghosts(found: DataFrame, metadata: str = "version") -> DataFrame:
    """Search results whose metadata is still there: a deleted vector may be returned without any."""
    return found.where(F.col(metadata).isNotNull())


def of_documents(vectors: DataFrame, document_ids: DataFrame) -> DataFrame:
    """The vectors of some documents (document_id)."""
    return vectors.join(document_ids, "document_id", "left_semi")


def version_audit(vectors: DataFrame, current: str) -> DataFrame:
    """How many vectors have another encoder's version (null is not counted)."""
    return vectors.groupBy("is_claim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("version") != current).alias("mismatched"))


def orphan_sweep(vectors: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of live documents, and per collection how many were scanned and deleted."""
    ids = live.select("document_id", F.lit(True).alias("_live"))
    marked = vectors.join(ids, "document_id", "left")
    stats = marked.groupBy("is_claim").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("_live").isNull()).alias("deleted"))
    return vectors.join(live, "document_id", "left_semi"), stats


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is as good as zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 1e-16, dot(a, b) / norm).otherwise(0.0)
