"""Exact top-k search by inner product through a table of distances to pivots.

A vector becomes the integers floor(64 * x). Pivots are picked farthest first from a bounded sample; the pivot table holds every vector's distance to each of
them. For a query q and a vector v, no pivot p lets their distance be less than |d(q,p) - d(v,p)|, so that their product is at most (|q|^2 + |v|^2 - low^2) / 2
with the largest such difference: the bound. A query takes its candidates in order of their bounds and stops at the first bound below its k-th best product, which
at the start is that of the sample. Sample and pivots decide about the work only, never about the result.

Queries and candidates are dealt into blocks of some BLOCK rows, and each pair of blocks meets in a task of its own; what leaves are a query's k best of a block. Copies of a vector
have the same bounds and products and are dealt out like other rows.

Defined results: vectors that are null, or hold null, NaN or an infinite value, take no part. Shorter vectors count as filled up with zeros (an empty one is all zeros). A repeated id
is as many rows: each is a candidate of the others, and a query of its own if its id asks for it. Rows without id are candidates, after all ids among equal scores, but no queries.
Large values are multiplied as Python integers, so nothing is rounded; a score beyond 64 bits counts as the nearest long. An empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIVOTS = 24
#: Rows that pivots and first thresholds are taken from.
SAMPLE = 2048
#: Queries and candidates of a pair of blocks.
BLOCK = (512, 4096)
#: Squared lengths from which on products are made of Python integers, and bounds are not relied on.
EXACT = 2.0**40
LONGEST = 2**63 - 1


def dense(vectors, width: int = 0) -> np.ndarray:
    """Rows as one matrix, filled up with zeros."""
    vectors = [np.asarray(v, np.float64) for v in vectors]
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def coded(values, scale: int) -> list:
    """floor(scale * x) of each component; beyond 2^53 a double is whole already, so the product is made of integers."""
    if np.abs(values).max(initial=0.0) < 2.0**53:
        return np.floor(scale * values).tolist()
    return [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(scale * x)) for x in values.tolist()]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector to each pivot."""
    width = max(vectors.shape[1], pivots.shape[1])
    vectors, pivots = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, pivots))
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(vectors), 0))


def farthest_first(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, each the farthest from those before it; fewer if the rest are copies of them."""
    if not len(vectors):
        return vectors
    chosen, near = [0], distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def bounds(q: np.ndarray, q_table: np.ndarray, v: np.ndarray, v_table: np.ndarray, tile: int = 64) -> np.ndarray:
    """The most that the product of each query and vector can be; the half covers what rounding may take. In tiles that stay in a cache."""
    q_square, v_square = (q * q).sum(1), (v * v).sum(1)
    most, by_pivot = np.empty((len(q), len(v))), np.ascontiguousarray(v_table.T)
    for start in range(0, len(q), tile):
        mine = slice(start, start + tile)
        low, gap = np.zeros((2, len(q_table[mine]), len(v)))
        for mine_to, to in zip(q_table[mine].T, by_pivot, strict=True):
            np.abs(np.subtract(mine_to[:, None], to, out=gap), out=gap)
            np.maximum(low, gap, out=low)
        np.subtract(q_square[mine, None] + v_square + 1, np.square(low, out=low), out=low)
        np.floor(np.divide(low, 2, out=low), out=most[mine])
    most[q_square >= EXACT] = np.inf
    most[:, v_square >= EXACT] = np.inf
    return most


def falling_order(most: np.ndarray) -> np.ndarray:
    """Places by falling bound: whole numbers in a small range are sorted by their digits."""
    top = most.max(initial=0.0)
    if top - most.min(initial=top) < 65536:
        return np.argsort((top - most).astype(np.uint16), kind="stable")
    return np.argsort(-most, kind="stable")


class Block:
    """Candidates in order of their ids, so that of equal scores the first counts."""

    def __init__(self, vectors: list, table: np.ndarray, rows: np.ndarray, width: int):
        self.wide, self.matrix, self.table, self.rows = vectors, dense(vectors, width), table, rows
        squares = (self.matrix * self.matrix).sum(1)
        self.large, self.any_large = squares >= EXACT, bool((squares >= EXACT).any())
        # no partial sum passes the product of both lengths, so short floats hold it exactly
        self.short = self.matrix.astype(np.float32) if squares.max(initial=0.0) < 2.0**24 else None

    def scores(self, at: np.ndarray, q: np.ndarray, exact_q: list, large_q: bool) -> np.ndarray:
        if not large_q and not (self.any_large and self.large[at].any()):
            return self.short[at] @ q if q.dtype == np.float32 else self.matrix[at] @ q
        exact = (sum(int(x) * int(y) for x, y in zip(self.wide[i], exact_q, strict=False)) for i in at.tolist())
        return np.array([min(max(s, -LONGEST - 1), LONGEST) for s in exact], object)

    def best(self, q: np.ndarray, exact_q: list, own: int, most: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """(score, place) of the k best, best first, without the row `own`: candidates by falling bound until none can enter."""
        order = falling_order(most)
        falling, square = most[order], float((q * q).sum())
        large = square >= EXACT
        q = q.astype(np.float32) if self.short is not None and square < 2.0**24 else q
        kept: list[tuple[float, int]] = []
        start, step = 0, 256
        while start < len(order) and falling[start] >= least:
            stop = min(start + step, start + int(np.searchsorted(-falling[start:], -least, "right")))
            at = order[start:stop]
            start, step = stop, 4 * step
            at = at[self.rows[at] != own]
            scores = self.scores(at, q, exact_q, large)
            hits = np.flatnonzero(scores >= least)
            if len(hits):
                kept = sorted(kept + list(zip(scores[hits].tolist(), at[hits].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]
                least = max(least, kept[-1][0]) if len(kept) == k else least
        return kept


def pivot_table(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, pd.DataFrame]:
    """_row, _id (null: the largest long, with _none), _v (the integers) and _d (distances to the pivots), as a stored table; and the sample's rows of it."""
    common.tune(vectors.sparkSession)
    usable = F.col("_x").isNotNull() & F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = F.col(id_col).cast("long")
    rows = vectors.select(F.coalesce(given, F.lit(LONGEST)).alias("_id"), given.isNull().alias("_none"), F.col(vec_col).cast("array<double>").alias("_x")).where(usable)
    chosen = rows.orderBy(F.xxhash64("_id", "_x"), "_id").limit(sample).toPandas()
    candidates = dense([coded(np.asarray(x, np.float64), scale) for x in chosen["_x"]])
    # a distance to a pivot of large values would be rounded by more than bounds allow for
    shared = vectors.sparkSession.sparkContext.broadcast(farthest_first(candidates[(candidates * candidates).sum(1) < EXACT], pivots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            exact = [coded(np.asarray(x, np.float64), scale) for x in batch["_x"]]
            table = distances(dense(exact), shared.value)
            text = [None if all(abs(y) < 2.0**53 for y in x) else ",".join(str(int(y)) for y in x) for x in exact]
            yield pd.DataFrame({"_row": batch["_row"], "_id": batch["_id"], "_none": batch["_none"], "_v": [list(map(float, x)) for x in exact], "_big": text, "_d": list(table)})

    schema = "_row long, _id long, _none boolean, _v array<double>, _big string, _d array<double>"
    table = common.materialise(rows.withColumn("_row", F.monotonically_increasing_id()).mapInPandas(run, schema))
    return table, table.orderBy(F.xxhash64("_id", "_v"), "_row").limit(sample).toPandas()


def _integers(rows: pd.DataFrame) -> list:
    return [list(map(int, big.split(","))) if isinstance(big, str) else v for v, big in zip(rows["_v"], rows["_big"], strict=True)]


def _block(rows: pd.DataFrame, width: int) -> tuple[pd.DataFrame, Block]:
    rows = rows.sort_values(["_none", "_id", "_row"])
    return rows, Block(_integers(rows), np.stack(rows["_d"].to_numpy()), rows["_row"].to_numpy(), width)


def _width(*frames: pd.DataFrame) -> int:
    return max(len(v) for rows in frames for v in rows["_v"])


def search(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: int = PIVOTS, sample: int = SAMPLE, block: tuple[int, int] = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row of vectors whose id meets `asked` (a condition on the id column)."""
    table, known = pivot_table(vectors, id_col, vec_col, scale, pivots, sample)
    queries = table.withColumn(id_col, F.when(~F.col("_none"), F.col("_id"))).where(asked).drop(id_col)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the k-th best score of the sample."""
        for batch in batches:
            if len(batch):
                least = np.full(len(batch), -np.inf)
                if len(shared.value) > k:
                    width = _width(batch, shared.value)
                    _, there = _block(shared.value, width)
                    matrix, exact = dense(batch["_v"], width), _integers(batch)
                    for i, row in enumerate(batch["_row"]):
                        least[i] = float(there.best(matrix[i], exact[i], row, np.full(len(there.rows), np.inf), k, -np.inf)[-1][0])
                    least[np.abs(least) >= 2.0**53] = -np.inf
                yield batch.assign(_least=least)

    columns = "_row long, _id long, _none boolean, _v array<double>, _big string, _d array<double>"
    rows, parts = max(1, -(-queries.count() // block[0])), max(1, -(-table.count() // block[1]))
    spread = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.mapInPandas(first, f"{columns}, _least double").withColumn("_i", spread(rows)).withColumn("_j", every(parts))
    right = table.withColumn("_j", spread(parts)).withColumn("_i", every(rows))
    schema = "_row long, query_id long, vec_id long, _none boolean, score long"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            width = _width(a, b)
            b, there = _block(b, width)
            ids, none = b["_id"].to_numpy(), b["_none"].to_numpy()
            matrix, exact = dense(a["_v"], width), _integers(a)
            most = bounds(matrix, np.stack(a["_d"].to_numpy()), there.matrix, there.table)
            for i, (row, own, least) in enumerate(zip(a["_row"], a["_id"], a["_least"], strict=True)):
                out += [(row, own, ids[j], none[j], int(s)) for s, j in there.best(matrix[i], exact[i], row, most[i], k, least)]
        return pd.DataFrame(out, columns=["_row", "query_id", "vec_id", "_none", "score"])

    found = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), "_none", "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.when(~F.col("_none"), F.col("vec_id")).alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op13_pivot_search(spark, sf_dir):
    return search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
