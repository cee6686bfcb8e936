"""Drift scores of documents and of topics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Centers that are sent to every executor at most.
MAX_CENTERS = 5000
#: Defaults of the five weights that an organisation may set.
WEIGHTS = {"density": 0.45, "confidence": 0.35, "volume": 0.20, "factual": 0.60, "semantic": 0.40}


def age_decay(days: Column, half_life: float = 90.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.exp(F.lit(-0.693) * days / half_life)))


def drift_scores(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """docs (org_id, contradictions, ratio, mean_confidence, shift, decay, authority_level) with factual, semantic and combined scores and a type.

    weights: org_id and any of the five weights; an organisation without a row, or a null, has the default.
    """
    rows = docs if weights is None else docs.join(weights.withColumnsRenamed({k: f"_{k}" for k in WEIGHTS}), "org_id", "left")
    w = {k: F.coalesce(f"_{k}", F.lit(v)) if weights is not None and k in weights.columns else F.lit(v) for k, v in WEIGHTS.items()}
    n = F.col("contradictions")
    density = 1 - F.exp(F.lit(-3.0) * F.least(F.lit(1.0), "ratio"))
    raw = F.when(n > 0, density * w["density"] + F.col("mean_confidence") * w["confidence"] + F.least(F.lit(1.0), n / 5) * w["volume"]).otherwise(0.0)
    factual = F.least(F.lit(100.0), raw * 100 * (F.coalesce("authority_level", F.lit(3)) / 3))
    signal = (n > 0) | (F.col("shift") > 0)
    semantic = F.least(F.lit(100.0), (F.col("shift") * 0.5 + F.when(signal, F.col("decay")).otherwise(0.0) * 0.3 + F.least(F.lit(1.0), n / 10) * 0.2) * 100)
    kind = F.when((F.col("_f") >= 10) & (F.col("_s") >= 10), "both").when(F.col("_f") >= 10, "factual").when(F.col("_s") >= 10, "semantic").otherwise("none")
    rows = rows.withColumn("_f", factual).withColumn("_s", semantic).withColumn("_c", w["factual"] * F.col("_f") + w["semantic"] * F.col("_s"))
    return rows.select(*docs.columns, F.round("_f", 2).alias("factual"), F.round("_s", 2).alias("semantic"), F.round("_c", 2).alias("combined"), kind.alias("drift_type"))


def weights_valid(weights: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """weights and valid: the three parts of the factual score, and the two of the blend, each sum to one."""
    near = lambda *c: F.abs(sum((F.col(x) for x in c[1:]), F.col(c[0])) - 1) <= tolerance
    return weights.withColumn("valid", near("density", "confidence", "volume") & near("factual", "semantic"))


def centroids(points: DataFrame, by: list[str]) -> DataFrame:
    """by and center: the mean vector (one pass, by position)."""
    each = points.select(*by, F.posexplode("embedding").alias("_i", "_x"))
    means = each.groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_c")).select(*by, F.transform("_c", lambda x: x["_m"]).alias("center"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def topic_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Snapshots (topic_id, center) as movement of each topic, volatile, stable or moderate, and the drift of all."""
    moved = before.join(after.withColumnRenamed("center", "_after"), "topic_id").withColumn("movement", distance(F.col("center"), F.col("_after")))
    stats = moved.agg(F.percentile("movement", F.lit(0.75)).alias("_hi"), F.percentile("movement", F.lit(0.25)).alias("_lo"), F.avg("movement").alias("_avg"), F.max("movement").alias("_max"))
    kind = F.when(F.col("movement") >= F.col("_hi"), "volatile").when(F.col("movement") <= F.col("_lo"), "stable").otherwise("moderate")
    drift = F.least(F.lit(1.0), 2 * F.col("_avg") / F.greatest("_max", F.lit(1e-6)))
    return moved.join(F.broadcast(stats)).select("topic_id", F.round("movement", 6).alias("movement"), kind.alias("kind"), F.round(drift, 6).alias("drift"))


def _centers(centers: DataFrame) -> list[tuple[list, np.ndarray]]:
    """Topic ids in order and their centers, at most about MAX_CENTERS at once: each part is a pass over the points."""
    parts = max(1, -(-centers.count() // MAX_CENTERS))
    out = []
    for k in range(parts):
        rows = sorted(centers.select("topic_id", "center").where(F.pmod(F.xxhash64("topic_id"), F.lit(parts)) == k).collect(), key=lambda r: r["topic_id"])
        out.append(([r["topic_id"] for r in rows], np.array([r["center"] for r in rows], float).reshape(len(rows), -1)))
    return out


def _distances(shared, batch: pd.DataFrame) -> np.ndarray:
    """Distances (rows, centers) to six digits, one center at a time."""
    x = np.stack(batch["embedding"].to_numpy()).astype(float)
    return np.round(np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in shared.value[1]], 1), 6)


def nearest_center(points: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, topic_id, distance: the nearest center, found where a point is read; ties go to the smaller topic. More than MAX_CENTERS centers take further passes, whose best is taken by keys."""
    kind = centers.schema["topic_id"].dataType.simpleString()
    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    found, parts = None, _centers(centers)
    for part in parts:
        shared = points.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids = np.array(shared.value[0])
            for batch in batches:
                if len(batch) and len(ids):
                    d = _distances(shared, batch)
                    best = d.argmin(1)
                    yield batch[keys].assign(topic_id=ids[best], distance=d[np.arange(len(d)), best])

        rows = points.select(*keys, "embedding").mapInPandas(run, f"{schema}, topic_id {kind}, distance double")
        found = rows if found is None else found.unionByName(rows)
    if len(parts) == 1:
        return found
    best = found.groupBy(*keys).agg(F.min(F.struct("distance", "topic_id")).alias("_b"))
    return best.select(*keys, "_b.topic_id", "_b.distance")


def topic_labels(points: DataFrame, centers: DataFrame) -> DataFrame:
    """topic_id and the text (80 characters) nearest to its center, of points (vec_id, text, embedding); a batch hands on one candidate a topic."""
    kind, vec = centers.schema["topic_id"].dataType.simpleString(), points.schema["vec_id"].dataType.simpleString()
    parts = [_topic_labels(points, part, kind, vec) for part in _centers(centers)]
    return reduce(DataFrame.unionByName, parts)


def _topic_labels(points: DataFrame, part: tuple, kind: str, vec: str) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(shared.value[0]):
                d, at = _distances(shared, batch), batch["vec_id"].to_numpy()
                first = [np.lexsort((at, d[:, k]))[0] for k in range(d.shape[1])]
                yield pd.DataFrame({"topic_id": shared.value[0], "vec_id": at[first], "distance": d[first, np.arange(d.shape[1])], "label": [str(t)[:80] for t in batch["text"].to_numpy()[first]]})

    found = points.select("vec_id", "text", "embedding").mapInPandas(run, f"topic_id {kind}, vec_id {vec}, distance double, label string")
    return found.groupBy("topic_id").agg(F.min_by("label", F.struct("distance", "vec_id")).alias("label"))


def org_topic_drift(points: DataFrame, documents: int = 3, chunks: int = 500, least: int = 10, topics: int = 10) -> DataFrame:
    """org_id, topic_id, movement, kind, drift for the organisations of points (org_id, document_id, vec_id, embedding) with enough documents and chunks.

    An organisation's first `chunks` vectors by id, which is all that one task holds, are cut into halves; topics fitted on the first half are moved by the second.
    """
    enough = points.groupBy("org_id").agg(F.countDistinct("document_id").alias("_d")).where(F.col("_d") >= documents).select("org_id")
    first = F.row_number().over(Window.partitionBy("org_id").orderBy("vec_id"))
    kept = points.join(enough, "org_id", "left_semi").withColumn("_n", first).where(F.col("_n") <= chunks).select("org_id", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    kind = points.schema["org_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["org_id", "topic_id", "before", "after"]
        if len(rows) < least:
            return pd.DataFrame(columns=columns)
        x = np.stack(rows.sort_values("vec_id")["embedding"].to_numpy())
        half = x[: len(x) // 2]
        k = max(1, min(topics, len(x) // 3, len(half)))
        # spread-out starting points: each the farthest from those before
        chosen = [0]
        gap = ((half - half[0]) ** 2).sum(1)
        while len(chosen) < k:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((half - half[chosen[-1]]) ** 2).sum(1))
        centers = half[chosen].copy()
        near = lambda y: ((y[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
        for _ in range(25):
            own = near(half)
            centers = np.stack([half[own == c].mean(0) if (own == c).any() else centers[c] for c in range(k)])
        own, late = near(x), np.arange(len(x)) >= len(half)
        out = [(rows["org_id"].iloc[0], c, x[(own == c) & ~late].mean(0).tolist(), x[(own == c) & late].mean(0).tolist()) for c in range(k) if ((own == c) & ~late).any() and ((own == c) & late).any()]
        return pd.DataFrame(out, columns=columns)

    both = kept.groupBy("org_id").applyInPandas(run, f"org_id {kind}, topic_id int, before array<double>, after array<double>")
    moved = both.select("org_id", "topic_id", distance(F.col("before"), F.col("after")).alias("movement"))
    by = Window.partitionBy("org_id")
    quart = lambda q: F.percentile("movement", F.lit(q)).over(by)
    name = F.when(F.col("movement") >= quart(0.75), "volatile").when(F.col("movement") <= quart(0.25), "stable").otherwise("moderate")
    drift = F.least(F.lit(1.0), 2 * F.avg("movement").over(by) / F.greatest(F.max("movement").over(by), F.lit(1e-6)))
    return moved.select("org_id", "topic_id", F.round("movement", 6).alias("movement"), name.alias("kind"), F.round(drift, 6).alias("drift"))


def minibatch_step(centers: DataFrame, points: DataFrame) -> DataFrame:
    """centers (topic_id, center, weight) after one mini-batch of points (vec_id, embedding): each moves towards the mean of its points by their share of its weight.

    Meant for foreachBatch, with the centers kept in a table; fewer points than centers change nothing.
    """
    if points.count() < centers.count():
        return centers
    assigned = points.join(nearest_center(points, centers.select("topic_id", "center"), ["vec_id"]), "vec_id")
    means = centroids(assigned, ["topic_id"]).join(assigned.groupBy("topic_id").agg(F.count(F.lit(1)).cast("double").alias("_n")), "topic_id").withColumnRenamed("center", "_mean")
    share = F.coalesce("_n", F.lit(0.0)) / (F.col("weight") + F.coalesce("_n", F.lit(0.0)))
    moved = centers.join(means, "topic_id", "left").withColumn("_s", share)
    at = F.when(F.col("_mean").isNull(), F.col("center")).otherwise(F.zip_with("center", "_mean", lambda c, m: c + (m - c) * F.col("_s")))
    return moved.select("topic_id", at.alias("center"), (F.col("weight") + F.coalesce("_n", F.lit(0.0))).alias("weight"))
