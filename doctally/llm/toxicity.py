"""Toxic passages by maximum-scoring segments.

Learning, on a bounded sample of labelled rows: for each token the log-odds of standing in a toxic rather than a clean document, with an
informative Dirichlet prior in proportion to its overall frequency (a word also counts under its stems of six, five and four letters,
see Weights); the estimate's standard error is taken off, so that rare tokens count
little. A fixed drift makes the mean score of clean text negative.

Scoring: one pass finds all maximal segments of positive score (linear time). Under the clean token frequencies such scores follow an extreme-value law with
rate lambda, the positive root of sum p exp(lambda s) = 1, and scale K, by which clean texts have one segment as good as their best on average. The segments whose
expected number of chance occurrences in the text is below `significance` are its toxic passages; the sum of their scores gives one E-value
a document, 1 where there is no segment at all, and score = odds / (1 + odds) with odds = c / E, where c is fitted so that 0.7 separates the sample's classes best. A
text's own length is all that counts, however short it is.

Bounds (parameter): `sample_rows` labelled rows of each class, those with the smallest id hash. All their tokens are weighted, and scoring covers every whole text.

Nulls: null and empty texts have no token and the score of a text without evidence. Rows with a null label teach nothing; if either class is missing
from the sample, every score is 0. Repeated rows get equal results. Extra columns are kept by `reject` and not touched by `score`.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

THRESHOLD = 0.7
_TOKEN = re.compile(r"[^\W\d_]+")


def forms(word: str) -> tuple[str, ...]:
    """The word and the ever shorter stems that it is also counted under, so that words never seen can be scored."""
    return (word, word[:6] + "*", word[:5] + "*", word[:4] + "*")


class Weights(dict):
    """Words to weights: the largest among the word's forms, from the longest on down to the first that clean text is known to use; None if no form is known."""

    def __init__(self, weights: dict[str, tuple[float, bool]], most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float | None:
        if len(self) >= self.most:
            self.clear()
        best = None
        for x in forms(word):
            if x in self.weights:
                weight, clean = self.weights[x]
                best = weight if best is None else max(best, weight)
                if clean:
                    break
        self[word] = best
        return best


@dataclass
class Model:
    weights: dict[str, tuple[float, bool]]  # of each form, and whether clean text uses it
    drift: float
    rate: float = 1.0
    scale: float = 1.0
    log_c: float = 0.0
    significance: float = 0.05
    usable: bool = True

    def __post_init__(self) -> None:
        self.known = Weights(self.weights)

    def segments(self, tokens: list[str]) -> list[tuple[float, int, int]]:
        """All maximal scoring segments as (score, first token, end)."""
        drift = self.drift
        marked = [(i, w) for i, w in enumerate(map(self.known.__getitem__, tokens)) if w is not None]
        found: list[list] = []  # [sum before, sum through, first, end, the segment to its left whose sum before is smaller]
        total, last = 0.0, -1
        for i, w in marked:
            total -= drift * (i - last - 1)
            last = i
            before, total = total, total + w
            if w <= 0:
                continue
            now = [before, total, i, i + 1]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][0] >= now[0]:
                    j = found[j][4]
                if j < 0 or found[j][1] >= now[1]:
                    found.append([*now, j])
                    break
                now = [found[j][0], now[1], found[j][2], now[3]]
                del found[j:]
        return [(x[1] - x[0], x[2], x[3]) for x in found]

    def expected(self, score: float, n: int) -> float:
        """How many segments of at least this score a clean text of n tokens has by chance."""
        return self.scale * n * math.exp(-self.rate * score)

    def evidence_of(self, scores: list[float], n: int) -> float:
        """Log of the chance expectation that stands against a text of n tokens with segments of these scores (lower: more toxic); 0 is none."""
        if not scores:
            return 0.0
        total = sum(s for s in scores if self.expected(s, n) <= self.significance) or max(scores)
        return min(0.0, math.log(self.scale * n) - self.rate * total)

    def evidence(self, text: str | None) -> float:
        tokens = _TOKEN.findall(text.lower()) if text else []
        return self.evidence_of([s for s, _, _ in self.segments(tokens)], len(tokens))

    def score(self, text: str | None) -> float:
        if not self.usable:
            return 0.0
        return 1 / (1 + math.exp(min(700.0, max(-700.0, self.evidence(text) - self.log_c))))

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant passages as (start, end, score, expected number) in characters of the text."""
        places = [m.span() for m in _TOKEN.finditer(text)] if text else []
        tokens = [text[a:b].lower() for a, b in places]
        found = [(places[i][0], places[j - 1][1], s, self.expected(s, len(tokens))) for s, i, j in self.segments(tokens)]
        return [x for x in found if x[3] <= self.significance]


def log_odds(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, prior: float, errors: float = 1.5) -> dict[str, float]:
    """Log-odds per token, drawn towards zero by so many standard errors; counts are of documents."""
    out, n = {}, n_toxic + n_clean
    for w in {*toxic, *clean}:
        a, b = toxic.get(w, 0), clean.get(w, 0)
        alpha = prior * (a + b) / n + 0.5
        value = math.log((a + alpha) / (n_toxic + prior - a - alpha + 1)) - math.log((b + alpha) / (n_clean + prior - b - alpha + 1))
        error = math.sqrt(1 / (a + alpha) + 1 / (b + alpha))
        out[w] = math.copysign(max(0.0, abs(value) - errors * error), value)
    return out


def tail_rate(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1, if the mean score is negative and some score is positive; else 1."""
    if scores.max(initial=0) <= 0 or (scores * chances).sum() >= 0:
        return 1.0
    value = lambda x: (chances * np.exp(x * scores)).sum()
    high = 1.0
    while value(high) < 1 and high < 100:
        high *= 2
    low = 0.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return (low + high) / 2


def best_cut(evidence: np.ndarray, toxic: np.ndarray) -> float:
    """The value below which evidence counts as toxic: fewest errors in the sample, a class's errors weighing by the root of its size; evidence 0 never counts."""
    order = np.lexsort((toxic, evidence))
    e, t = evidence[order], toxic[order]
    # cut after the first k: errors are clean rows before it and toxic rows behind it
    before, behind = np.concatenate([[0], np.cumsum(~t)]), t.sum() - np.concatenate([[0], np.cumsum(t)])
    wrong = before / math.sqrt((~t).sum()) + behind / math.sqrt(t.sum())
    allowed = np.concatenate([[True], e[1:] > e[:-1], [e[-1] < 0]])
    k = int(np.argmin(np.where(allowed, wrong, np.inf)))
    edge = np.concatenate([[e[0] - 2], e, [0.0]])
    return min((edge[k] + edge[k + 1]) / 2, -1e-9)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2000, prior: float = 2.0, drift: float = 1.0, support: int = 3) -> Model:
    """Fit on at most sample_rows toxic and as many clean rows."""
    spark = docs.sparkSession
    order = F.xxhash64(F.col("_id").cast("string"))
    marks = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_toxic")).where("_id is not null and _toxic is not null")
    chosen = {}
    for kind in (False, True):
        chosen.update({r["_id"]: kind for r in marks.where(F.col("_toxic") == kind).orderBy(order, "_id").limit(sample_rows).collect()})
    empty = Model({}, drift, usable=False)
    if len(set(chosen.values())) < 2:
        return empty
    picked = spark.createDataFrame(sorted(chosen.items()), f"_id {labels.schema[id_col].dataType.simpleString()}, _toxic boolean")
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(picked), "_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {True: Counter(), False: Counter()}
        rows = Counter()
        for batch in batches:
            for text, toxic in zip(batch["_text"], batch["_toxic"], strict=True):
                words = set(_TOKEN.findall(text.lower()))
                found[bool(toxic)].update({x for w in words for x in forms(w)})
                rows[bool(toxic)] += 1
        words = sorted({*found[True], *found[False]})
        yield pd.DataFrame({"token": words, "toxic": [found[True][w] for w in words], "clean": [found[False][w] for w in words]}, dtype=object)
        yield pd.DataFrame([(None, rows[True], rows[False])], columns=["token", "toxic", "clean"])

    counted = sample.mapInPandas(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a token of a single document can't have a weight beyond its error
    kept = counted.where("token is null or toxic + clean > 1").collect()
    sizes = next((r for r in kept if r["token"] is None), None)
    if sizes is None or not sizes["toxic"] or not sizes["clean"]:
        return empty
    n_toxic, n_clean = sizes["toxic"], sizes["clean"]
    toxic, clean = ({r["token"]: r[k] for r in sorted((r for r in kept if r["token"] is not None), key=lambda r: r["token"])} for k in ("toxic", "clean"))
    odds = log_odds(toxic, clean, n_toxic, n_clean, prior)
    known = [w for w in odds if clean.get(w, 0) > 1 or toxic.get(w, 0) >= support]
    weights = {w: (odds[w] - drift, clean.get(w, 0) > 1) for w in known}
    resolve, words = Weights(weights), [w for w in odds if not w.endswith("*")]
    scores = np.array([-drift if resolve[w] is None else resolve[w] for w in words] + [-drift])
    chances = np.array([clean.get(w, 0) + 0.01 for w in words] + [1.0])
    model = Model(weights, drift, tail_rate(scores, chances / chances.sum()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [_TOKEN.findall(t.lower()) for t in batch["_text"]]
            yield pd.DataFrame({"toxic": batch["_toxic"], "n": [len(t) for t in tokens], "scores": [[x for x, _, _ in model.segments(t)] for t in tokens]})

    seen = sample.mapInPandas(measure, "toxic boolean, n long, scores array<double>").toPandas()
    is_toxic = seen["toxic"].to_numpy(bool)
    best = np.array([max(x, default=0.0) for x in seen["scores"]])
    model.scale = 1 / max((seen["n"].to_numpy() * np.exp(-model.rate * best))[~is_toxic].mean(), 1e-300)
    evidence = np.array([model.evidence_of(list(x), n) for x, n in zip(seen["scores"], seen["n"], strict=True)])
    model.log_c = best_cut(evidence, is_toxic) + math.log(THRESHOLD / (1 - THRESHOLD))
    return model


def _scorer(docs: DataFrame, model: Model):
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts) -> list[float]:
        score = once(("toxicity", name), lambda: shared.value).score
        return [score(t if isinstance(t, str) else None) for t in texts]

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score and predicted (1 if score >= 0.7)."""
    scores = _scorer(docs, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.array(scores(batch["_text"]), float)
            yield pd.DataFrame({id_col: batch["_id"].values, "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    scores = _scorer(docs, model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = np.array(scores(batch.column(text_col).to_pylist()), float) < THRESHOLD
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per significant toxic passage: id, start and end in characters, score, expected number by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *p) for i, t in zip(batch["_id"], batch["_text"], strict=True) for p in shared.value.passages(t)]
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "score", "expected"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, end long, score double, expected double")


def fitted(spark, sf_dir: str) -> Model:
    """The model of the query and the pipeline: learned from rows whose crc32 of the id, modulo 3, is not 1."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def op6_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, fitted(spark, sf_dir)).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")
