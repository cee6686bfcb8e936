"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to three bytes is counted on a bounded sample and then frozen. A byte costs -log2 of its
probability after the longest context that the tree knows; a context in which it never came costs its escape probability (method C: distinct
followers over followers and occurrences) and hands on to the next shorter one, down to a uniform distribution over all 256 bytes. The code length of a whole text is
the sum, and the language with the shortest code wins, of equal ones the first by name; the score is its share of the posterior, which comes to 1 for texts of some length.

Because the statistics are frozen, the cost of a byte depends on four bytes only. So the costs of all known runs of four bytes stand in a hash table, those of
runs of three, with the escapes of contexts of three, in a second one, shorter ones in full tables, and whole batches are scored by look-ups. The tables of GROUP languages stand side by side.

Bounds: `sample_rows` labelled rows a language (a parameter), the rows with the smallest id hash; all of their runs are learned. A language takes 0.5 MB and GROUP times four bytes for
each of its runs (some ten thousand) in each worker, so memory grows with the languages; each `max_languages` (a parameter) of them take a pass of their own over the texts.
Everything else covers all rows and whole texts.

Nulls: a null text or one without a letter is `und` with score 0. Rows whose language is null teach nothing. With no labelled rows at all every
text is `und`. Repeated rows get equal results; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, once

ORDER = 3
#: Languages whose tables stand side by side.
GROUP = 8
#: Bytes scored at a time.
SLICE = 1 << 20
_THREE, _TWO, _BYTE = np.uint32((1 << 24) - 1), np.uint32((1 << 16) - 1), np.uint32(8)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of three context bytes (zero bytes before the text) and a byte, as integers, with their counts."""
    parts = [t.encode() for t in texts]
    a = np.frombuffer(b"".join(b"\0" * ORDER + t for t in parts), np.uint8).astype(np.uint32)
    if len(a) <= ORDER:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = ((a[:-3] << _BYTE | a[1:-2]) << _BYTE | a[2:-1]) << _BYTE | a[3:]
    own, at = np.ones(len(a), bool), 0
    for t in parts:
        own[at : at + ORDER] = False
        at += ORDER + len(t)
    return np.unique(grams[own[ORDER:]], return_counts=True)


class Runs:
    """Known runs in a hash table with open addressing: slot i holds the index of a run; at most `probes` steps find it."""

    def __init__(self, keys: np.ndarray):
        self.rows = np.unique(keys).astype(np.uint32)
        self.bits = max(10, int(len(self.rows) * 4).bit_length())
        while not self._fill():
            self.bits += 1

    def _fill(self) -> bool:
        self.slots, self.probes = np.full((1 << self.bits) + 64, -1, np.int32), 0
        left = np.arange(len(self.rows), dtype=np.int32)
        while len(left) and self.probes < 64:
            at = self._slot(self.rows[left]) + self.probes
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            self.probes += 1
        return not len(left)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its index (0 if not)."""
        if not len(self.rows):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int32)
        at = self._slot(keys)
        index = self.slots[at]
        found = (index >= 0) & (self.rows[index] == keys)
        for step in range(1, self.probes):
            rest = np.flatnonzero(~found)
            if not len(rest):
                break
            index[rest] = self.slots[at[rest] + step]
            found[rest] = (index[rest] >= 0) & (self.rows[index[rest]] == keys[rest])
        return found, np.where(found, index, 0)


class Trees:
    """Frozen trees of some languages as look-up tables; grams: of each language its runs and counts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        n = len(grams)
        self.low, self.leave = np.zeros((2, 1 << 16, n), np.float32)  # cost of the last byte after the one before it; of leaving a known context of two
        threes, contexts, fours = [], [], []
        for k, (key, count) in enumerate(grams):
            key, count = key.astype(np.uint32), count.astype(np.float64)
            two = np.bincount(key & _TWO, count, 1 << 16).reshape(256, 256)
            cost = self._step(two.sum(0)[None], np.full((1, 256), 8.0))
            self.low[:, k] = self._step(two, np.broadcast_to(cost, (256, 256))).ravel()
            three, at = np.unique(key & _THREE, return_inverse=True)
            cost, context, leave = self._known(three, np.bincount(at, count, len(three)))
            self.leave[context, k] = leave
            threes.append((three, cost))
            cost, context, leave = self._known(key, count)
            contexts.append((context, leave))
            fours.append((key, cost))
        self.three = Runs(np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in threes), *(x for x, _ in contexts)]))
        rows = self.three.rows
        self.three_cost, self.three_leave = self.leave[rows >> _BYTE] + self.low[rows & _TWO], np.zeros((len(rows), n), np.float32)
        for k in range(n):
            for known, table in ((threes, self.three_cost), (contexts, self.three_leave)):
                table[np.searchsorted(rows, known[k][0]), k] = known[k][1]
        self.four = Runs(np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in fours)]))
        self.four_cost = self._after_three(self.four.rows)
        for k, (key, cost) in enumerate(fours):
            self.four_cost[np.searchsorted(self.four.rows, key), k] = cost

    @staticmethod
    def _known(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The costs of known runs, their contexts, and what it costs to leave those."""
        context, at = np.unique(key >> _BYTE, return_inverse=True)
        seen, kinds = np.bincount(at, count, len(context)), np.bincount(at, minlength=len(context))
        return -np.log2(count / (seen + kinds)[at]), context, -np.log2(kinds / (seen + kinds))

    @staticmethod
    def _step(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Costs (contexts, symbols) from counts and the costs after the next shorter context."""
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / np.maximum(total + kinds, 1)), 0)
            return np.where(counts > 0, -np.log2(counts / np.maximum(total + kinds, 1)), escape + shorter)

    def _after_three(self, keys: np.ndarray) -> np.ndarray:
        """Costs of the last bytes of runs of four that are unknown: their context of three is left."""
        left, at = self.three.find(keys >> _BYTE)
        cost = np.where(left[:, None], self.three_leave[at], np.float32(0)) if len(self.three.rows) else np.zeros((len(keys), self.low.shape[1]), np.float32)
        known, at = self.three.find(keys & _THREE)
        rest = ~known
        cost[known] += self.three_cost[at[known]]
        three = keys[rest] & _THREE
        cost[rest] += self.leave[three >> _BYTE] + self.low[three & _TWO]
        return cost

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Of the last byte of each run of four, in each language."""
        found, at = self.four.find(keys)
        cost = np.empty((len(keys), self.low.shape[1]), np.float32)
        cost[found] = self.four_cost[at[found]]
        cost[~found] = self._after_three(keys[~found])
        return cost


class Scorer:
    """Trees of all languages, in groups."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(grams)
        self.groups = [Trees([grams[x] for x in self.languages[i : i + GROUP]]) for i in range(0, len(self.languages), GROUP)]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits (texts, languages)."""
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) + ORDER for t in texts], np.int64)
        raw = np.frombuffer(b"".join(b"\0" * ORDER + t for t in texts), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes + ORDER
        for a in range(0, len(raw), SLICE):
            key = raw[max(0, a - ORDER) : a + SLICE].astype(np.uint32)
            one, pad = key.copy(), a - max(0, a - ORDER)
            for back in (1, 2, 3):
                key[back:] |= one[:-back] << np.uint32(8 * back)
            key = key[pad:]
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(key), "left")
            lo, hi = np.maximum(starts[first:last] - a, 0), np.minimum(ends[first:last] - a, len(key))
            has = hi > lo
            if not has.any():
                continue
            marks = np.stack([lo[has], hi[has]], 1).ravel()
            for i, group in enumerate(self.groups):
                cost = group.costs(key)
                cost = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
                sums[np.arange(first, last)[has], i * GROUP : i * GROUP + cost.shape[1]] += np.add.reduceat(cost, marks, 0, dtype=np.float64)[::2]
        return sums

    def predict(self, texts: list[str | None], before: pd.DataFrame | None = None) -> pd.DataFrame:
        """lang_pred and score, with bits, the winner's code length; before: those of other languages for the same texts, which these are added to."""
        usable = [i for i, t in enumerate(texts) if self.languages and isinstance(t, str) and any(map(str.isalpha, t))]
        out = pd.DataFrame({"lang_pred": np.full(len(texts), "und", object), "score": np.zeros(len(texts)), "bits": np.full(len(texts), np.inf)})
        if usable:
            bits = self.lengths([texts[i].encode() for i in usable])
            gap = (bits - bits.min(1, keepdims=True)) * np.log(2)
            out.loc[usable, "lang_pred"] = np.array(self.languages, object)[bits.argmin(1)]
            out.loc[usable, "score"] = 1 / np.exp(-np.minimum(gap, 700)).sum(1)
            out.loc[usable, "bits"] = bits.min(1)
        if before is None:
            return out
        old, new = before["bits"].to_numpy(), out["bits"].to_numpy()
        # a score is its language's share: the shares of both sides together, in the winner's units
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            mass = [np.where(np.isfinite(b), np.exp(-np.minimum((b - np.minimum(old, new)) * np.log(2), 700)) / np.maximum(s, 1e-300), 0) for b, s in ((old, before["score"].to_numpy()), (new, out["score"].to_numpy()))]
        out["lang_pred"] = np.where(old <= new, before["lang_pred"], out["lang_pred"])
        out["bits"] = np.minimum(old, new)
        out["score"] = np.where(np.isfinite(out["bits"]), 1 / np.maximum(mass[0] + mass[1], 1e-300), 0.0)
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 500, max_languages: int = 200) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The runs of a bounded sample of each language, for up to max_languages at once, in order of their names."""
    ids = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).where("_lang is not null and _id is not null")
    sizes = sorted((r["_lang"], r["n"]) for r in ids.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect())
    for k in range(0, len(sizes), max_languages):
        yield _runs(docs, ids, dict(sizes[k : k + max_languages]), (id_col, text_col, lang_col), sample_rows)


def _runs(docs: DataFrame, ids: DataFrame, sizes: dict[str, int], columns: tuple[str, str, str], sample_rows: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    spark, (id_col, text_col, lang_col) = docs.sparkSession, columns
    # of each language about twice the rows wanted pass a cut on the id hash before they meet in one task
    parts = 1 << 40
    cuts = F.create_map(*(F.lit(x) for language, n in sizes.items() for x in (language, min(parts, parts * 2 * sample_rows // n))))
    code = F.xxhash64(F.col("_id").cast("string"))
    order = Window.partitionBy("_lang").orderBy(code, "_id")
    chosen = ids.where(F.pmod(code, F.lit(parts)) < F.coalesce(cuts[F.col("_lang")], F.lit(0))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_rows).select("_id", "_lang").collect()
    picked = spark.createDataFrame(sorted({(r["_id"],) for r in chosen}), f"_id {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_text is not null").where(F.col("_lang").isin(*sizes))
    sample = rows.join(F.broadcast(picked), "_id", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, group in batch.groupby("_lang"):
                keys, counts = gram_counts(group["_text"].tolist())
                yield pd.DataFrame({"lang": language, "gram": keys.astype(np.int64), "n": counts.astype(np.int64)})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["lang", "gram"])
    return {k: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.int64)) for k, g in counts.groupby("lang")}


def identify(docs: DataFrame, learned: Iterable[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the predicted language and the score. learned: what learn() gives; each part of the languages is a pass over the texts."""
    id_type, known = docs.schema[id_col].dataType.simpleString(), "lang_pred string, score double, bits double"
    rows, done = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), 0
    for part in learned:
        rows = materialise(rows) if done else rows
        rows, done = rows.mapInPandas(_identifying(docs.sparkSession.sparkContext.broadcast(part), done > 0), f"_id {id_type}, _text string, {known}"), done + 1
    rows = rows if done else rows.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    return rows.select(F.col("_id").alias(id_col), "lang_pred", "score")


def _identifying(shared, later: bool):
    """A pass over texts with some languages; a later one adds to what earlier ones found."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = once(("language", name), lambda: Scorer(shared.value))
        for batch in batches:
            out = scorer.predict(batch["_text"].tolist(), batch if later else None)
            yield pd.DataFrame({"_id": batch["_id"].values, "_text": batch["_text"].values} | {c: out[c].values for c in out.columns})

    return run


def op3_language_id(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return identify(docs, learn(docs.where(~held_out))).withColumn("held_out", F.coalesce(held_out, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
