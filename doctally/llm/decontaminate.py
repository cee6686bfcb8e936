"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are runs of letters and digits, lower-cased. Each mask looks at a window of SPAN words and hashes some of them, so that substitutions
at the other places do not change the hash. All windows of the corpus are joined to those of the benchmark, and each hit is verified around
itself: on its diagonal, up to REACH words to either side and within both texts, there must be a stretch around the window in which the words that
are equal are at least `ratio` of all and at least `least` (or the whole item, if that is shorter). Items of fewer than SPAN words are found where all
their words follow one another; those of fewer than FEW words, which any text may hold, only in documents of which they are half the words or more.

The benchmark's windows are sent to every executor in blocks of some BLOCK windows, dealt evenly whatever their hashes, each with up to 2 REACH + SPAN words, some 40 MB; a
larger benchmark takes more passes over the corpus, and the corpus is never shuffled. What follows the join are the verified hits, pre-aggregated by document and item.

Nulls: null texts have no words and match nothing; a document without id is reported under a null id, and removed like any other; items without id are dropped. Items without
words match nothing. Benchmark items with the same words are searched once and reported each. Repeated
documents of one id are one. Long texts are searched whole. Empty tables give empty results; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, without

SPAN = 9
#: Places of a window that count.
MASKS = ((0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 6, 8))
REACH = 12
#: Words that an item must have to be looked for inside longer texts.
FEW = 3
BLOCK = 150_000


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each window and mask: keep, _words, _at (its first word), _hash."""
    starts = F.when(F.size("_words") >= SPAN, F.sequence(F.lit(0), F.size("_words") - SPAN)).otherwise(F.array().cast("array<int>"))
    places = rows.select(*keep, "_words", F.explode(starts).alias("_at"))
    codes = [F.xxhash64(F.lit(m), *(F.col("_words")[F.col("_at") + k] for k in mask)) for m, mask in enumerate(MASKS)]
    return places.select(*keep, "_words", "_at", F.explode(F.array(*codes)).alias("_hash"))


def _stretch(ratio: float) -> Column:
    """Of the stretches of _same (1 where words are equal) around the window at _seed that have enough equal words, the one with most and then the shortest; null if there is none."""
    so_far = F.transform(F.sequence(F.lit(0), F.col("_both")), lambda k: F.aggregate(F.slice("_same", F.lit(1), k), F.lit(0), lambda n, x: n + x))
    ends = F.sequence(F.col("_seed") + SPAN, F.col("_both"))
    of = lambda c, a, b: F.struct((c[b] - c[a]).alias("equal"), (a - b).alias("less"))
    each = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.col("_seed")), lambda a: F.transform(ends, lambda b: of(c, a, b))))
    enough = lambda x: (x["equal"] >= -ratio * x["less"]) & (x["equal"] >= F.col("_least"))
    return F.array_max(F.flatten(F.transform(F.array(so_far), lambda c: F.filter(each(c), enough))))


def _short_hits(corpus: DataFrame, items: DataFrame, block: int) -> list[DataFrame]:
    """_doc, _class, _at, _equal, _size of the items under SPAN words, for each length and each block of them."""
    short = items.where(F.size("_words").between(1, SPAN - 1)).select("_class", F.size("_words").alias("_n"), F.array_join("_words", " ").alias("_run"))
    hits = []
    for n, many in sorted(tuple(r) for r in short.groupBy("_n").agg(F.count(F.lit(1))).collect()):
        places = F.when(F.size("_words") >= n, F.sequence(F.lit(0), F.size("_words") - n)).otherwise(F.array().cast("array<int>"))
        places = F.when(2 * n >= F.size("_words"), places).otherwise(F.array().cast("array<int>")) if n < FEW else places
        runs = corpus.select("_doc", "_words", F.explode(places).alias("_at")).select("_doc", "_at", F.array_join(F.slice("_words", F.col("_at") + 1, n), " ").alias("_run"))
        blocks = -(-many // block)
        for k in range(blocks):
            part = short.where((F.col("_n") == n) & (F.pmod(F.xxhash64("_run"), F.lit(blocks)) == k)).select("_class", "_run")
            hits.append(runs.join(F.broadcast(part), "_run").select("_doc", "_class", "_at", F.lit(n).alias("_equal"), F.lit(n).alias("_size")))
    return hits


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ratio: float = 0.7, least: int = 12, block: int = BLOCK) -> DataFrame:
    """One row per document and benchmark item that it overlaps: ids, verified hits, most equal words, the largest share of equal words, first word of the first hit."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("_item"), words_of(item_text_col).alias("_words"))
    named = materialise(items.withColumn("_class", F.xxhash64(F.array_join("_words", " "))))
    distinct = named.groupBy("_class").agg(F.first("_words").alias("_words"))
    left = F.least(F.col("_at"), F.lit(REACH))
    windows = materialise(
        _windows(distinct, ["_class"]).select(
            "_hash",
            "_class",
            # windows of one hash, as of a phrase that many items share, are in all blocks alike
            F.xxhash64("_class", "_at", "_hash").alias("_spread"),
            left.alias("_left"),
            F.slice("_words", F.col("_at") - left + 1, left + SPAN + REACH).alias("_near"),
            F.least(F.size("_words"), F.lit(least)).alias("_least"),
        )
    )
    blocks = max(1, -(-windows.count() // block))
    corpus = docs.select(F.col(id_col).alias("_doc"), words_of(text_col).alias("_words"))
    cut = F.greatest(F.col("_left") - F.col("_at"), F.lit(0))  # what of the item's words would lie before the document
    here = F.slice("_words", F.col("_at") - F.col("_left") + F.col("_cut") + 1, F.size("_near"))
    there = F.slice("_near", F.col("_cut") + 1, F.size("_near"))
    hits = []
    for k in range(blocks):
        part = windows.where(F.pmod(F.col("_spread"), F.lit(blocks)) == k).drop("_spread")
        hit = _windows(corpus, ["_doc"]).join(F.broadcast(part), "_hash").withColumn("_cut", cut)
        # one-element arrays: a test that can't be compiled must not move into the join, which would then copy a document's words for every window
        near = F.struct("_doc", "_class", "_at", "_least", (F.col("_left") - F.col("_cut")).alias("_seed"), here.alias("_here"), there.alias("_there"))
        hit = hit.select(F.explode(F.array(near)).alias("_hit")).select("_hit.*")
        equal = F.zip_with("_here", "_there", lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
        both = F.least(F.size("_here"), F.size("_there"))
        hit = hit.select("_doc", "_class", "_at", "_least", "_seed", F.slice(equal, 1, both).alias("_same"), both.alias("_both"))
        hit = hit.select("_doc", "_class", "_at", F.explode(F.array(_stretch(ratio))).alias("_best")).where("_best is not null")
        hits.append(hit.select("_doc", "_class", "_at", F.col("_best.equal").alias("_equal"), (-F.col("_best.less")).alias("_size")))
    hits += _short_hits(corpus, distinct, block)
    found = reduce(DataFrame.unionAll, hits).groupBy("_doc", "_class").agg(
        F.count(F.lit(1)).alias("n_hits"), F.max("_equal").alias("equal_words"), F.max(F.col("_equal") / F.col("_size")).alias("share"), F.min("_at").alias("first_word")
    )
    return found.join(named.select("_item", "_class"), "_class").select(
        F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "n_hits", "equal_words", "share", "first_word"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose text overlaps no benchmark item, whatever their ids."""
    key = free_name(docs.columns, "key")
    keyed = docs.withColumn(key, F.sha2(text_col, 256))
    return without(keyed, find_overlaps(keyed.select(key, text_col), benchmark, key, text_col).select(key), key).select(*docs.columns)


def op1_decontamination(spark, sf_dir):
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
