"""Near-duplicate detection on weighted word shingles: BagMinHash signatures, bands, and exact verification.

A text is the multiset of its runs of five words (lower-cased, letters, digits and underscores); texts of one to four words have one run of
all their words. Two texts are linked if their weighted Jaccard similarity - the sum of the smaller counts over the sum of the larger - is at
least THRESHOLD. Classes are the connected components of links.

Signatures: the weight axis of a shingle is cut into octaves (0,1], (1,2], (2,4], ...; each is a Poisson process of its length's rate whose points have
a time, a slot and, halving the octave again and again, a place on the weight axis. A text with count w sees the points at places up to w, so each
slot's earliest point is the same in two texts with a probability equal to their similarity. Points are made in order of time up to the moment at
which all slots are filled, so that a long text costs one draw a shingle and a short one some hundred. BANDS bands of ROWS slots find a pair of similarity
0.8 with probability 0.9999.

Scale: equal texts are one vertex, found by digest with a pre-aggregated group; a text's signature row is a few hundred bytes and texts are not
shuffled for it. In a band's bucket of up to SMALL texts all pairs are verified as rows. In a larger one every text is first verified against the bucket's
middle (one row a text), and what these links connect in a few steps is found to be of one class. A bucket whose texts are all of one class is finished; in any other, no pair within
its middle's class needs a look, since it can't change the classes, and all other pairs are verified in blocks: the texts outside that class are cut into blocks of
some BLOCK texts, or of BLOCK_CHARS characters, and a task takes one of them with a block of any and counts what their pairs share by matrix products. So the
work on a group of copies grows with its size, and only what is unlike its middle meets the whole bucket; no row is a pair. Buckets with the same members are
taken once. No pair that shares a bucket is lost, whatever its bucket's size. Components are found by label propagation with pointer jumping on tables in the
shared folder.

Nulls: rows with a null id have a null class. Null texts and texts without a word are no near-duplicates of anything; equal empty texts form a class. A row is
classed by its text: rows that share an id but not the text may be of different classes. Of repeated rows (equal id and text) `near_duplicates` returns each and `keep_one` keeps
one. An empty table gives an empty result. Other columns, whatever their names, are not touched by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, discard, free_name, materialise, once, without

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Texts in a bucket whose pairs are made as rows.
SMALL = 8
#: Hashes by which a bucket's middle is chosen.
MIDDLES = 4
#: Texts, and characters, of a block of those that a larger bucket's middle leaves open.
BLOCK, BLOCK_CHARS = 512, 1_000_000
#: Elements that a matrix product takes at once.
COLUMNS = 8192
#: Shingles whose points are made together.
TOGETHER = 400_000
_WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: uniform 64-bit values from distinct ones."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _step(k: int, odd: int) -> np.uint64:
    return _U(k * odd & (1 << 64) - 1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1)."""
    return ((x >> _U(12)).astype(np.float64) + 0.5) / 2.0**52


class WordCodes(dict):
    """64-bit digests of words, remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def shingles(text: str | None, codes: WordCodes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as sorted 64-bit values, and their counts."""
    found = _WORD.findall(text.lower()) if text else []
    w = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) < words:
        w = np.concatenate([w, np.arange(words - len(w), dtype=np.uint64)])
    h = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[k : len(w) - words + 1 + k])
    return np.unique(h, return_counts=True)


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """For each non-empty bag of (element, count) the earliest point of every slot, as 64-bit values."""
    out = np.zeros((len(bags), slots), np.uint64)
    size = np.array([c.sum() for _, c in bags], np.float64)
    until = slots * (np.log(slots) + 2) / size
    todo = np.arange(len(bags))
    while len(todo):
        element = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo])
        place = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        keys, times, points = [], [], []
        octave, low = 0, 0.0
        while len(element):
            rate = 1.0 if octave == 0 else 2.0 ** (octave - 1)
            seed = _mix(element + _step(octave + 1, 0xD6E8FEB86659FD93))
            s, w, p, time, j = seed, weight, place, np.zeros(len(seed)), 0
            while len(s):
                draw = _mix(s + _step(j + 1, 0x9E3779B97F4A7C15))
                time = time - np.log(_unit(draw)) / rate
                early = time <= until[todo[p]]
                s, w, p, time, draw = s[early], w[early], p[early], time[early], draw[early]
                second = _mix(draw ^ _U(0xA0761D6478BD642F))
                seen = low + rate * _unit(_mix(second ^ _U(0xE7037ED1A0B428DB))) <= w  # the point's place on the weight axis
                keys.append(p[seen] * slots + (second[seen] % _U(slots)).astype(np.int64))
                times.append(time[seen])
                points.append(draw[seen])
                j += 1
            low, octave = low + rate, octave + 1
            more = weight > low
            element, weight, place = element[more], weight[more], place[more]
        key, time, point = np.concatenate(keys), np.concatenate(times), np.concatenate(points)
        order = np.lexsort((time, key))
        first, at = np.unique(key[order], return_index=True)
        filled = np.bincount(first // slots, minlength=len(todo)) == slots
        rows = np.zeros((len(todo), slots), np.uint64)
        rows.reshape(-1)[first] = point[order][at]
        out[todo[filled]] = rows[filled]
        todo = todo[~filled]
        until[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band."""
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    for k in range(rows):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + signatures[:, k::rows][:, :bands])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def _signed(rows: DataFrame) -> DataFrame:
    """_id, _sha, the length and the band keys of each text (none for a text without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = once(("words",), WordCodes)
        last: dict[str, list] = {}
        for batch in batches:
            texts, shas = batch["_text"].tolist(), batch["_sha"].tolist()
            known = {s: last[s] for s in shas if s in last}
            bags, names, size = [], [], 0

            def flush(bags=bags, names=names, known=known):
                if bags:
                    known.update(zip(names, band_keys(bag_min_hash(bags)).tolist(), strict=True))
                    bags.clear()
                    names.clear()

            for sha, text in zip(shas, texts, strict=True):
                if sha in known:
                    continue
                known[sha] = []
                bag = shingles(text, codes)
                if len(bag[0]):
                    bags.append(bag)
                    names.append(sha)
                    size += len(bag[0])
                    if size >= TOGETHER:
                        flush()
                        size = 0
            flush()
            yield pd.DataFrame({"_id": batch["_id"].values, "_sha": shas, "_size": [len(t) for t in texts], "_keys": [known[s] for s in shas]})
            last = known

    return rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _sha string, _size long, _keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (_a, _b) of at least this similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, last = once(("words",), WordCodes), (None, None)
        for batch in batches:
            kept = []
            for a, b, ta, tb in zip(batch["_a"], batch["_b"], batch["_ta"], batch["_tb"], strict=True):
                if last[0] != ta:
                    last = (ta, shingles(ta, codes))
                s = similarity(last[1], shingles(tb, codes))
                if s >= threshold - 1e-12:
                    kept.append((a, b, s))
            yield pd.DataFrame(kept, columns=["_a", "_b", "_s"])

    kind = pairs.schema["_a"].dataType.simpleString()
    left, right = (texts.select(F.col("_id").alias(x), F.col("_text").alias(t)) for x, t in (("_a", "_ta"), ("_b", "_tb")))
    return pairs.join(right.hint("merge"), "_b").join(left.hint("merge"), "_a").select("_a", "_b", "_ta", "_tb").mapInPandas(run, f"_a {kind}, _b {kind}, _s double")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(_id, _label) for every vertex of the edges (_a, _b): the smallest id of its component, or after so many rounds some id of it, the same for vertices that are near.

    Each round a vertex takes the smallest label among its own, its neighbours' and its label's label.
    """
    both = materialise(edges.select("_a", "_b").union(edges.select(F.col("_b"), F.col("_a"))).distinct())
    labels = materialise(both.groupBy(F.col("_a").alias("_id")).agg(F.least(F.min("_b"), F.first("_a")).alias("_label"), F.lit(True).alias("_new")))
    done = 0
    while True:
        near = both.join(labels.select(F.col("_id").alias("_b"), "_label"), "_b").groupBy(F.col("_a").alias("_id")).agg(F.min("_label").alias("_near"))
        parents = labels.select(F.col("_id").alias("_label"), F.col("_label").alias("_up"))
        least = F.least("_label", "_near", "_up")
        new = materialise(labels.select("_id", "_label").join(near, "_id").join(parents, "_label").select("_id", least.alias("_label"), (least != F.col("_label")).alias("_new")))
        done += 1
        changed = done != rounds and new.where("_new").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels.drop("_new")


def _candidates(members: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify as rows - all in the buckets (_key, _v, _size) of up to `small` texts, those with the middle in larger ones - and the members (_key, _v, _mid, _size) of larger
    ones, once for buckets with the same members."""
    same = [F.bit_xor(F.xxhash64("_v", F.lit(k))).alias(f"_x{k}") for k in range(2)]
    # the text of the smallest hash; MIDDLES hashes, so that the buckets of one group of copies have a few middles between them
    middle = F.min(F.struct(F.xxhash64("_v", F.pmod("_key", F.lit(MIDDLES))).alias("h"), F.col("_v").alias("v")))
    sized = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), middle.alias("_mid"), *same).where("_n > 1").withColumn("_mid", F.col("_mid.v"))
    joined = materialise(members.join(sized.hint("merge"), "_key"))
    tiny, large = joined.where(F.col("_n") <= small).select("_key", "_v"), joined.where(F.col("_n") > small)
    other = tiny.select("_key", F.col("_v").alias("_b"))
    within = tiny.withColumnRenamed("_v", "_a").join(other.hint("merge"), "_key").where("_a < _b").select("_a", "_b")
    star = large.where("_v != _mid").select(F.least("_v", "_mid").alias("_a"), F.greatest("_v", "_mid").alias("_b"))
    once_each = large.groupBy("_n", "_x0", "_x1").agg(F.min("_key").alias("_key")).select("_key")
    return materialise(within.union(star).distinct()), materialise(large.join(once_each.hint("merge"), "_key", "left_semi").select("_key", "_v", "_mid", "_size"))


def _unsettled(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (_key, _v, _size, _l, _out) of buckets with texts outside their middle's class: a text's class, and whether it is outside."""
    of = lambda c, x: labels.select(F.col("_id").alias(c), F.col("_label").alias(x)).hint("merge")
    rows = large.join(of("_v", "_l"), "_v", "left").join(of("_mid", "_m"), "_mid", "left")
    # a text without any link is a class of its own
    rows = rows.select("_key", "_v", "_size", F.coalesce("_l", "_v").alias("_l"), (F.coalesce("_l", "_v") != F.coalesce("_m", "_mid")).alias("_out"))
    return materialise(rows.join(rows.where("_out").select("_key").distinct().hint("merge"), "_key", "left_semi"))


def shared_counts(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of the smaller counts for each bag of x and each of y."""
    bags = [*x, *y]
    sizes = [int(c.sum()) for _, c in bags]
    # an element of count w is w elements, of which the k-th is shared with all bags that have k at least
    nth = np.concatenate([np.arange(c.sum()) - np.repeat(c.cumsum() - c, c) for _, c in bags]).astype(np.uint64)
    element = _mix(np.concatenate([np.repeat(e, c) for e, c in bags]) + nth * _U(0x9E3779B97F4A7C15))
    row = np.repeat(np.arange(len(bags)), sizes)
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    new = np.r_[True, element[1:] != element[:-1]][: len(element)]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    out = np.zeros((len(x), len(y)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (low, low + COLUMNS))
        part = np.zeros((len(bags), COLUMNS), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += part[: len(x)] @ part[len(x) :].T
    return out


def _block_links(unsettled: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (_a, _b) between classes that connect what any pair of at least this similarity in a bucket (_key, _v, _size, _l, _out) connects, but for pairs of which neither is _out."""
    kind = unsettled.schema["_v"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        codes = once(("words",), WordCodes)
        bags = [shingles(t, codes) for t in group["_text"]]
        first, alone = group["_first"].to_numpy(), bool(group["_i"].iloc[0] == group["_j"].iloc[0])
        x = np.flatnonzero(first)
        y = x if alone else np.flatnonzero(~first)
        near = np.zeros((len(bags), len(bags)), bool)
        if len(x) and len(y):
            size = np.array([c.sum() for _, c in bags], np.float64)
            shared = shared_counts([bags[k] for k in x], [bags[k] for k in y])
            near[np.ix_(x, y)] = shared >= (threshold - 1e-12) * (size[x][:, None] + size[y][None, :] - shared)
            near |= near.T
        label, todo, out = group["_l"].to_numpy(), np.ones(len(bags), bool), []
        for k in range(len(bags)):
            if todo[k]:
                todo[k], reached, classes = False, np.array([k]), {int(label[k])}
                while len(reached):
                    reached = np.flatnonzero(near[reached].any(axis=0) & todo)
                    todo[reached] = False
                    classes.update(label[reached].tolist())
                least = min(classes)
                out += [(least, c) for c in sorted(classes) if c != least]
        return pd.DataFrame(out, columns=["_a", "_b"])

    # blocks 0, 1, ... hold the texts outside, -1, -2, ... the others; a pair of blocks has one outside at least
    parts = lambda k: F.ceil(F.greatest(F.sum((F.col("_out") == k).cast("int")) / block, F.sum(F.when(F.col("_out") == k, F.col("_size"))) / BLOCK_CHARS, F.lit(0))).cast("int")
    blocks = unsettled.groupBy("_key").agg(parts(True).alias("_outs"), parts(False).alias("_ins"))
    spread = F.xxhash64("_v", F.lit(3))
    own = unsettled.join(blocks.hint("merge"), "_key").withColumn("_c", F.when(F.col("_out"), F.pmod(spread, "_outs")).otherwise(-1 - F.pmod(spread, "_ins")).cast("int"))
    others = F.sequence(F.when(F.col("_out"), -F.col("_ins")).otherwise(F.lit(0)), F.col("_outs") - 1)
    rows = own.select("_key", "_v", "_l", "_c", F.explode(others).alias("_o"))
    rows = rows.select("_key", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"), "_v", "_l", (F.col("_c") <= F.col("_o")).alias("_first"))
    rows = rows.join(texts.select(F.col("_id").alias("_v"), "_text").hint("merge"), "_v")
    return rows.groupBy("_key", "_i", "_j").applyInPandas(run, f"_a {kind}, _b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: its id, class_id (the smallest id of its class), copy_of (the smallest id of an equal text) and kept (its id and text are the first of its class)."""
    return _classed(docs, id_col, text_col, threshold, small, block).drop("_sha")


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """near_duplicates and _sha, the digest of the text."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).where("_id is not null").withColumn("_sha", F.sha2("_text", 256))
    signed = materialise(_signed(rows.select("_id", "_text", "_sha")))
    copies = signed.groupBy("_sha").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size"), F.first("_keys").alias("_keys"))
    # a vertex is a text; its number is fixed once it has been written
    copies = materialise(copies.withColumn("_v", F.monotonically_increasing_id()))
    members = copies.select("_v", "_size", F.explode("_keys").alias("_key"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        labels = components(_links(rows, copies.select("_sha", "_v"), members, threshold, small, block))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    linked = materialise(copies.select("_v", "_sha", "_least").join(labels.withColumnRenamed("_id", "_v").hint("merge"), "_v"))
    tops = linked.groupBy("_label").agg(F.min(F.struct("_least", "_sha")).alias("_top"))
    tops = linked.select("_label", "_sha").join(tops.hint("merge"), "_label").select("_sha", "_top")
    changed = copies.select("_sha", "_n", "_least").join(tops.hint("merge"), "_sha", "left").where("_n > 1 or _top is not null")
    changed = materialise(changed.select("_sha", "_least", F.coalesce("_top._least", "_least").alias("_class"), F.coalesce("_top._sha", "_sha").alias("_top")))
    out = signed.select("_id", "_sha").join(changed.hint("merge"), "_sha", "left")
    kept = F.coalesce((F.col("_class") == F.col("_id")) & (F.col("_top") == F.col("_sha")), F.lit(True))
    out = out.select(F.col("_id").alias(id_col), F.coalesce("_class", "_id").alias("class_id"), F.coalesce("_least", "_id").alias("copy_of"), kept.alias("kept"), "_sha")
    none = F.lit(None).cast(id_type)
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col), none.alias("class_id"), none.alias("copy_of"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("_sha"))
    return out.union(nameless)


def _links(rows: DataFrame, vertices: DataFrame, members: DataFrame, threshold: float, small: int, block: int) -> DataFrame:
    """Links (_a, _b) with the components of all pairs that share a bucket and have at least this similarity; a link may stand between classes of what is linked already."""
    pairs, large = _candidates(members, small)
    ids = materialise(pairs.select(F.explode(F.array("_a", "_b")).alias("_v")).distinct())
    wanted = materialise(vertices.join(ids.hint("merge"), "_v", "left_semi"))
    wanted = wanted.hint("broadcast") if wanted.count() <= BROADCAST_IDS // 5 else wanted.hint("merge")  # a digest takes five times the bytes of an id
    texts = materialise(rows.join(wanted, "_sha").groupBy(F.col("_v").alias("_id")).agg(F.first("_text").alias("_text")))
    links = materialise(_verified(pairs, texts, threshold).select("_a", "_b"))
    if not large.take(1):
        return links
    unsettled = _unsettled(large, components(links, rounds=2))
    return materialise(links.union(_block_links(unsettled, texts, threshold, block)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that come first in their class; of repeated rows one. Rows without an id stay."""
    classed = materialise(_classed(docs, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), "_sha", "kept"))
    key = free_name(docs.columns, "key")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("_id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("_sha")))
    named = lambda rows: rows.select(F.struct("_id", "_sha").alias(key))
    kept = without(keyed, named(classed.where("not kept").distinct()), key)
    repeated = materialise(classed.where("kept").groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if repeated.take(1):
        same = kept.join(named(repeated).hint("merge"), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
        kept = without(kept, named(repeated), key).select(*docs.columns).unionByName(same.select("_row.*"))
    return kept.select(*docs.columns)


def op2_near_dedup(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
