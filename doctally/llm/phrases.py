"""Phrase collocations per language, counted by generalised suffix automata of shards.

A shard is up to SHARD words of one language. Its suffix automaton, cut at the phrases' length, is read off the words sorted with what stands before them: all endings of one phrase stand
together, so a run is a phrase and its length the size of its endpos set; a phrase whose every ending has the same word before it is in one state with the longer phrase, and a state's
suffix link leads to the longest suffix that ends elsewhere too. The states' substrings are enumerated with their counts, and the counts of all shards are summed. Words and pairs come
first; longer phrases are then enumerated in those states only whose suffix link and front are frequent pairs, as a bitmap of fixed size tells, whatever the corpus (what it lets through
wrongly is counted and dropped, so it decides about the work only).

A candidate meets the counts of its parts, and pairs the largest count of the longer phrases that their states link to or lead to, in joins by phrase.

Defined results: a null text is empty, a null language is `und`. A text without words counts nothing; an empty table gives no rows. Very long texts are cut at blanks, each cut with the words
before it as context, so that no occurrence is lost or counted twice. Repeated rows count each. Equal scores are ordered by count, then by the phrase's bytes. Other columns are not touched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST, SHARE, BEST = 10, 50, 2000
#: Words of a shard, and bytes of text that are cut into words at once.
SHARD, SLICE = 200_000, 1 << 20
#: Phrases that are handed on at once.
ROWS = 100_000
#: Bits of the bitmap of frequent pairs: 16 MB.
BITS = 27
_UPPER, _ENDS = bytes(range(65, 91)), b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(_UPPER + b"\t" + _ENDS, _UPPER.lower() + b" " + b"\n" * len(_ENDS))
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def slices(text: bytes) -> Iterator[bytes]:
    """text in parts of some SLICE bytes, cut at blanks."""
    start = 0
    while len(text) - start > SLICE:
        cut = text.rfind(b" ", start + 1, start + SLICE)
        cut = text.find(b" ", start + SLICE) if cut < 0 else cut
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class Automaton:
    """States of the suffix automaton of word ids, cut at phrases of `depth` words. Ids from 2 on are words, 1 ends a piece.

    level[n] has for each phrase of n words: its words (last first), its count, its parent (the phrase without its first word), whether its state has a longer phrase.
    """

    def __init__(self, ids: np.ndarray, live: np.ndarray, words: int, depth: int):
        ends = np.flatnonzero(live & (ids > 1))
        key, there = ids[ends].astype(np.int64), np.ones(len(ends), bool)
        for back in range(1, depth):
            before = ids[np.maximum(ends - back, 0)]
            there &= (ends >= back) & (before > 1)
            key = key * words + np.where(there, before, 0)
        key.sort()
        self.total, self.level, runs = len(ends), {}, {}
        for n in range(1, depth + 1):
            head = key // words ** (depth - n)
            starts = np.flatnonzero(np.diff(head, prepend=-1))
            runs[n] = (starts, np.diff(starts, append=len(head)), head[starts])
        for n in range(1, depth + 1):
            starts, sizes, head = runs[n]
            parent = np.searchsorted(runs[n - 1][0], starts, "right") - 1 if n > 1 else np.zeros(len(starts), np.int64)
            longer = np.zeros(len(starts), bool)
            if n < depth:
                first = np.searchsorted(runs[n + 1][0], starts)
                longer = (runs[n + 1][1][first] == sizes) & (runs[n + 1][2][first] % words != 0)
            self.level[n] = (np.stack([head // words**i % words for i in reversed(range(n))]), sizes, parent, longer, head % words != 0)

    def states(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the states whose longest phrase has n words: their place in the level, counts, and the length of the phrase that their suffix link leads to."""
        _, sizes, parent, longer, real = self.level[n]
        at = np.flatnonzero(real & ~longer)
        link, up, open_ = np.zeros(len(at), np.int64), parent[at], np.ones(len(at), bool)
        for m in range(n - 1, 0, -1):
            ends = open_ & ~self.level[m][3][up]
            link[ends] = m
            open_ &= ~ends
            up = self.level[m][2][up]
        return at, sizes[at], link

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All phrases of n words (a row per word, first word first) and their counts: of each state the substrings between its link and its longest."""
        words, counts = [], []
        for longest in range(n, max(self.level) + 1):
            at, sizes, link = self.states(longest)
            mine = link < n
            words.append(self.level[longest][0][:n, at[mine]])
            counts.append(sizes[mine])
        return np.concatenate(words, 1)[::-1], np.concatenate(counts)


class Shard:
    """Words of one language on their way into an automaton."""

    def __init__(self, lang: str, lengths: tuple[int, int], frequent: np.ndarray | None):
        self.lang, self.lengths, self.frequent = lang, lengths, frequent
        self.context: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.ids[b""], self.ids[b"\n"]
        self.parts: list[np.ndarray] = []
        self.live: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        self.context = []
        for part in slices(b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")):
            words = self.context + part.split(b" ")
            ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
            live = np.arange(len(ids)) >= len(self.context)
            self.parts += [np.ones(1, np.int32), ids[ids > 0]]
            self.live += [np.zeros(1, bool), live[ids > 0]]
            self.context = list(islice(filter(None, reversed(words)), self.lengths[1] - 1))[::-1]
            self.size += len(ids)
            if self.size >= SHARD:
                yield from self.counted()
        self.context = []

    def counted(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        vocabulary = list(self.ids)
        automaton = Automaton(np.concatenate(self.parts), np.concatenate(self.live), len(vocabulary), self.lengths[1])
        texts = pa.array(vocabulary, pa.binary())
        for n in range(self.lengths[0], self.lengths[1] + 1):
            words, counts = automaton.phrases(n)
            if self.frequent is not None:
                kept = self.pairs_frequent(vocabulary, words)
                words, counts = words[:, kept], counts[kept]
            phrase = pc.binary_join_element_wise(*(texts.take(pa.array(w)) for w in words), pa.scalar(b" ", pa.binary())).cast(pa.string())
            for start in range(0, len(phrase), ROWS):
                yield self.batch(phrase.slice(start, ROWS), n, counts[start : start + ROWS])
        if self.lengths[0] == 1:
            yield self.batch(pa.array([None], pa.string()), 0, np.array([automaton.total]))
        self.clear()

    def batch(self, phrase: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(self.lang, len(phrase)), phrase, pa.array(np.full(len(phrase), n, np.int32)), pa.array(counts, pa.int64())], schema=_SCHEMA)

    def pairs_frequent(self, vocabulary: list[bytes], words: np.ndarray) -> np.ndarray:
        """Which phrases have only frequent pairs: see pair_bit."""
        hashes = np.array([xxhash.xxh64_intdigest(w, seed=42) for w in vocabulary], np.uint64)
        kept = np.ones(words.shape[1], bool)
        for a, b in zip(words[:-1], words[1:], strict=True):
            bit = (hashes[a] ^ (hashes[b] << np.uint64(1))) & np.uint64((1 << BITS) - 1)
            kept &= (self.frequent[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return kept


def counted(docs: DataFrame, lengths: tuple[int, int], bitmap: list | None = None) -> DataFrame:
    """lang, phrase, words, f: each shard's counts of phrases of so many words; with those of one word also the number of all words (no phrase, 0 words)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None
        if shared.value is not None:
            frequent = np.zeros(1 << (BITS - 3), np.uint8)
            for bucket, bits in shared.value:
                frequent[(bucket - 1) << 12 : bucket << 12] = np.frombuffer(bits, np.uint8)
        shards: dict[str, Shard] = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, some in texts.items():
                yield from shards.setdefault(lang, Shard(lang, lengths, frequent)).add(some)
        for shard in shards.values():
            yield from shard.counted()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, words int, f long")


def summed(counts: DataFrame, least: int) -> DataFrame:
    """All counts of a phrase; those that no candidate or part of one can have go."""
    return common.materialise(counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0)))


def _words(phrase: str, start: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def pair_bitmap(counts: DataFrame) -> list:
    """(bucket, bitmap) of the frequent pairs, by the hashes of their two words; its size does not depend on theirs."""
    first, second = (F.xxhash64(_words("phrase", i, 1)) for i in (1, 2))
    bit = first.bitwiseXOR(F.shiftleft(second, 1)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) + 1
    bits = counts.where("words = 2").select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("i"))
    return [(r["k"], bytes(r["b"])) for r in bits.groupBy("k").agg(F.bitmap_construct_agg("i").alias("b")).collect()]


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two or three words that come `least` times or more; a pair goes if a longer phrase has `share` hundredths of its count."""
    common.tune(docs.sparkSession)
    parts = summed(counted(docs, (1, 2)), least)
    triples = summed(counted(docs, (3, 3), pair_bitmap(parts)), least)
    candidates = parts.where("words = 2").unionByName(triples).select("lang", "phrase", "words", F.col("f").alias("a"))
    # each cut's parts: the first k words and the rest
    side = lambda k, left: F.struct(F.lit(2 * k + left).alias("side"), (_words("phrase", 1, k) if left else _words("phrase", k + 1, 2)).alias("part"))
    cut = lambda k: (side(k, 1), side(k, 0))
    sides = candidates.select("*", F.explode(F.when(F.col("words") == 2, F.array(*cut(1))).otherwise(F.array(*cut(1), *cut(2)))).alias("_s")).select(*candidates.columns, "_s.*")
    known = parts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f")
    met = sides.join(known, ["lang", "part"]).groupBy(*candidates.columns)
    met = met.agg(*(F.max(F.when(F.col("side") == 2 * k + left, F.col("f"))).alias(f"{'rl'[left]}{k}") for k in (1, 2) for left in (0, 1)))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    met = met.withColumns({"_a": whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), "_1": whole("l1") * whole("r1"), "_2": whole("l2") * whole("r2")})
    cuts = [F.struct(F.expr(f"_a div _{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    lowest = met.withColumn("_c", F.when(F.col("words") == 2, cuts[0]).otherwise(F.least(*cuts))).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")
    # a pair in a longer phrase is what its suffix link leads to, or what it goes on from
    inside = triples.select("lang", "f", F.explode(F.array(_words("phrase", 2, 2), _words("phrase", 1, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= best)
    total = parts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest([1, 2, 3]) u(k), unnest(range(1, len(w) + 2 - k)) v(i)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f AS a FROM f WHERE k > 1 AND f >= 10),
d AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, unnest(range(1, k)) u(j)),
s AS (SELECT d.lang, d.phrase, d.k, a, x.f AS l, y.f AS r, j, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM d JOIN f x ON x.lang = d.lang AND x.phrase = d.x JOIN f y ON y.lang = d.lang AND y.phrase = d.y),
m AS (SELECT lang, phrase, any_value(k) AS k, any_value(a) AS a, min(struct_pack(score := score, j := j, l := l, r := r)) AS b FROM s GROUP BY lang, phrase),
t AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
o AS (SELECT lang, phrase, max(a) AS a FROM t GROUP BY lang, phrase),
z AS (SELECT m.lang, m.phrase, m.a, b.l AS l, b.r AS r, b.score AS score, row_number() OVER (PARTITION BY m.lang ORDER BY b.score DESC, m.a DESC, encode(m.phrase)) AS rank
    FROM m LEFT JOIN o ON o.lang = m.lang AND o.phrase = m.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * m.a)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""


def op11_phrases(spark, sf_dir):
    return collocations(common.read(spark, sf_dir, "documents"))
