"""Packing token sequences by minimum bin slack.

Each scan task packs the documents that it reads, block by block of bounded size, so nothing is shuffled and a lost task is simply run again
with the same result. Within a block:

1. A document of n ids is cut into full windows of `capacity` ids and one remainder.
2. The remainders form a multiset of lengths. The longest is placed first; a subset-sum over the others, kept as one Python integer per step
   (bit s: the sum s can be reached), finds the multiset whose sum comes closest to the space left, and walking the steps backwards gives how
   many of each length it takes.
3. Where no multiset fills a window to the last id, its slack, the least there is, is filled by cutting that many ids off a remainder of the last windows, which are
   taken apart for it. So all windows of a block leave full, but for fewer than `capacity` ids that wait for the next block; at the end of
   the task's rows those are cut into powers of two, which need no padding.

So each id lies in exactly one piece, sequences hold at most `capacity` ids, and padding is none.

Nulls: a null text is empty and has only the closing id; rows with a null id column are packed too. Repeated rows are packed each. An empty
table gives an empty result. Other columns of the input are not touched. Memory: one block's ids, 4 bytes each,
whatever the lengths.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

CAPACITY = 2048
#: Ids (and documents) that a block may hold before it is packed.
BLOCK_IDS, BLOCK_DOCS = 4_000_000, 8_000
#: Entries of a worker's memory of chunks; beyond that it falls back to the first quarter that it learned.
MEMORY = 200_000
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of a multiset drawn from counts whose sum comes closest to room from below; lengths: counts' keys, descending."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, size = counts[length], 1
        while left > 0 and length * size <= room:  # how many: in powers of two, then the rest
            take = min(size, left)
            steps.append((reach, length, take))
            reach = (reach | reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken: Counter = Counter()
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            taken[length] += take
            at -= length * take
    return sorted(taken.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Windows as (how often, [(length, how many)]), each holding the longest length left and the multiset that fills it closest."""
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left, reverse=True)
    windows = []
    while order:
        first = order[0]
        left[first] -= 1
        chosen = Counter({first: 1})
        chosen.update(dict(fill(order, left, capacity - first)))
        left[first] += 1
        often = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= n * often
        order = [k for k in order if left[k]]
        windows.append((often, sorted(chosen.items(), reverse=True)))
    return windows


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


#: Fixed value: the pattern by which the library's byte-level rule cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def bytes_as_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def has_plain_rules(path: str) -> bool:
    """Whether the tokenizer file asks for nothing but byte-level pieces by PATTERN and the merges of its vocabulary."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    before, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    cuts = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
    extras = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return cuts and not rules.get("normalizer") and model.get("type") == "BPE" and not any(model.get(k) for k in extras)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, closing id included: those that the `tokenizers` library gives for the file at `path`.

    Vocabulary and merge order come from that file; a second byte-pair merger, several times faster, applies them (a test holds the two
    against each other), and texts with one of the file's special strings go to the library itself, as do all texts if the file has other rules than these.

    A byte-level BPE merges only within the pieces that its pattern cuts a text into, and where no two white-space characters meet, such a
    piece never crosses the place before a space. So a text is cut there, and each chunk's ids are found once and remembered.
    """

    _TWO_SPACES = re.compile(r"\s\s")

    def __init__(self, path: str, end_id: int = 1):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = has_plain_rules(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.uint32(end_id).tobytes()
        if not self.plain:
            return
        letters = {c: b for b, c in bytes_as_letters().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.known: dict[str, bytes] = {}
        self.core: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of " " + chunk: many in one call, told apart by the ids that begin with a space."""
        for k in range(0, len(chunks), 1000):
            part = chunks[k : k + 1000]
            text = " " + " ".join(part)
            if self._TWO_SPACES.search(text) or text[-1] == " ":
                self.known.update((c, self._ids(" " + c)) for c in part)
                continue
            raw = self._ids(text)
            starts = (4 * np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")])).tolist()
            if len(starts) != len(part):
                raise AssertionError("a chunk's ids don't begin with a space")
            self.known.update(zip(part, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return [np.array(x.ids, "<u4").tobytes() + self.end for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        plain = [not (self._TWO_SPACES.search(t) or any(s in t for s in self.special)) for t in texts]
        chunks = [t.split(" ") if ok else [] for t, ok in zip(texts, plain, strict=True)]
        if len(self.known) > MEMORY:
            self.core = self.core or dict(itertools.islice(self.known.items(), MEMORY // 4))
            self.known = dict(self.core)
        missing = set().union(*(parts[1:] for parts in chunks)).difference(self.known)
        if missing:
            self._learn(list(missing))
        heads = [self._ids(parts[0] if ok else t) for t, ok, parts in zip(texts, plain, chunks, strict=True)]
        return [h + b"".join(map(self.known.__getitem__, parts[1:])) + self.end for h, parts in zip(heads, chunks, strict=True)]


class Packer:
    """Packs the documents of one task; add() and finish() yield finished pieces."""

    def __init__(self, part: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, part << 40
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

    def _lay(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1
        return out

    def _full(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, view = len(ids) // 4, memoryview(ids)
        for start in range(0, total - self.capacity + 1, self.capacity):
            yield from self._lay([(doc_id, start, view[4 * start : 4 * (start + self.capacity)], total)])
        if rest := total % self.capacity:
            self.waiting.append((doc_id, total - rest, bytes(view[4 * (total - rest) :]), total))

    def add(self, docs: list[tuple]) -> Iterator[tuple]:
        for doc_id, ids in docs:
            yield from self._full(doc_id, ids)
        by: dict[int, list[tuple]] = {}
        for piece in self.waiting:
            by.setdefault(len(piece[2]) // 4, []).append(piece)
        self.waiting, slack = [], []
        for often, window in minimum_bin_slack({k: len(v) for k, v in by.items()}, self.capacity):
            full = sum(k * n for k, n in window) == self.capacity
            for _ in range(often):
                pieces = [by[k].pop() for k, n in window for _ in range(n)]
                if full:
                    yield from self._lay(pieces)
                else:
                    slack.append(pieces)
        yield from self._cut(slack)

    def _cut(self, windows: list[list[tuple]]) -> Iterator[tuple]:
        """Fill windows from the front with ids of those at the back, piece by piece; fewer than `capacity` ids go on waiting."""
        first, spare = 0, []
        while first < len(windows) or spare:
            window = windows[first] if first < len(windows) else []
            first += 1
            room = self.capacity - sum(len(p[2]) // 4 for p in window)
            while room and (spare or first < len(windows)):
                if not spare:
                    spare = windows.pop()
                doc_id, start, ids, total = spare.pop()
                n = min(room, len(ids) // 4)
                window.append((doc_id, start, ids[: 4 * n], total))
                room -= n
                if 4 * n < len(ids):
                    spare.append((doc_id, start + n, ids[4 * n :], total))
            if room:
                self.waiting = window
            else:
                yield from self._lay(window)

    def finish(self) -> Iterator[tuple]:
        left = sum(len(p[2]) // 4 for p in self.waiting)
        room, now = 0, []
        sizes = iter([self.capacity] * (left // self.capacity) + powers(left % self.capacity))
        for doc_id, start, ids, total in self.waiting:
            view, at = memoryview(ids), 0
            while at < len(ids):
                if not room:
                    room = next(sizes)
                n = min(room, len(ids) // 4 - at // 4)
                now.append((doc_id, start + at // 4, view[at : at + 4 * n], total))
                at, room = at + 4 * n, room - n
                if not room:
                    yield from self._lay(now)
                    now = []
        self.waiting = []


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, block_ids: int = BLOCK_IDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per piece: where its ids lie in the document and in which sequence, with their checksum."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = once(("tokenizer", tokenizer_path, end_id), lambda: Encoder(tokenizer_path, end_id))
        packer, block, size = Packer(TaskContext.get().partitionId(), capacity), [], 0

        def rows(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            if out := list(found):
                yield pd.DataFrame(out, columns=columns)

        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["_text"]]
            for doc_id, ids in zip(batch["_id"].tolist(), encoder.encode(texts), strict=True):
                block.append((None if doc_id != doc_id else doc_id, ids))
                size += len(ids) // 4
                if size >= block_ids or len(block) >= block_docs:
                    yield from rows(packer.add(block))
                    block, size = [], 0
        yield from rows(packer.add(block))
        yield from rows(packer.finish())

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
