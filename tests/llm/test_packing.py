import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from doctally.llm import packing as P


def best_sum(items, room):
    return max((sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room), default=0)


def test_fill_is_closest():
    rng = random.Random(0)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        counts = {k: items.count(k) for k in set(items)}
        room = rng.randint(0, 80)
        got = P.fill(sorted(counts, reverse=True), counts, room)
        assert sum(k * n for k, n in got) == best_sum(items, room) and all(0 < n <= counts[k] for k, n in got)


def test_windows_use_every_length_once():
    rng = random.Random(1)
    counts = {rng.randint(1, 2047): rng.randint(1, 5) for _ in range(300)}
    used = {}
    for often, window in P.minimum_bin_slack(dict(counts)):
        assert sum(k * n for k, n in window) <= 2048
        for k, n in window:
            used[k] = used.get(k, 0) + n * often
    assert used == counts


HARD = ["a  b", "a\n b", " a", "a ", "", "x<|endoftext|>y  z", "\n\n a\tb \n c", "é à ü\u3000x", "it's  we'll 12,3", "one two three\nfour", "a \n", "😀 😀", "\u00a0 x", "w " * 3000, "日本語 テキスト"]


def test_ids_are_the_tokenizers():
    library, encoder = Tokenizer.from_file(P.default_tokenizer()), P.Encoder(P.default_tokenizer())
    for texts in (HARD, HARD[::-1]):
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids + [1]


def test_other_rules_go_to_the_library(tmp_path):
    """A file with other cuts than the plain ones is not read by the second merger."""
    import json

    with open(P.default_tokenizer(), encoding="utf-8") as file:
        rules = json.load(file)
    assert P.has_plain_rules(P.default_tokenizer())
    rules["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(rules))
    assert not P.has_plain_rules(str(other))
    library, encoder = Tokenizer.from_file(str(other)), P.Encoder(str(other))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(HARD)] == [library.encode(t, add_special_tokens=False).ids + [1] for t in HARD]


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 3}, {"block_ids": 2500}])
def test_pieces(spark, docs, stored, clash, blocks):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "Gamma-ray", "δ"]) for _ in range(rng.choice([0, 5, 300, 3000]))), "en") for i in range(60)]
    rows += [(100 + i, t, "en") for i, t in enumerate(HARD)] + [(200, None, "en"), (7, rows[7][1], "en"), (None, "no id", "en"), (None, None, "en")]
    frame = spark.read.parquet(f"{stored(documents=clash(docs(rows)).repartition(3))}/documents.parquet")
    pieces = P.pack(frame, P.default_tokenizer(), **blocks).collect()
    library = Tokenizer.from_file(P.default_tokenizer())
    ids_of = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows if i is not None}
    sequences, covered = {}, {}
    for r in pieces:
        if r["doc_id"] is not None:
            ids = ids_of[r["doc_id"]]
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    for i, ids in ids_of.items():
        assert sorted(covered[i]) == sorted(list(range(len(ids))) * (2 if i == 7 else 1))
    assert sorted(covered[None]) == sorted([*range(len(library.encode("no id", add_special_tokens=False).ids) + 1), 0])
    # all but what each task has left at its close are full windows
    assert sum(1 for p in sequences.values() if sum(n for _, n in p) < 2048) <= 3 * 11


def test_empty(docs):
    assert P.pack(docs([]), P.default_tokenizer()).count() == 0


@pytest.mark.parametrize("lengths", [[1500], [1025], [2047, 1], [700, 900], [3000], [1], [2048], [5, 1999, 64, 777, 2046]])
def test_every_block_leaves_full_windows(lengths):
    """Equal lengths that no multiset fills: windows leave with their block, nearly nothing waits, and each id is laid once."""
    packer, laid, total = P.Packer(0), {}, 0
    for block in range(4):
        sizes = [lengths[i % len(lengths)] for i in range(500)]
        docs = [(f"{block}-{i}", np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(sizes)]
        total += sum(sizes)
        pieces = list(packer.add(docs))
        for p in pieces:
            laid.setdefault(p[5], []).append(p)
        assert sum(len(p[2]) // 4 for p in packer.waiting) < 2048
    assert all(sum(p[2] for p in s) == 2048 for s in laid.values())
    rest = list(packer.finish())
    assert sum(p[2] for s in laid.values() for p in s) + sum(p[2] for p in rest) == total and sum(p[2] for p in rest) < 2048
    by = {}
    for p in [*rest, *(p for s in laid.values() for p in s)]:
        by.setdefault(p[0], []).extend(range(p[1], p[1] + p[2]))
        assert p[3] == zlib.crc32(np.arange(p[1], p[1] + p[2], dtype="<u4").tobytes())
    assert all(sorted(ids) == list(range(len(ids))) for ids in by.values())
