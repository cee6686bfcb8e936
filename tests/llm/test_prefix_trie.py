import hashlib
import random
import zlib

import duckdb
from doctally.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def brute(rows):
    """Straight from the definition: every prefix of every rebuilt conversation."""
    own = {}
    for c, t, r, x, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append(c)
        ends.setdefault(rebuilt, []).append(c)
    out = []
    for k, ms in members.items():
        below = [x for x in members if x[: len(k)] == k]
        kids = lambda k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), len(kids(k)), sum(not kids(x) for x in below), saved, digest))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted(map(tuple, P.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def made(seed, ids, words="abc", most=7):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", rng.choice(words) * rng.randint(1, 2), "x") for c in ids for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = made(1, [*range(60), *range(100, 140), *range(230, 240), *range(300, 310)], "ab")
    assert found(spark, rows) == brute(rows)
    # a group of copies over many families, and a long conversation
    rows = [(100 * i + 7 + i % 5, t, "user", f"turn {t}", "x") for i in range(80) for t in range(3)] + [(4000, t, "user", str(t % 3), "x") for t in range(700)]
    assert found(spark, rows)[:400] == brute(rows)[:400]


def test_odd_rows(spark):
    rows = made(3, [-250, -205, -200, -101, -100, -3, 0, 5, 2**60, 2**60 + 1, 901, 902, 950], "ab", 4)
    rows += [(None, 0, "user", "no id", "x"), (5, None, None, None, "x"), (5, None, "user", "b", "x"), (0, 2, "user", "tie", "x"), (0, 2, "user", "tie", "x"), (0, 2, "a", "tie", "x")]
    rows += [(7, 0, "ab", "c", "x"), (8, 0, "a", "bc", "x"), (901, 99, "user", "日本 🎈 é", "x"), (903, 0, "user", "lone", "x"), (5, 3, "user", "long " * 40_000, "x")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x", "x")]) == []


def test_families_in_parts(monkeypatch):
    """A family that is handed on in parts gives the same sums."""
    rows = [(0, c, zlib.crc32(str(c).encode()) % 6, bytes([t % 3, c % 2]), 1) for c in range(30) for t in range(9)]
    batch = P.pa.RecordBatch.from_arrays([P.pa.array(x) for x in zip(*rows, strict=True)], ["b", "c", "h", "t", "n"])

    def summed():
        nodes, ends = {}, []
        for out in P.family_tries(iter([batch.slice(0, 50), batch.slice(50)])):
            for r in out.to_pylist():
                if r["ends"]:
                    ends.append((r["key"], r["conv_id"]))
                else:
                    at = nodes.setdefault((r["key"], r["parent"], r["depth"], r["chars"]), [10**9, 0])
                    at[0], at[1] = min(at[0], r["conv_id"]), at[1] + r["n"]
        return nodes, sorted(ends)

    whole = summed()
    monkeypatch.setattr(P, "FLUSH", 7)
    assert summed() == whole and whole[0][(P.ROOT, None, 0, 0)] == [0, 30]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = P.op12_prefix_trie(spark, d).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{d}/conversations.parquet')")
    wanted = con.sql(P.ORACLE).df()[list(got.columns)]
    order = ["conv_id", "depth"]
    got, wanted = (t.sort_values(order).astype(object).where(t.notna(), None).values.tolist() for t in (got, wanted))
    assert got == wanted
