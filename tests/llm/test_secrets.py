import hashlib
import math
import random
import re
from collections import Counter

from doctally.llm import secrets as S


def base(text):
    """Base spans by Python's regular expressions."""
    text, spans = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def corpus():
    rng = random.Random(4)
    key = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, f"wörds 😀 and more {key(b64, 40)} here", "en") for i in range(30)]
    rows += [(100 + i, "donaudampfschifffahrtsgesellschaft " + "internationalisation" * 2, "de") for i in range(30)]
    texts = [
        "é password=abc123 token : 'xy' SECRET=\"a.b-c/d+e\" apikey=short1", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "x" + "0a" * 12 + "g" + "ff" * 11, "\u0001" + "ab" * 12 + "\u0001password=aaaaaa\u0002", None, "",
        "password=" + "deadbeef" * 4, "api_key := no", "tokentoken=abcdefg", "AKIAAKIA" + "Z" * 20, "ſecret=abcdefgh", "word " * 30_000 + "password=" + "Z9" * 5, "token=" + "abcdef ".join("token=" for _ in range(200)),
    ]
    return rows + [(200 + i, t, "en") for i, t in enumerate(texts)] + [(200, texts[0], "en"), (None, texts[0], "en")]


def test_against_python(spark, docs, stored, clash):
    rows = corpus()
    found = S.op8_secrets(spark, stored(documents=clash(docs(rows)))).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        spans = base(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, x, _ in spans) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == [x for x in joined(spans).split(",") if x]
    random_ones = {r["doc_id"] for r in found if "random" in r["spans"]}
    assert len(random_ones & set(range(30))) >= 27 and not random_ones & set(range(100, 130))


def test_redaction(docs, clash):
    rows = corpus()
    frame = clash(docs(rows)).withColumns({c: S.F.lit("x") for c in ("_clean", "_base", "_all", "_new", "_found_base", "__found", "_FOUND_all", "base", "all", "clean")})
    out = S.redact(frame)
    assert out.columns == frame.columns
    texts = {i: t for i, t, _ in rows}
    for r in out.collect():
        before = texts[r["doc_id"]]
        if before is None or r["text"] == before:
            assert r["text"] == before and not base(before)
        else:
            assert not base(r["text"]) and r["n_chars"] == len(r["text"]) and "[secret]" in r["text"]


def test_empty(docs):
    assert S.scan(docs([])).count() == 0


def test_overlapping_spans_are_replaced_once(spark, docs):
    hexes = "0123456789abcdef" * 2
    text = f"a password={hexes} b token={hexes}, AKIA{'A' * 16} c"
    assert S.redact(docs([(1, text, "en")])).first()["text"] == "a [secret] b [secret], [secret] c"
    assert S.redact(docs([(1, hexes, "en")])).first()["text"] == "[secret]"


def test_many_matches_in_one_text(spark, docs):
    import time

    took = {}
    for n in (2000, 16000):
        frame = docs([(1, "key " + "token=abcdef12 x " * n, "en")])
        began = time.perf_counter()
        row = S.scan(frame, highest=[-1] * 4).first()
        took[n] = time.perf_counter() - began
        assert row["n_assign"] == n and row["spans"].count("assign") == n
        assert S.redact(frame, highest=[-1] * 4).first()["text"] == "key " + "[secret] x " * n
    assert took[16000] < 20 * max(took[2000], 0.3)


def p_value(run):
    """The three tests, straight from their definitions."""
    body = run.rstrip("=")
    alphabet = next((a for p, a in S.ENCODINGS if re.search(p, body)), S._UPPER + S._LOWER + S._DIGITS + "+/-_")
    k, n, middle = len(alphabet), len(body), (len(alphabet) + 1) / 2
    at = [alphabet.find(c) + 1 - middle for c in body]
    chi = sum((body.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    z = [(chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)]
    high = sum(x > 0 for x in at)
    m = 2 * high * (n - high) / n
    changes = sum((x > 0) != (y > 0) for x, y in zip(at, at[1:], strict=False))
    z.append((changes - m) / math.sqrt(m * (m - 1) / (n - 1)) if m > 1 else math.sqrt(n))
    mean = sum(at) / n
    spread = sum((x - mean) ** 2 for x in at)
    z.append(sum((x - mean) * (y - mean) for x, y in zip(at, at[1:], strict=False)) / spread * math.sqrt(n) if spread else math.sqrt(n))
    tail = lambda z: 2 / (1 + math.exp(1.5976 * min(abs(z), 60) + 0.070565992 * min(abs(z), 60) ** 3)) if min(abs(z), 60) < 20 else 0.0
    return min(1.0, 3 * min(map(tail, z)))


def test_random_spans_by_brute_force(spark, docs):
    rows = corpus()
    cleaned = [(i, (t or "").replace("\u0001", "\u0002")) for i, t, _ in rows]
    runs = [(k, m.start(), m.end(), m[0]) for k, (_, t) in enumerate(cleaned) for m in re.finditer(S.RUN, t)]
    cell = lambda run: min(S.CELLS, math.floor(-10 * math.log10(max(p_value(run), 1e-30))))
    size = lambda a, b: max(k for k, least in enumerate(S.CLASSES) if b - a >= least)
    counts = [(size(a, b), cell(r), bool(re.search("^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", r))) for _, a, b, r in runs]
    cuts = []
    for k in range(len(S.CLASSES)):
        best = -1
        for c in range(S.FLOOR + 1):
            real, decoy = (sum(x[0] == k and x[1] <= c and x[2] == d for x in counts) for d in (False, True))
            if real and decoy <= 0.05 * real:
                best = c
        cuts.append(best)
    assert S.cuts(docs(rows)) == cuts
    want = Counter()
    for k, (i, t) in enumerate(cleaned):
        own = base(t)
        want[i, ",".join(f"random:{a}:{b}" for n, a, b, r in runs if n == k and cell(r) <= cuts[size(a, b)] and not any(x <= a and y >= b for x, _, y in own))] += 1
    got = Counter((r["doc_id"], ",".join(x for x in r["spans"].split(",") if x.startswith("random"))) for r in S.scan(docs(rows)).collect())
    assert got == want
