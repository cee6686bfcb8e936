"""URL filter over a sorted digest array.

Each rule (host, path, verdict) becomes the 64-bit xxhash of its text; the rules are broadcast, and every Python worker sorts the digests into an anonymous
memory map once. A url's candidates - the suffixes of its host, at a label's start, with the prefixes of its path that have the lengths of some rule's host and path - are
hashed and probed together by vectorised binary search; a hit counts only if the stored full string is the same, so hash collisions (which
stand next to each other in the array) cannot decide. The longest confirmed rule wins. So a url costs as much as there are pairs of lengths among the rules, however long it is.
More than MAX_RULES rules take a pass over the urls for each so many.

Nulls: a null url, or one without ``://``, has empty host and path and fits no rule; the verdict is then the default. Empty tables give empty
results; repeated rows are judged each. Other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import mmap
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, once

#: Rules that are sent to executors at once: their strings and digests then take under 200 MB.
MAX_RULES = 1_000_000
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII letters lower-cased) and path of a url."""
    found = _HOST.search(url) if url is not None else None
    if not found:
        return "", ""
    host = found[1]
    return (host.lower() if host.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), host)), found[2]


class DigestArray:
    """Sorted 64-bit digests in a memory map, with the full strings behind them."""

    def __init__(self, rules: list[tuple[str, str, str]], digest=lambda s: xxhash.xxh64_intdigest(s.encode())):
        self.digest = digest
        verdicts: dict[str, str] = {}
        for host, path, verdict in rules:
            if verdicts.setdefault(host + path, verdict) != verdict:
                raise ValueError(f"two verdicts for {host + path}")
        keys = sorted(verdicts, key=lambda s: (digest(s), s))
        self.texts, self.verdicts = keys, [verdicts[k] for k in keys]
        self.lengths = sorted({(len(host), len(path)) for host, path, _ in rules}, key=lambda x: (-sum(x), x))
        if not keys:
            self.array = np.zeros(0, np.uint64)
            return
        digests = np.array([digest(k) for k in keys], np.uint64).tobytes()
        memory = mmap.mmap(-1, len(digests))  # no file: a machine's folders are not to be counted on
        memory.write(digests)
        self.array = np.frombuffer(memory, np.uint64)

    def candidates(self, host: str, path: str) -> list[str]:
        """Keys that a rule fitting this url can have, longest first."""
        if not host:
            return []
        starts = {n: len(host) - n for n, _ in self.lengths if n == len(host) or n < len(host) and host[-n - 1] == "."}
        return list(dict.fromkeys(host[starts[n] :] + path[:m] for n, m in self.lengths if n in starts and m <= len(path)))

    def probe(self, keys: list[str]) -> np.ndarray:
        """For each key the index of its rule, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.array):
            return out
        wanted = np.array([self.digest(k) for k in keys], np.uint64)
        low, high = np.searchsorted(self.array, wanted, "left"), np.searchsorted(self.array, wanted, "right")
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                if self.texts[j] == keys[i]:
                    out[i] = j
                    break
        return out

    def judge(self, urls: list[str | None], default: str) -> pd.DataFrame:
        split = [split_url(u) for u in urls]
        known: dict[tuple[str, str], list[str]] = {x: self.candidates(*x) for x in set(split)}
        keys = sorted({k for ks in known.values() for k in ks})
        at = dict(zip(keys, self.probe(keys).tolist(), strict=True))
        best = {x: next((at[k] for k in ks if at[k] >= 0), -1) for x, ks in known.items()}
        hit = [best[x] for x in split]
        return pd.DataFrame(
            {
                "host": [h for h, _ in split],
                "path": [p for _, p in split],
                "rule": [self.texts[i] if i >= 0 else None for i in hit],
                "verdict": [self.verdicts[i] if i >= 0 else default for i in hit],
            },
            dtype=object,
        )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most: int = MAX_RULES) -> DataFrame:
    """One row per row of pages: its id, host, path, the rule that decides (null: none) and the verdict."""
    rules = sorted(rules, key=lambda r: r[0] + r[1])  # rules of one text stand together, and their verdicts are held against each other
    cuts = [0]
    while cuts[-1] < len(rules) or len(cuts) == 1:
        cut = cuts[-1] + most
        while cut < len(rules) and rules[cut][0] + rules[cut][1] == rules[cut - 1][0] + rules[cut - 1][1]:
            cut += 1
        cuts.append(min(cut, max(len(rules), 1)))
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    schema = "host string, path string, rule string, verdict string"
    for k, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
        run = _judging(pages.sparkSession.sparkContext.broadcast(rules[start:stop]), default, k > 0)
        found = rows.mapInPandas(run, f"_id {id_type}, _url string, {schema}")
        rows = materialise(found) if stop < len(rules) else found
    return rows.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")


def _judging(shared, default: str, later: bool):
    """A pass over urls with one part of the rules; a later one keeps what longer rules of earlier ones decided."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = once(("urls", name), lambda: DigestArray(shared.value))
        for batch in batches:
            out = array.judge([None if u is None or u is pd.NA else u for u in batch["_url"]], default)
            if later:
                sizes = [[len(r) if isinstance(r, str) else -1 for r in t["rule"]] for t in (batch, out)]
                kept = np.array(sizes[0]) >= np.array(sizes[1])
                for c in ("rule", "verdict"):
                    out[c] = np.where(kept, batch[c], out[c])
            yield pd.DataFrame({"_id": batch["_id"].values, "_url": batch["_url"].values} | {c: out[c].values for c in out.columns})

    return run


#: Fixed values of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE = r"""
WITH s AS (SELECT page_id, strpos(url, '://') AS k, substr(url, strpos(url, '://') + 3) AS r FROM pages),
p AS (SELECT page_id,
    CASE WHEN k > 0 THEN translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN k > 0 THEN regexp_extract(r, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM s),
rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (SELECT page_id, host, path, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS n
    FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, hits.rule, coalesce(hits.v, 'allow') AS verdict
FROM p LEFT JOIN hits ON hits.page_id = p.page_id AND hits.n = 1
"""


def op7_url_filter(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
