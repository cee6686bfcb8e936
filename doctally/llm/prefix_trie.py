"""Prefix trie of conversations that are rebuilt from their family's first turns.

Conversations of one base id form a family. They are brought together by a shuffle on the base id and a sort that puts the base conversation first, and each task streams through its
families: it keeps the base's first turns, rebuilds every conversation, and builds the family's small trie. A node is known by a hash chained from its parent's hash and the turn's digest,
so texts stay behind; only the combined nodes of families are shuffled, summed before they leave a task. A family with more than FLUSH nodes is handed on in parts, which changes nothing,
as parts are summed like families.

Sums over subtrees need no walk down the trie: a node belongs to its smallest member, so each conversation owns the lower part of its own path, and hangs by it on a node of a smaller
one. Totals of these paths are summed up their tree by pointer doubling (as many rounds as the tree's depth has binary digits), and what lies below a node is the rest of its path and
what hangs on it. The ids that end in a node are gathered in ascending pieces and hashed while they stream by.

Defined results: turns are ordered by turn (null first), equal ones by role, then text; repeated turns are turns of their own. Null role or text is empty. Rows without conv_id are left
out. A conversation whose rebuilt turns are none is a member of the root alone and ends there. No conversations: no nodes, not even the root. Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FAMILY = 100
HEADS = 6
#: Nodes of a family that are held at once.
FLUSH = 100_000
#: Conversation ids whose ends are joined to one piece.
PIECE = 4096
ROOT = b"root"
_NODES = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.bool_())])


def child(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn, digest_size=16).digest()


class Trie:
    """A family's nodes: key, then parent, depth, code points of the last text, smallest member, members."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.ends: list[tuple[bytes, int]] = []

    def enter(self, conv: int, key: bytes, parent: bytes | None, depth: int, chars: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [parent, depth, chars, conv, 1]
        else:
            node[3] = min(node[3], conv)
            node[4] += 1

    def rows(self) -> pa.RecordBatch:
        out = [(k, *v, False) for k, v in self.nodes.items()] + [(k, None, None, None, c, 0, True) for k, c in self.ends]
        return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*out, strict=True), _NODES, strict=True)], schema=_NODES)

    def __len__(self) -> int:
        return len(self.nodes) + len(self.ends)


class Walk:
    """The way of the conversation that is being rebuilt."""

    def __init__(self, trie: Trie, conv: int):
        self.trie, self.conv, self.key, self.depth = trie, conv, ROOT, 0
        trie.enter(conv, ROOT, None, 0, 0)

    def step(self, turn: bytes, chars: int) -> None:
        parent, self.key, self.depth = self.key, child(self.key, turn), self.depth + 1
        self.trie.enter(self.conv, self.key, parent, self.depth, chars)


def family_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (base, conv_id, heads, turn's digest, code points), a family's together, its base first: the families' nodes and ends."""
    trie, walk, base, head, seen = Trie(), None, None, [], 0
    for batch in batches:
        for b, c, heads, turn, chars in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if walk is None or c != walk.conv:
                if walk is not None:
                    trie.ends.append((walk.key, walk.conv))
                if b != base:
                    base, head = b, []
                if len(trie) > FLUSH:
                    yield trie.rows()
                    trie = Trie()
                walk, seen = Walk(trie, c), 0
                if c != b:
                    for t in head[:heads]:
                        walk.step(*t)
            seen += 1
            if c == b and seen < HEADS:
                head.append((turn, chars))
            if c == b or seen > heads:
                walk.step(turn, chars)
            if len(trie) > FLUSH:
                yield trie.rows()
                trie.nodes, trie.ends = {}, []
    if walk is not None:
        trie.ends.append((walk.key, walk.conv))
        yield trie.rows()


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, ids) in order: SHA-256 of each key's pieces, joined by commas, one piece at a time."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(("key", "ends_sha256"), x, strict=True)) for x in done], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema=schema)


def _families(conversations: DataFrame) -> DataFrame:
    conv, base = F.col("_c"), F.col("_b")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("_c"), "turn", F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text")
    )
    rows = rows.withColumn("_b", conv - conv % FAMILY).repartition("_b").sortWithinPartitions("_b", conv != base, "_c", F.asc_nulls_first("turn"), "_role", "_text")
    digest = F.unhex(F.sha2(F.concat(F.length("_role"), F.lit(":"), "_role", "_text"), 256))
    heads = F.crc32(conv.cast("string").cast("binary")) % HEADS
    rows = rows.select("_b", "_c", heads.alias("heads"), digest.alias("turn"), F.length("_text").cast("long").alias("chars"))
    return rows.mapInArrow(family_tries, "key binary, parent binary, depth long, chars long, conv_id long, n long, ends boolean")


def _totals(paths: DataFrame) -> DataFrame:
    """paths (conv_id, up, at, tokens, leaves) with tokens and leaves of all paths that hang on each, however far below."""
    rows = common.materialise(paths.withColumn("_to", F.col("up")))
    while rows.where("_to is not null").take(1):
        below = rows.where("_to is not null").groupBy(F.col("_to").alias("conv_id")).agg(F.sum("tokens").alias("_t"), F.sum("leaves").alias("_l"))
        # the pointer of the pointer: the path that a hot one hangs on may be asked for by many, so those without a further one leave first
        further = rows.where("_to is not null").select(F.col("conv_id").alias("_to"), F.col("_to").alias("_next"))
        step = rows.join(below, "conv_id", "left").join(further, "_to", "left")
        more = [(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("tokens", "_t"), ("leaves", "_l"))]
        done, rows = rows, common.materialise(step.select("conv_id", "up", "at", *more, F.col("_next").alias("_to")))
        common.discard(done)
    return rows.drop("_to")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    families = common.materialise(_families(conversations))
    merged = families.where("not ends").groupBy("key", "parent", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
    pieces = families.where("ends").groupBy("key", F.floor(F.col("conv_id") / PIECE).alias("_at")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("_ids"))
    ends = pieces.repartition("key").sortWithinPartitions("key", "_at").select("key", "_ids").mapInArrow(hashed_ends, "key binary, ends_sha256 string")
    nodes = common.materialise(merged.join(ends, "key", "left"))
    root = nodes.where("depth = 0").select("conv_id").first()
    root = F.lit(root["conv_id"] if root else None).cast("long")
    # the root has the most children: its id is a constant
    above = nodes.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"))
    parent = F.when(F.col("depth") == 1, root).otherwise(F.col("_above"))
    owned = nodes.where("depth < 2").withColumn("_above", F.lit(None).cast("long")).unionByName(nodes.where("depth > 1").join(above, "parent", "left"))
    owned = common.materialise(owned.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens"), "ends_sha256"))

    paths = owned.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("at"), F.max("depth").alias("_last"), F.sum("tokens").alias("tokens"))
    paths = common.materialise(paths)
    hang = paths.where("up is not null")
    hung = hang.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("_last")).agg(F.lit(0).alias("leaves"))
    paths = paths.join(hung, ["conv_id", "_last"], "left").withColumn("leaves", F.coalesce("leaves", F.lit(1)).cast("long")).drop("_last")
    below = _totals(paths).where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth"))
    below = below.agg(F.count(F.lit(1)).alias("_kids"), F.sum("tokens").alias("_tokens"), F.sum("leaves").alias("_leaves"))

    rows = owned.join(below, ["conv_id", "depth"], "left").fillna(0, ["_kids", "_tokens", "_leaves"])
    path = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    last = F.lag("depth").over(path).isNull()
    rows = rows.withColumns({"n_children": F.col("_kids") + F.when(last, 0).otherwise(1), "_leaf": F.when(last & (F.col("_kids") == 0), 1).otherwise(0)})
    rest = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.sum(F.col("_leaves") + F.col("_leaf")).over(rest).alias("n_leaves"),
        F.sum(F.col("tokens") + F.col("_tokens")).over(rest).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: CRC-32 of a decimal number, bit by bit, since DuckDB has none.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(256 + ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda s, x: CASE WHEN xor(s, x % 256) % 2 = 1 THEN xor(xor(s, x % 256) >> 1, 3988292384) ELSE xor(s, x % 256) >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295)"""
ORACLE = f"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS s, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, s.r, s.x) AS own, {_CRC} % 6 AS h FROM t GROUP BY conv_id),
b AS (SELECT o.conv_id, list_concat(coalesce(f.own[1:o.h], []), o.own[o.h + 1:]) AS turns FROM o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % 100),
m AS (SELECT conv_id, d AS depth, turns[1:d] AS k, turns[1:d - 1] AS up, len(turns) AS n, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].x) END AS chars FROM b, unnest(range(len(turns) + 1)) u(d)),
g AS (SELECT k, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY k, depth),
c AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c ON c.k = g.k AND c.depth = g.depth),
s AS (SELECT a.k, a.depth, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
    FROM w a JOIN w x ON x.depth >= a.depth AND x.k[1:a.depth] = a.k GROUP BY a.k, a.depth)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.k = w.k AND s.depth = w.depth LEFT JOIN w p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.k = w.up
"""


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(common.read(spark, sf_dir, "conversations"))
