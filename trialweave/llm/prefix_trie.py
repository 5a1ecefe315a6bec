"""Prefix trie of conversations, as a node table with minimal perfect hashes per shard.

Every distinct sequence of first turns is a node. Its digest is the sum of its turns' hashes, each
salted with its position, so that digests are running sums and a conversation of any length can be
summed in pieces. A node belongs to its smallest member, its owner; a conversation owns a tail of
its own path and nothing before it.

What a subtree sums is additive over owners: each node's weight is counted once, by its owner, and
goes to the nodes above it on the owner's path. So conversations are dealt to shards, in pieces of
``CHUNK`` turns, and a shard needs only the paths of the owners it holds. Within a shard the
distinct digests get slots by a minimal perfect hash, each slot keeps its digest to verify what is
looked up, weights are scattered into flat arrays, and the arrays are added up through the parents'
slots, deepest first. The shards' sums of one node are then added by digest. Conversations that own
nothing (copies) take no part, and a node shared by very many meets in no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.llm.ranking import ranked
from trialweave.session import ship_package, written

LANES = ("l0", "l1", "l2", "l3")
#: Turns of one conversation that one shard takes together.
CHUNK = 4096
#: Rows of a shard, about; 64 neighbouring conversations stay together.
SHARD_ROWS = 100_000
#: Member ids that one string holds.
LIST = 4096
KEY = ["depth", "a", "b"]
SUMS = "depth long, a long, b long, n_leaves long, saved long, n_children long"


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys: key -> slot below the number of keys.

    Each round hashes the keys that are left to twice as many cells; a key alone in its cell is
    placed, and its slot is the number of occupied cells before it. Slots keep their keys, so a key
    that is not in the table is told from one that is.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.rounds: list[tuple[int, np.ndarray, int]] = []
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        left, base = np.arange(len(a)), 0
        while len(left):
            cells = 2 * len(left) + 1
            at = self._cell(a[left], b[left], len(self.rounds), cells)
            alone = np.bincount(at, minlength=cells) == 1
            self.rounds.append((base, np.cumsum(alone) - alone + base, cells))
            placed = alone[at]
            slot = self.rounds[-1][1][at[placed]]
            self.a[slot], self.b[slot] = a[left[placed]], b[left[placed]]
            base += int(alone.sum())
            left = left[~placed]
            if len(self.rounds) > 200:
                raise ValueError("keys are not distinct")

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, seed: int, cells: int) -> np.ndarray:
        x = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed * 0xD6E8FEB86659FD93 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(cells)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the table does not have it."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for seed, (_, slot, cells) in enumerate(self.rounds):
            if not len(left):
                break
            found = slot[self._cell(a[left], b[left], seed, cells)]
            found = np.minimum(found, len(self.a) - 1)
            right = (self.a[found] == a[left]) & (self.b[found] == b[left])
            out[left[right]] = found[right]
            left = left[~right]
        return out


def add_up(table: pa.Table) -> pa.Table:
    """Sums over the subtrees of a shard's nodes; rows of one node may repeat, depth 0 is the root.

    Rows that are not ``linked`` start a piece of a conversation; their parent's sums come otherwise.
    """
    col = {c: table.column(c).to_numpy() for c in ("depth", "a", "b", "up_a", "up_b", "n_leaves", "saved", "owned", "linked")}
    first = col["depth"] == 1
    pairs = np.stack([np.append(col["a"], 0) if first.any() else col["a"],
                      np.append(col["b"], 0) if first.any() else col["b"]], axis=1)
    distinct, row = np.unique(pairs, axis=0, return_index=True)
    slots = SlotTable(distinct[:, 0].copy(), distinct[:, 1].copy())
    size, rows = len(distinct), len(first)
    own, up = slots.slots(col["a"], col["b"]), slots.slots(col["up_a"], col["up_b"])
    if (own < 0).any() or (up[col["linked"]] < 0).any():
        raise ValueError("a digest without a slot")
    up[~col["linked"]] = -1
    depth, parent = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    depth[own], parent[own] = col["depth"], up
    n_leaves, saved, n_children = (np.zeros(size, np.int64) for _ in range(3))
    np.add.at(n_leaves, own, col["n_leaves"])
    np.add.at(saved, own, col["saved"])
    inside = up >= 0
    np.add.at(n_children, up[inside], col["owned"][inside])
    order = np.argsort(-depth, kind="stable")
    starts = np.flatnonzero(np.diff(depth[order], prepend=-1))
    for i, j in zip(starts, [*starts[1:], size]):
        level = order[i:j][parent[order[i:j]] >= 0]
        np.add.at(n_leaves, parent[level], n_leaves[level])
        np.add.at(saved, parent[level], saved[level])
    return pa.table({"depth": depth, "a": slots.a, "b": slots.b, "n_leaves": n_leaves, "saved": saved,
                     "n_children": n_children})


def prefix_digests(turns: DataFrame) -> DataFrame:
    """conv_id, depth, said, bytes, length -> the same with the digests (a, b) and (up_a, up_b) of the prefix and its parent."""
    salted = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("said")))
    lanes = [F.conv(F.substring("salted", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)]
    piece = F.expr(f"(depth - 1) div {CHUNK}L")
    rows = (turns.withColumn("salted", salted).select("conv_id", "depth", "bytes", "length", piece.alias("piece"), *lanes))
    rows = written(rows, "trie-turns")
    running = W.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    # Only conversations of more than one piece have something to carry.
    carried = (rows.filter(F.col("length") > CHUNK).groupBy("conv_id", "piece").agg(*[F.sum(c).alias(c) for c in LANES])
               .select("conv_id", "piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in LANES]))
    mod = 1 << 32
    through = [(F.sum(c).over(running)).alias(f"{c}_sum") for c in LANES]
    summed = (rows.select("*", *through).join(carried, ["conv_id", "piece"], "left")
              .select("conv_id", "depth", "bytes", "length", "piece", *LANES,
                      *[((F.col(f"{c}_sum") + F.coalesce(F.col(f"{c}_before"), F.lit(0))) % mod).alias(f"{c}_sum")
                        for c in LANES]))
    pack = lambda x, y: F.shiftleft(x, 32).bitwiseOR(y)
    own = [F.col(f"{c}_sum") for c in LANES]
    up = [F.pmod(F.col(f"{c}_sum") - F.col(c), F.lit(mod)) for c in LANES]
    return summed.select("conv_id", "depth", "bytes", "length", "piece",
                         pack(own[0], own[1]).alias("a"), pack(own[2], own[3]).alias("b"),
                         pack(up[0], up[1]).alias("up_a"), pack(up[2], up[3]).alias("up_b"))


def shard_sums(rows: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """Subtree sums of all nodes, one row for each shard that has the node."""
    shared = nodes.groupBy("owner").agg((F.min("depth") - 1).alias("shared"))
    zero = F.lit(0).cast("long")
    path = (rows.join(shared, F.col("conv_id") == F.col("owner")).filter(F.col("depth") <= F.col("shared"))
            .select("conv_id", *KEY, "up_a", "up_b", "piece", zero.alias("n_leaves"), zero.alias("saved"), zero.alias("owned")))
    mine = nodes.select(F.col("owner").alias("conv_id"), *KEY, "up_a", "up_b", F.expr(f"(depth - 1) div {CHUNK}L").alias("piece"),
                        F.when(F.col("deepest") == F.col("depth"), 1).otherwise(0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.lit(1).cast("long").alias("owned"))
    items = path.unionByName(mine)
    # What later pieces of a conversation hold comes in at the last turn of each earlier piece.
    ends = items.filter(F.col("depth") % CHUNK == 0).select("conv_id", "piece", zero.alias("n_leaves"), zero.alias("saved"))
    later = W.partitionBy("conv_id").orderBy(F.col("piece").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = (mine.filter(F.col("depth") > CHUNK).select("conv_id", "piece", "n_leaves", "saved").unionByName(ends)
               .groupBy("conv_id", "piece").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
               .select("conv_id", "piece", F.sum("n_leaves").over(later).alias("more_leaves"),
                       F.sum("saved").over(later).alias("more_saved"), (F.col("piece") * CHUNK + CHUNK).alias("depth"))
               .filter("more_leaves > 0 OR more_saved > 0"))
    items = items.join(carried, ["conv_id", "piece", "depth"], "left").withColumns({
        "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero)})
    shard = F.pmod(F.xxhash64(F.shiftright("conv_id", 6), "piece"), F.lit(shards))
    linked = (F.col("depth") == 1) | ((F.col("depth") - 1) % CHUNK != 0)
    sums = (items.select(*KEY, "up_a", "up_b", "n_leaves", "saved", "owned", linked.alias("linked"), shard.alias("shard"))
            .groupBy("shard").applyInArrow(_of_shard, SUMS))
    children = nodes.filter((F.col("depth") > 1) & ((F.col("depth") - 1) % CHUNK == 0)).select(
        (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), zero.alias("n_leaves"),
        zero.alias("saved"), F.lit(1).cast("long").alias("n_children"))
    return sums.unionByName(children)


def _of_shard(table: pa.Table) -> pa.Table:
    return add_up(table)


def member_lists(members: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id) -> (depth, a, b, ends_sha256): digest of the ids, ascending, joined by commas.

    Ids are joined in pieces; a hash is sequential, so the pieces of one node go through one task,
    as a stream of strings.
    """
    rows = ranked(members, KEY, ["conv_id"], "at", "n", "trie-ends")
    pieces = (rows.groupBy(*KEY, "n", F.expr(f"at div {LIST}L").alias("piece"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))
    pieces = written(pieces, "trie-lists")
    alone = pieces.filter(F.col("n") <= LIST).select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = (pieces.filter(F.col("n") > LIST).select(*KEY, "piece", "ids").repartition(*KEY)
            .sortWithinPartitions(*KEY, "piece").select(*KEY, "ids"))
    return alone.unionByName(many.mapInArrow(_hash_lists, "depth long, a long, b long, ends_sha256 string"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, done = None, None, []
    for batch in batches:
        for *at, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        done.append((*key, state.hexdigest()))
    if done:
        d, a, b, s = zip(*done)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                          pa.array(s, pa.string())], names=["depth", "a", "b", "ends_sha256"])


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie.

    ``turns`` has conv_id, depth (from 1, without gaps), said (a hash of what the turn says), bytes
    and length (turns of the conversation); ``members`` has conv_id, each once, those without turns
    included. Returns conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved (the subtree's sum of bytes x (n_convs - 1)) and ends_sha256, the digest of the members
    that end here. No members: no nodes, not even the root.
    """
    ship_package(turns.sparkSession)
    rows = written(prefix_digests(turns), "trie-rows")
    total, last = rows.agg(F.count(F.lit(1)), F.max("depth")).first()
    least, everyone = members.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    nodes = written(rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("deepest"),
        F.min("bytes").alias("bytes"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "trie-nodes")
    sums = shard_sums(rows, nodes, max(1, -(-total // SHARD_ROWS)))
    long = lambda x: F.lit(x).cast("long")
    root = members.sparkSession.range(1 if everyone else 0).select(
        long(0).alias("depth"), long(0).alias("a"), long(0).alias("b"), long(least).alias("conv_id"),
        long(everyone).alias("n_convs"), long(None).alias("parent_conv_id"),
        long(0 if total else 1).alias("n_leaves"), long(0).alias("saved"), long(0).alias("n_children"))
    shared = nodes.groupBy("owner").agg((F.min("depth") - 1).alias("shared"))
    placed = nodes.join(shared, "owner")
    inner = F.when(F.col("shared") == 0, long(least))
    known = placed.select(*KEY, F.col("owner").alias("conv_id"), "n_convs",
                          F.when(F.col("depth") - 1 > F.col("shared"), F.col("owner")).otherwise(inner).alias("parent_conv_id"),
                          long(0).alias("n_leaves"), long(0).alias("saved"), long(0).alias("n_children"))
    branches = placed.filter("shared > 0 AND depth = shared + 1").select(*KEY, "up_a", "up_b")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                         F.col("owner").alias("parent_conv_id"))
    branches = branches.join(above, ["depth", "up_a", "up_b"]).select(*KEY, "parent_conv_id")
    ends = rows.filter("depth = length").select(*KEY, "conv_id").unionByName(
        members.join(rows.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
        .select(long(0).alias("depth"), long(0).alias("a"), long(0).alias("b"), "conv_id"))
    parts = (known.unionByName(root).unionByName(sums, allowMissingColumns=True)
             .unionByName(branches, allowMissingColumns=True).unionByName(member_lists(ends), allowMissingColumns=True))
    # A row of the union sets what it knows of a node.
    return parts.groupBy(*KEY).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: A conversation takes its first turns from the conversation at the multiple of five below it.
FAMILY = 5
MOST_SHARED = 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) with the first turns of each conversation taken from the head of its family.

    Turns are ordered by ``turn``, null first, then by a hash of role and text. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))).alias("said"),
        F.octet_length(text("text")).cast("long").alias("bytes"))
    rows = written(ranked(rows, ["conv_id"], ["turn", "said"], "at", "turns", "trie-ranked"), "trie-ordered")
    convs = rows.filter("at = 0").select("conv_id", "turns")
    wants = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("wants")
    heads = convs.select(F.col("conv_id").alias("head"), F.col("turns").alias("head_turns"))
    plan = (convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"), wants)
            .join(heads, "head", "left")
            .withColumn("taken", F.least("wants", F.coalesce("head_turns", F.lit(0))))
            .select("conv_id", "head", "wants", "taken",
                    (F.col("taken") + F.greatest(F.col("turns") - F.col("wants"), F.lit(0))).alias("length")))
    plan = written(plan, "trie-plan")
    first = rows.filter(F.col("at") < MOST_SHARED - 1).select(F.col("conv_id").alias("head"), "at", "said", "bytes")
    shared = plan.join(first, "head").filter("at < taken").select(
        "conv_id", (F.col("at") + 1).alias("depth"), "said", "bytes", "length")
    own = rows.select("conv_id", "at", "said", "bytes").join(plan, "conv_id").filter("at >= wants").select(
        "conv_id", (F.col("at") - F.col("wants") + F.col("taken") + 1).alias("depth"), "said", "bytes", "length")
    return shared.unionByName(own), plan.select("conv_id")


ORACLE_SQL = """
WITH rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS at
  FROM conversations WHERE conv_id IS NOT NULL),
remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
plan AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, n,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM rows GROUP BY conv_id), remainders),
taken AS (
  SELECT p.conv_id, p.head, p.h, least(p.h, coalesce(b.n, 0)) AS k FROM plan p LEFT JOIN plan b ON b.conv_id = p.head),
turns AS (
  SELECT t.conv_id, r.at + 1 AS depth, r.role, r.text FROM taken t JOIN rows r ON r.conv_id = t.head AND r.at < t.h
  UNION ALL
  SELECT t.conv_id, r.at - t.h + t.k + 1, r.role, r.text FROM taken t JOIN rows r ON r.conv_id = t.conv_id AND r.at >= t.h),
prefixes AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS d,
         count(*) OVER (PARTITION BY conv_id) AS length
  FROM turns
  UNION ALL
  SELECT p.conv_id, 0, 0, '', coalesce(t.length, 0)
  FROM plan p LEFT JOIN (SELECT conv_id, count(*) AS length FROM turns GROUP BY conv_id) t USING (conv_id)),
nodes AS (
  SELECT depth, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) = depth AS leaf, min(bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN length = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, d),
chains AS (
  SELECT n.depth, n.d, p.depth AS up_depth, p.d AS up_d, CAST(n.leaf AS INTEGER) AS leaf, (n.n_convs - 1) * n.bytes AS saved
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(s.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n
JOIN (SELECT up_depth, up_d, sum(leaf) AS n_leaves, sum(saved) AS saved, count(*) FILTER (WHERE depth = up_depth + 1) AS n_children
      FROM chains GROUP BY up_depth, up_d) s ON s.up_depth = n.depth AND s.up_d = n.d
LEFT JOIN prefixes q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1
LEFT JOIN nodes u ON u.depth = q.depth AND u.d = q.d
"""


def query(spark, sf_dir: str) -> DataFrame:
    turns, members = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(turns, members).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        "ends_sha256")
