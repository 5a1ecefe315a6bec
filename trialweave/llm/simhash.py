"""SimHash near-duplicates: a self-join of the binary trie of fingerprints.

Two fingerprints at most ``bits`` apart agree on ``blocks - bits`` of ``blocks`` pieces of the 64
bits. Every choice of that many pieces is one table, keyed by the bits of those pieces, so close
fingerprints meet under a key of some table. Under a key, the trie of the fingerprints is
traversed as pairs of nodes that start at the root: each step goes down one bit on both sides,
adds up differing bits, and drops a pair once they exceed the budget. Pairs of few leaves are
compared directly. Texts with equal fingerprints are one leaf, and a task passes on links that
span what it has joined, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.llm.common import WORD, fresh, releasing, text_of
from trialweave.llm.components import components
from trialweave.session import ship_package, written

SEED = 42
#: Distinct fingerprints under one key above which the key is split further.
MOST = 1 << 15
#: Node pairs with at most so many pairs of leaves are compared directly.
LEAVES = 64


def simhash(text: str | None, words: int = 4, distinct: bool = False) -> int:
    """The signed 64-bit fingerprint of one text."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    width = min(words, len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])
    shingles = [joined[a:b] for a, b in zip(starts[:len(tokens) - width + 1].tolist(),
                                            ends[width - 1:].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    if distinct:
        hashes = np.unique(hashes)
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, name: str, words: int = 4, distinct: bool = False,
                     text_col: str = "text") -> DataFrame:
    """``docs`` without the text column, with the fingerprint as a long."""
    ship_package(docs.sparkSession)
    (plain,) = fresh(docs, "plain_text")
    kept = docs.withColumn(plain, text_of(text_col)).drop(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(plain)
            rest = [i for i in range(batch.num_columns) if i != at]
            prints = pa.array([simhash(t.as_py(), words, distinct) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), prints],
                names=[*(batch.schema.names[i] for i in rest), name])

    return kept.mapInArrow(releasing(run), f"{schema}, `{name}` bigint")


def _pieces(width: int, blocks: int, low: int = 0) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each piece of ``width`` bits."""
    edges = [low + width * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _key(value: Column, chosen: tuple[tuple[int, int], ...], table: int) -> Column:
    key = F.lit(table).cast("long")
    for low, bits in chosen:
        key = F.shiftleft(key, bits).bitwiseOR(
            F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1)))
    return key


def _parts(chosen: tuple[tuple[int, int], ...], bits: int) -> list[tuple[tuple[int, int], ...]]:
    """The bits outside of ``chosen`` in ``bits + 2`` parts."""
    rest = [p for p in range(64) if not any(low <= p < low + n for low, n in chosen)]
    return [tuple((b, 1) for b in rest[len(rest) * i // (bits + 2):len(rest) * (i + 1) // (bits + 2)])
            for i in range(bits + 2)]


def _first_key(x: np.ndarray, y: np.ndarray, pieces: list[tuple[tuple[int, int], ...]], n: int,
               low: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(number, key) of the first choice of ``n`` pieces on which x and y agree, as ``_key`` makes it; ``low``: first number."""
    masks = np.array([sum(((1 << w) - 1) << at for at, w in p) for p in pieces], np.uint64)
    agree = ((x ^ y)[:, None] & masks) == 0
    agree &= np.cumsum(agree, 1) <= n
    number = np.zeros(1 << len(pieces), np.int64)
    for k, choice in enumerate(combinations(range(len(pieces)), n)):
        number[sum(1 << i for i in choice)] = k + low
    number = number[agree @ (1 << np.arange(len(pieces)))]
    key = number.copy()
    for i, p in enumerate(pieces):
        for at, w in p:
            bits_ = (x >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64)
            key = np.where(agree[:, i], key << w | bits_, key)
    return number, key


def first_met(x: np.ndarray, y: np.ndarray, key: np.ndarray, sub: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """Whether (key, sub) is the first place of ``tables`` where x and y, at most ``bits`` apart, meet."""
    pieces = _pieces(64, blocks)
    table, own = _first_key(x, y, [(p,) for p in pieces], blocks - bits)
    first = own == key
    chosen = list(combinations(pieces, blocks - bits))
    split = first & (sub != 0)
    for t in np.unique(table[split]).tolist():
        at = np.flatnonzero(split & (table == t))
        first[at] = _first_key(x[at], y[at], _parts(chosen[t], bits), 2, 1)[1] == sub[at]
    return first


def tables(prints: DataFrame, bits: int, blocks: int, most: int = MOST) -> DataFrame:
    """(key, sub, fp) for every table; a key that more than ``most`` fingerprints share is split.

    Other columns of ``prints`` stay. Under such a key, the other bits are cut into ``bits + 2`` pieces, of which two close
    fingerprints agree on two at least, and every choice of two is a table below the key.
    """
    chosen = list(combinations(_pieces(64, blocks), blocks - bits))
    kept = prints.columns
    keyed = prints.select(*kept, F.posexplode(F.array(*[
        _key(F.col("fp"), c, i) for i, c in enumerate(chosen)])).alias("t", "key"))
    hot = written(keyed.groupBy("t", "key").count().filter(F.col("count") > most).select("t", "key"),
                  "simhash-hot")
    out = keyed.join(hot, ["t", "key"], "left_anti").select("key", F.lit(0).cast("long").alias("sub"), *kept)
    for (t,) in hot.select("t").distinct().collect():  # tables that have such keys
        finer = F.array(*[_key(F.col("fp"), x + y, j + 1)
                          for j, (x, y) in enumerate(combinations(_parts(chosen[t], bits), 2))])
        out = out.unionByName(keyed.join(hot.filter(F.col("t") == t), ["t", "key"]).select(
            "key", F.explode(finer).alias("sub"), *kept))
    return out


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def trie_links(prints: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of links at most ``bits`` apart within a group.

    ``prints`` are uint64, sorted within each group, distinct within it; groups lie together.
    """
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
    ends = np.append(starts[1:], len(group))
    many = ends - starts > 1
    a, b = starts[many], ends[many]
    # Node pairs: [alo, ahi) against [blo, bhi), differing bits so far. A node with itself comes once.
    pairs = np.stack([a, b, a, b, np.zeros(len(a), np.int64)])
    left, right = [], []

    def compare(p: np.ndarray) -> None:
        wide = p[3] - p[2]
        n = (p[1] - p[0]) * wide
        which = np.repeat(np.arange(p.shape[1]), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = p[0][which] + k // wide[which], p[2][which] + k % wide[which]
        near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= bits)
        left.append(i[near])
        right.append(j[near])

    for level in range(63, -1, -1):
        small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAVES
        compare(pairs[:, small])
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            break
        ones = np.concatenate([[0], np.cumsum(prints >> np.uint64(level) & np.uint64(1)).astype(np.int64)])
        alo, ahi, blo, bhi, diff = pairs
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        cross = alo != blo
        pairs = np.concatenate([
            np.stack([alo, amid, blo, bmid, diff]), np.stack([amid, ahi, bmid, bhi, diff]),
            np.stack([alo, amid, bmid, bhi, diff + 1]),
            np.stack([amid, ahi, blo, bmid, diff + 1])[:, cross]], axis=1)
        pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= bits)]
    compare(pairs)
    return np.concatenate(left), np.concatenate(right)


def _by_key(prints: DataFrame, bits: int, blocks: int, most: int, edges) -> DataFrame:
    """(a, b) from ``edges(values, i, j, rows)`` of the links (i, j) between what shares a key."""
    ship_package(prints.sparkSession)

    def joined(rows: pa.Table) -> pa.RecordBatch:
        key, sub, fp = (rows.column(c).to_numpy() for c in ("key", "sub", "fp"))
        group = np.cumsum((np.diff(key, prepend=0) != 0) | (np.diff(sub, prepend=0) != 0))
        order = np.lexsort((fp.view(np.uint64), group))
        group, value = group[order], fp.view(np.uint64)[order]
        i, j = trie_links(value, group, bits)
        a, b = edges(value, i, j, rows, order)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < MOST:
                continue
            whole = pa.Table.from_batches(held)
            key, sub = whole.column("key").to_numpy(), whole.column("sub").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield joined(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            rows = whole.num_rows - cut
        if rows:
            yield joined(pa.Table.from_batches(held))

    dealt = tables(prints, bits, blocks, most).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(releasing(run), "a bigint, b bigint")


def links(prints: DataFrame, bits: int = 4, blocks: int = 6, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    def spanning(value, i, j, rows, order):
        names, node = np.unique(value[np.concatenate([i, j])], return_inverse=True)
        root = roots_of(len(names), node[:len(i)], node[len(i):])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return names[moved], names[root[moved]]

    return _by_key(prints.select("fp"), bits, blocks, most, spanning)


def open_pairs(prints: DataFrame, bits: int, blocks: int, most: int = MOST) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints at most ``bits`` apart of which one is ``open``, once each.

    A pair shares keys of many tables; only the first of them passes it on.
    """
    def either(value, i, j, rows, order):
        flag, key, sub = (rows.column(c).to_numpy()[order] for c in ("open", "key", "sub"))
        ok = flag[i] | flag[j]
        i, j = i[ok], j[ok]
        once = first_met(value[i], value[j], key[i], sub[i], bits, blocks)
        return value[i[once]], value[j[once]]

    return _by_key(prints.select("fp", "open"), bits, blocks, most, either)


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, blocks: int = 6,
                    distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    The component is the smallest id that can be reached over fingerprints at most ``bits`` apart.
    Null and empty texts have fingerprint zero and link like any other; repeated rows each give a
    row; a null id never names a component unless all of it is null; other columns are not read.
    ``distinct`` counts each shingle of a text once. ``blocks`` sets the number of tables, and with
    more blocks their keys get longer: 6 suits up to some ten million distinct fingerprints,
    8 a thousand times as many.
    """
    own = written(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                                   "fp", words, distinct), "simhash-prints")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = components(links(own.select("fp").distinct(), bits, blocks))
    joined = root.join(first, root["node"] == first["fp"])
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    linked = joined.join(least, "root").select("fp", "least")
    classes = first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return own.join(classes, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def shingle_hashes(text: Column, words: int) -> Column:
    """Hashes of the distinct shingles of ASCII-lower-cased words; a short text is one shingle."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.transform(F.array(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(w, i, words))))
    return F.array_distinct(F.flatten(tokens))


def deduplicated(docs: DataFrame, words: int = 5, bits: int = 8, blocks: int = 10,
                 similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near-copies of a document that stays.

    Equal texts are one, that of their smallest id. Two texts whose fingerprints are linked and whose
    exact Jaccard similarity over distinct shingles is ``similarity`` or more are alike, and of each
    component of alike texts only the document of the smallest id stays. Null texts count as empty
    and null ids come last. All columns stay as they are.

    Each text is first compared with the smallest of its group of linked fingerprints; what is alike
    there is joined already, so only the others are compared with all that is within ``bits`` of them.
    """
    k, h, n = fresh(docs, "k", "h", "n")
    keyed = (docs.withColumn(k, F.coalesce(F.col(id_col), F.lit((1 << 63) - 1)))
             .withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    texts = keyed.select(F.col(k).alias("k"), F.col(h).alias("h"), text_of(text_col).alias("text"))
    own = written(with_fingerprint(texts, "fp", words, distinct=True), "simhash-prints").distinct()
    each = written(own.groupBy("h", "fp").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("ids")), "simhash-texts")
    first = each.groupBy("fp").agg(F.min(F.struct("k", "h")).alias("first"))
    root = components(links(first.select("fp"), bits, blocks))
    joined = root.join(first, root["node"] == first["fp"])
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    linked = joined.join(least, "root").select("fp", "root", "least")
    groups = first.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("head"))
    others = written(each.join(groups, "fp").filter(F.col("h") != F.col("head.h")).select(
        "h", "fp", "root", F.col("head.k").alias("sk"), F.col("head.h").alias("sh")), "simhash-members")

    smallest = each.select("k", "h")
    wanted = others.select("h").unionByName(others.select(F.col("sh").alias("h"))).distinct()
    shingles = written(
        texts.join(smallest.join(wanted, "h"), ["k", "h"]).dropDuplicates(["k", "h"])
        .select("h", shingle_hashes(F.col("text"), words).alias("s")), "simhash-shingles")
    of = lambda a, s: shingles.select(F.col("h").alias(a), F.col("s").alias(s))
    both = F.size(F.array_intersect("s", "t"))
    alike = both >= similarity * (F.size("s") + F.size("t") - both)
    judged = written(others.join(of("h", "s"), "h").join(of("sh", "t"), "sh").select(
        "h", "fp", "root", "sh", F.size("s").alias("size"), alike.alias("near")), "simhash-judged")
    failed = judged.filter("not near").select("root").distinct()
    rest = judged.join(failed, "root", "left_semi").select("h", "fp", "size", "near")
    open_ = written(rest.groupBy("fp").agg(F.max(~F.col("near")).alias("open")), "simhash-open")
    pairs = open_pairs(open_, bits, blocks).unionByName(
        open_.filter("open").select(F.col("fp").alias("a"), F.col("fp").alias("b")))
    side = lambda c: rest.select(*[F.col(x).alias(f"{x}_{c}") for x in rest.columns])
    more = (pairs.join(side("a"), F.col("a") == F.col("fp_a")).join(side("b"), F.col("b") == F.col("fp_b"))
            .filter("not (near_a and near_b) and (a <> b or h_a < h_b)")
            # Sets whose sizes differ by more cannot be that similar.
            .filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
            .select("h_a", "h_b").distinct().join(of("h_a", "s"), "h_a").join(of("h_b", "t"), "h_b")
            .filter(alike).select(F.col("h_a").alias("a"), F.col("h_b").alias("b")))
    found = components(judged.filter("near").select(F.col("h").alias("a"), F.col("sh").alias("b")).unionByName(more))
    placed = written(found.join(smallest, F.col("node") == F.col("h")).select("root", "k", "h"), "simhash-placed")
    stays = placed.groupBy("root").agg(F.min(F.struct("k", "h")).alias("stays"))
    dead = placed.join(stays, "root").filter(F.col("h") != F.col("stays.h")).select("h")
    copies = own.join(each.filter("ids > 1").select("h", F.col("k").alias("least")), "h").filter("k <> least")
    gone = (own.join(dead, "h", "left_semi").select("k", "h").unionByName(copies.select("k", "h")).distinct()
            .select(F.col("k").alias(k), F.col("h").alias(h)))
    numbered = keyed.withColumn(n, F.row_number().over(W.partitionBy(k, h).orderBy(F.lit(0))))
    return numbered.filter(F.col(n) == 1).join(gone, [k, h], "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
