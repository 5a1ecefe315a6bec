"""Merkle manifest of a dataset, with membership proofs from nested-interval labels.

A node of the tree of a source carries its level and the interval [lo, hi) of leaf ranks that it
covers. The ancestors of a node are those whose interval contains its own; as the intervals of
level ``l`` start at multiples of ``3 ** l``, containment is an equality of buckets
``lo div 3 ** l``, and what a parent's interval has beyond its child's are the child's siblings.

Levels are handled in bands: rows are dealt by (source, bucket of the band's top level), at most
``3 ** BAND`` of them each, so that neither a large source nor the whole tree meets in one task.
Going up, a band gives the nodes that its rows make; going down, each row gets its siblings within
the band and the proof of the band's top node. The roots of the sources are the leaves of one more
tree, built the same way, whose root stands for the dataset.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.ranking import ranked
from trialweave.session import ship_package, written

FAN = 3
#: Levels of a band: at most ``FAN ** BAND`` = 2,187 rows meet in one group.
BAND = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:string,after:string>>"
NODE = "owner string, level int, lo long, hi long, n long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def entry(value: Column) -> Column:
    """A field as a leaf hashes it: its bytes' count, a colon, its value; a null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(entry, fields)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda up, at: F.sha2(F.concat(at["before"], up, at["after"]), 256))


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda at: F.concat(at["before"], at["after"])), ""), 256)


def parents(level: int, nodes: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """Nodes (lo, hi, digest) of the level above, in order."""
    width = FAN ** (level + 1)
    return [(lo := nodes[i][0], min(lo + width, n), digest("".join(d for _, _, d in nodes[i:i + FAN])))
            for i in range(0, len(nodes), FAN)]


def band_levels(first: int, nodes: list[tuple[int, int, str]], n: int, band: int) -> list[list[tuple[int, int, str]]]:
    """The levels of a band from its rows up, until its top or the root."""
    levels = [nodes]
    while len(levels) <= band and levels[-1][0][1] - levels[-1][0][0] < n:
        levels.append(parents(first + len(levels) - 1, levels[-1], n))
    return levels


def rows_of(table: pa.Table) -> list[tuple[int, int, str]]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "digest"))))


def climb(first: int, band: int):
    """Nodes that a band makes of its rows; a tree of one leaf has that leaf as its root."""
    def run(table: pa.Table) -> pa.Table:
        n, owner = table.column("n")[0].as_py(), table.column("owner")[0].as_py()
        levels = band_levels(first, rows_of(table), n, band)
        made = [(first + i, *node) for i, nodes in enumerate(levels) for node in nodes if i or n == 1]
        level, lo, hi, digests = zip(*made)
        return pa.table({
            "owner": pa.array([owner] * len(made), pa.string()), "level": pa.array(level, pa.int32()),
            "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()),
            "n": pa.array([n] * len(made), pa.int64()), "digest": pa.array(digests, pa.string())})
    return run


def descend(first: int, band: int):
    """Rows of a band with their proofs: siblings within the band, then the proof of its top node."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.column("n")[0].as_py()
        left = left.sort_by("lo")
        levels = band_levels(first, rows_of(left), n, band)
        upper = [(p["before"], p["after"]) for p in right.column("proof")[0].as_py()]
        proofs = [upper]
        for i in range(len(levels) - 1, 0, -1):
            below, start, width = levels[i - 1], levels[0][0][0], FAN ** (first + i - 1)
            made = []
            for (lo, hi, _), up in zip(levels[i], proofs):
                for a, b, _ in below[(lo - start) // width:-(-(hi - start) // width)]:
                    # The parent's interval without the child's: [lo, a) and [b, hi).
                    before = "".join(d for _, _, d in below[(lo - start) // width:(a - start) // width])
                    after = "".join(d for _, _, d in below[-(-(b - start) // width):-(-(hi - start) // width)])
                    made.append([(before, after), *up])
            proofs = made
        flat = [step for proof in proofs for step in proof]
        offsets = [0]
        for proof in proofs:
            offsets.append(offsets[-1] + len(proof))
        steps = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()),
                                            pa.array([s[1] for s in flat], pa.string())], names=["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
        top = pa.array([right.column("top")[0].as_py()] * left.num_rows, pa.string())
        return left.append_column("proof", proof).append_column("top", top)
    return run


def bucket(level: int) -> Column:
    return F.expr(f"lo div {FAN ** level}L")


class IntervalTree:
    """The trees over ranked leaves of many owners; ``leaves``: owner, lo, n, digest and any others."""

    def __init__(self, leaves: DataFrame, name: str, band: int = BAND) -> None:
        ship_package(leaves.sparkSession)
        self.name, self.band = name, band
        self.leaves = written(leaves.withColumn("hi", F.col("lo") + 1), f"{name}-leaves")
        most = self.leaves.agg(F.max("n")).first()[0] or 0
        self.bands = []
        rows, first = self.leaves, 0
        while True:
            made = written(rows.select("owner", "lo", "hi", "n", "digest").groupBy("owner", bucket(first + band))
                           .applyInArrow(climb(first, band), NODE), f"{name}-nodes")
            self.bands.append((first, rows, made))
            first += band
            if FAN ** first >= most:
                break
            rows = made.filter((F.col("level") == first) & (F.col("hi") - F.col("lo") < F.col("n")))

    def nodes(self) -> DataFrame:
        """All nodes above the leaves: owner, level, lo, hi, digest (a lone leaf counts as a root)."""
        out = self.bands[0][2]
        for _, _, made in self.bands[1:]:
            out = out.unionByName(made)
        return out

    def roots(self) -> DataFrame:
        """(owner, digest) of the node that covers all leaves of its owner."""
        return self.nodes().filter("lo = 0 AND hi = n").select("owner", "digest")

    def proofs(self, tops: DataFrame | None = None) -> DataFrame:
        """The leaves with ``proof`` and ``top``; ``tops`` (owner, proof, top) continues their roots' proofs."""
        above = None
        for first, rows, made in reversed(self.bands):
            roots = made.filter("lo = 0 AND hi = n").select("owner", "lo", "digest")
            if tops is None:
                ends = roots.select("owner", "lo", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("top"))
            else:
                ends = roots.join(tops, "owner").select("owner", "lo", "proof", "top")
            if above is not None:
                ends = ends.unionByName(above.select("owner", "lo", "proof", "top"))
            at = bucket(first + self.band)
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
            above = (rows.withColumn("at", at).groupBy("owner", "at")
                     .cogroup(ends.withColumn("at", at).groupBy("owner", "at"))
                     .applyInArrow(_without_bucket(descend(first, self.band)), f"{schema}, proof {PROOF}, top string"))
            if first:
                above = written(above, f"{self.name}-proofs")
        return above


def _without_bucket(run):
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            raise ValueError("a band without its top node")
        return run(left.drop_columns(["at"]), right)
    return apply


def manifest(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS,
             id_col: str = "doc_id", source_col: str = "source", band: int = BAND) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes of the sources, nodes of the dataset).

    A leaf row has ``id``, ``source``, ``leaf``, ``altered`` (the digest of the leaf with
    ``altered`` in place of the last field, or ``leaf`` where it is null), ``lo`` (its rank in the
    source), ``subroot``, ``root`` and ``proof``: per level up to the root, the digests before and
    after, both empty where a run has one node only.

    Nulls in fields are hashed as such; null sources are one source that comes first, null ids
    come first in theirs. Rows that share an id are ordered by their digest; equal rows are leaves
    of their own. An empty table gives no leaves and no nodes. Other columns are not read.
    """
    values = [F.col(f"`{c}`") for c in fields]
    leaf = leaf_digest(values)
    other = leaf if altered is None else F.when(
        altered.isNotNull(), leaf_digest([*values[:-1], altered])).otherwise(leaf)
    # Null sources sort before all others, and no source has their key.
    owner = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), owner.alias("owner"),
                       leaf.alias("digest"), other.alias("altered"))
    trees = IntervalTree(ranked(rows, ["owner"], ["id", "digest"], "lo", "n", "merkle-ranked"), "merkle", band)
    subroots = written(trees.roots(), "merkle-subroots")
    sources = ranked(subroots.select(F.lit("all").alias("owner"), F.col("owner").alias("source"), "digest"),
                     ["owner"], ["source"], "lo", "n", "merkle-sources")
    whole = IntervalTree(sources, "merkle-whole", band)
    tops = whole.proofs().select(F.col("source").alias("owner"), "proof", F.col("digest").alias("top"))
    root = whole.roots().first()
    leaves = trees.proofs(written(tops, "merkle-tops")).select(
        "id", "source", F.col("digest").alias("leaf"), "altered", "lo", F.col("top").alias("subroot"),
        F.lit(root and root["digest"]).cast("string").alias("root"), "proof")
    return leaves, trees.nodes(), whole.nodes()


ORACLE_SQL = """
WITH RECURSIVE remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
parted AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front,
         replace(text, chr(10), '') AS cut,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS crc
  FROM documents, remainders),
leaves AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS owner,
         sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(front || coalesce(CASE WHEN crc % 2 = 0 THEN strlen(cut) || ':' || cut ELSE strlen(text) || ':' || text END, '-')) AS altered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY source) AS n
  FROM parted),
up AS (
  SELECT owner, 0 AS level, r AS place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT owner, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY owner, level, place // 3, n),
subroots AS (SELECT owner, digest, row_number() OVER (ORDER BY owner) - 1 AS r, count(*) OVER () AS n FROM up WHERE n = 1),
over_all AS (
  SELECT 0 AS level, r AS place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM over_all WHERE n > 1 GROUP BY level, place // 3, n),
beside AS (
  SELECT owner, level, place, coalesce(string_agg(digest, '') OVER (PARTITION BY owner, level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') OVER (PARTITION BY owner, level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT * FROM up UNION ALL SELECT '*', * FROM over_all) WHERE n > 1),
walk AS (
  SELECT doc_id, owner, 0 AS level, r AS place, altered AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.owner, w.level + 1, w.place // 3, sha256(before || folded || after), proof || before || after
  FROM walk w JOIN beside b ON b.owner = w.owner AND b.level = w.level AND b.place = w.place),
ends AS (SELECT doc_id, owner, max_by(folded, level) AS folded, max_by(proof, level) AS proof FROM walk GROUP BY doc_id, owner),
climbed AS (
  SELECT e.doc_id, 0 AS level, s.r AS place, e.folded, e.proof FROM ends e JOIN subroots s USING (owner)
  UNION ALL
  SELECT w.doc_id, w.level + 1, w.place // 3, sha256(before || folded || after), proof || before || after
  FROM climbed w JOIN beside b ON b.owner = '*' AND b.level = w.level AND b.place = w.place),
folded AS (SELECT doc_id, max_by(folded, level) AS folded_root, max_by(proof, level) AS proof FROM climbed GROUP BY doc_id),
root AS (SELECT digest AS root FROM over_all WHERE n = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s USING (owner) JOIN folded f ON f.doc_id = l.doc_id, root
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                      F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    leaves, _, _ = manifest(docs, tampered)
    folded = fold(F.col("altered"), F.col("proof"))
    return (leaves.withColumn("folded_root", folded)
            .select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))
