"""Removal of long repeated byte strings by suffix arrays per shard.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier: in a document of a
smaller id, or earlier in the same one. Sorting the suffixes of everything is not needed for that.

1. Anchors. Among the ``GRAM``-byte grams inside each string of ``LENGTH`` bytes, those of the
   smallest hash are anchors, so equal strings share an anchor's hash. Batches of documents send
   their distinct hashes, dealt by hash, and learn which occur more than once at all.
2. Contexts. Around each repeated anchor, the bytes of all strings that hold it go to the shard of
   its hash; equal contexts of a batch go once. All equal strings meet in a shard.
3. Shards. Equal contexts are copies of the first. Where contexts of an anchor differ, the suffix
   array and common prefixes of the shard's contexts give the groups of equal strings.
4. Merging. An anchor of very many contexts is dealt to several shards. Those also pass on their
   strings, as sorted runs of digests, and each run is looked up in the others' by binary search.
5. The ranges found go back to the documents.

Documents are dealt to batches once; the three steps that read them use the same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from trialweave.llm.common import fresh, releasing_groups, text_of, without
from trialweave.llm.suffix_arrays import common_prefixes, suffix_array
from trialweave.session import ship_package

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in a batch, of hashes in a bucket and of text behind a shard.
BATCH, BUCKET, SHARD = 2 << 20, 16 << 20, 2 << 20
#: Contexts of one anchor that a shard takes before the anchor is dealt to several.
SPREAD = 4096
#: Bytes hashed at a time, so that the arrays stay in the processor's cache.
PIECE = 1 << 17
SEPARATOR = 255  # in no UTF-8 text

_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(0, 1 << 64, (2, 256), np.uint64)
_STEPS = _rng.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, length: int, table: int = 0) -> np.ndarray:
    """A hash of the ``length`` bytes from each position, by doubling; shorter ends are left out."""
    level, size, total, done = _TABLES[table][data], 1, None, 0
    for step in _STEPS:
        if length & size:
            total = level if total is None else (
                total[:len(level) - done] * step + level[done:] if done else level)
            total = total[:len(data) - done - size + 1]
            done += size
        if done == length:
            break
        level = level[:-size] * step + level[size:] if len(level) > size else level[:0]
        size *= 2
    return total ^ total >> np.uint64(29)


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of ``width`` values from each position on; ``len - width + 1`` results."""
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the anchors of the documents [start, end) that lie together in ``data``.

    Every string of LENGTH bytes of a document holds an anchor of its smallest hash. Where one
    hash comes again and again, the first and last in each half window are enough for that.
    """
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = gram_hashes(data, GRAM)
    low = _sliding(grams, WINDOW, np.minimum)
    valid = np.zeros(len(low) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, np.minimum(ends[long] - LENGTH + 1, len(low)), -1)
    low = np.where(np.cumsum(valid[:-1]) > 0, low, 0)
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), WINDOW, np.maximum) == grams)
    value, cell = grams[at], at // (WINDOW // 2)
    order = np.lexsort((at, value, cell))
    v, c = value[order], cell[order]
    first = np.ones(len(at), bool)
    first[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    kept = order[first | np.append(first[1:], True)]
    return value[kept], at[kept]


class Documents:
    """The documents of a batch in the order of (id, tie), their bytes and anchors."""

    def __init__(self, table: pa.Table, id_col: str, plain: str) -> None:
        ids = table.column(id_col).to_pylist()
        self.texts = [x.encode("utf-8", "surrogatepass") for x in table.column(plain).to_pylist()]
        self.doc = np.empty(len(ids), np.int64)
        self.tie = np.zeros(len(ids), np.int64)
        count: dict = {}
        for i in sorted(range(len(ids)), key=lambda i: self.texts[i]):
            # Rows of one id are documents in the order of their texts; null ids come last.
            name = ids[i]
            key = name if name is not None else self.texts[i]
            self.doc[i] = name if name is not None else np.iinfo(np.int64).max
            base = 0 if name is not None else 1 + (_digest(self.texts[i]) >> 2)
            self.tie[i] = base + count.get(key, 0)
            count[key] = count.get(key, 0) + 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, position), each once."""
        parts = []
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def finish() -> None:
            data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
            ends = np.cumsum([len(x[2]) for x in held])
            starts = ends - [len(x[2]) for x in held]
            value, at = anchors(data, starts, ends)
            which = np.searchsorted(ends, at, "right")
            rows = np.array([x[0] for x in held])[which]
            begin = np.array([x[1] for x in held])[which]
            parts.append((value, rows, at - starts[which] + begin))

        for i, text in enumerate(self.texts):
            if len(text) < LENGTH:
                continue
            for begin in range(0, len(text) - LENGTH + 1, PIECE):
                part = text[begin:begin + PIECE + LENGTH - 1]
                if held and size + len(part) > PIECE:
                    finish()
                    held, size = [], 0
                held.append((i, begin, part))
                size += len(part)
        if held:
            finish()
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        value, row, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
        return value[order][once], row[once], at[once]


def _digest(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


HASHES = "bucket int, batch int, hashes binary, counts binary"


def _hashes(id_col: str, plain: str, batch_col: str, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        value, _, _ = Documents(table, id_col, plain).anchors()
        value, count = np.unique(value, return_counts=True)
        bucket = (value % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        value, count, bucket = value[order], count[order].astype(np.uint32), bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cut[1:], len(value)]
        return pa.table({
            "bucket": pa.array(bucket[cut], pa.int32()),
            "batch": pa.array([table.column(batch_col)[0].as_py()] * len(cut), pa.int32()),
            "hashes": pa.array([value[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            "counts": pa.array([count[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        })

    return run


REPEATED = "batch int, hashes binary, spread binary"


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _repeated(most: int):
    """For each batch, its hashes that occur more than once anywhere, and over how many shards."""

    def run(table: pa.Table) -> pa.Table:
        return _repeated_hashes(table, most)

    return run


def _repeated_hashes(table: pa.Table, most: int) -> pa.Table:
    value, count = _joined(table, "hashes", np.uint64), _joined(table, "counts", np.uint32)
    sizes = [len(x) // 8 for x in table.column("hashes").to_pylist()]
    names, which = np.unique(value, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, which, count)
    spread = np.minimum(-(-total // most), 1 << 31).astype(np.uint32)[which]
    again = total[which] > 1
    ends = np.cumsum(sizes)
    parts = [(a, b) for a, b in zip(ends - sizes, ends)]
    return pa.table({
        "batch": table.column("batch").combine_chunks(),
        "hashes": pa.array([value[a:b][again[a:b]].tobytes() for a, b in parts], pa.binary()),
        "spread": pa.array([spread[a:b][again[a:b]].tobytes() for a, b in parts], pa.binary()),
    })


CONTEXTS = ("shard int, hot bigint, sub int, batch int, hash bigint, spread int, context binary, "
            "docs binary, ties binary, starts binary")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _contexts(id_col: str, plain: str, shards: int):
    schema = _schema(CONTEXTS)

    def run(documents: pa.Table, flags: pa.Table) -> pa.Table:
        if not documents.num_rows or not flags.num_rows:
            return schema.empty_table()
        known, spread = _joined(flags, "hashes", np.uint64), _joined(flags, "spread", np.uint32)
        if not len(known):
            return schema.empty_table()
        order = np.argsort(known)
        known, spread = known[order], spread[order]
        docs = Documents(documents, id_col, plain)
        value, row, at = docs.anchors()
        place = np.minimum(np.searchsorted(known, value), len(known) - 1)
        hit = known[place] == value
        value, row, at, wide = value[hit], row[hit], at[hit], spread[place[hit]]
        batch = flags.column("batch")[0].as_py()
        begin = np.maximum(at - (WINDOW - 1), 0)
        groups: dict[tuple[int, bytes], list[int]] = {}
        for i, (v, r, a, b) in enumerate(zip(value.tolist(), row.tolist(), begin.tolist(),
                                             (at + LENGTH).tolist())):
            own = groups.setdefault((v, docs.texts[r][a:b]), [])
            # At the ends of a text, two anchors can have the very same bytes around them.
            if not own or (row[own[-1]], begin[own[-1]]) != (r, a):
                own.append(i)
        columns: dict[str, list] = {n: [] for n in schema.names}
        for (v, text), members in groups.items():
            n = int(wide[members[0]])
            rows = row[members]
            for name, x in zip(schema.names, (
                    v % shards, v % (1 << 63) if n > 1 else -1, (batch * 40503) % n, batch,
                    v - (1 << 64) if v >> 63 else v, n, text, docs.doc[rows].tobytes(),
                    docs.tie[rows].tobytes(), begin[members].tobytes())):
                columns[name].append(x)
        return pa.table(columns, schema=schema)

    return run


FOUND = ("kind int, part bigint, piece int, batch int, docs binary, ties binary, starts binary, "
         "ends binary, digests binary")
REMOVED, STRINGS = 0, 1


def _ranges(batch: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray,
            end: np.ndarray) -> list[dict]:
    """One row for each batch with the ranges to remove, joined where they touch."""
    if not len(batch):
        return []
    order = np.lexsort((start, tie, doc, batch))
    batch, doc, tie, start, end = (x[order] for x in (batch, doc, tie, start, end))
    head = np.ones(len(batch), bool)
    head[1:] = (batch[1:] != batch[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    # The furthest end so far in the document: ranks of documents keep them apart.
    name = np.cumsum(head)
    stride = int(end.max()) + 1
    far = np.maximum.accumulate(name * stride + end) - name * stride
    head[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(batch)) - 1
    cuts = np.flatnonzero(np.diff(batch[first], prepend=-1))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(first)]):
        f, l = first[a:b], last[a:b]
        out.append({"kind": REMOVED, "part": -1, "piece": int(batch[f[0]]), "batch": int(batch[f[0]]),
                    "docs": doc[f].tobytes(), "ties": tie[f].tobytes(),
                    "starts": start[f].tobytes(), "ends": far[l].tobytes(), "digests": b""})
    return out


def _table(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_schema(ddl))


def _shard(table: pa.Table) -> pa.Table:
    """Ranges to remove among the contexts of a shard; strings of anchors that other shards have too."""
    cols = {n: table.column(n).to_pylist() for n in ("hash", "context", "batch", "spread", "docs",
                                                     "ties", "starts")}
    members: dict[tuple[int, bytes], list[int]] = {}
    for i, key in enumerate(zip(cols["hash"], cols["context"])):
        members.setdefault(key, []).append(i)
    sizes = np.array([len(x) // 8 for x in cols["docs"]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    doc, tie, start = (np.frombuffer(b"".join(cols[c]), np.int64) for c in ("docs", "ties", "starts"))
    batch = np.array(cols["batch"])[row]
    names = list(members)
    context = np.empty(len(sizes), np.int64)
    for k, rows in enumerate(members.values()):
        context[rows] = k
    context = context[row]
    length = np.array([len(n[1]) for n in names])
    order = np.lexsort((start, tie, doc, context))
    head = np.ones(len(order), bool)
    head[1:] = context[order[1:]] != context[order[:-1]]
    first = order[head]  # of each context, its earliest place
    copies = order[~head]
    copies = copies[(doc[copies] != doc[first[context[copies]]])
                    | (tie[copies] != tie[first[context[copies]]])
                    | (start[copies] != start[first[context[copies]]])]
    lost = [(batch[copies], doc[copies], tie[copies], start[copies], start[copies] + length[context[copies]])]
    hashes = np.array([n[0] for n in names], np.int64)
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    hot = np.array([cols["spread"][rows[0]] > 1 for rows in members.values()])
    strings: list[dict] = []
    compared = np.flatnonzero((count[which] > 1) | hot)
    if len(compared):
        end_ = bytes([SEPARATOR])
        data = np.frombuffer(end_.join([*(names[k][1] for k in compared), b""]), np.uint8)
        ends = np.cumsum(length[compared] + 1)
        suffixes, rank = suffix_array(data)
        shared = common_prefixes(data, suffixes, rank)
        inside = np.searchsorted(ends, suffixes, "right")
        whole = ends[inside] - 1 - suffixes >= LENGTH
        group = np.cumsum(shared < LENGTH)
        at, inside, group = suffixes[whole], inside[whole], group[whole]
        owner = first[compared[inside]]
        begin = start[owner] + at - (ends[inside] - 1 - length[compared[inside]])
        order = np.lexsort((begin, tie[owner], doc[owner], group))
        at, owner, begin, group, inside = at[order], owner[order], begin[order], group[order], inside[order]
        lead = np.ones(len(group), bool)
        lead[1:] = group[1:] != group[:-1]
        leader = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
        later = ((doc[owner] != doc[owner[leader]]) | (tie[owner] != tie[owner[leader]])
                 | (begin != begin[leader]))
        o, b = owner[later], begin[later]
        lost.append((batch[o], doc[o], tie[o], b, b + LENGTH))
        if hot.any():
            mine = lead & hot[compared[inside]]
            strings = _strings(data, at[mine], hashes[compared[inside[mine]]], owner[mine], begin[mine],
                               batch, doc, tie, table.column("hot")[0].as_py(),
                               table.column("spread")[0].as_py())
    return _table(_ranges(*(np.concatenate(x) for x in zip(*lost))) + strings, FOUND)


def _strings(data, at, anchor, owner, begin, batch, doc, tie, part, pieces) -> list[dict]:
    """Sorted runs of (digest, place), one for each piece of the digests' range."""
    one, two = gram_hashes(data, LENGTH, 0)[at], gram_hashes(data, LENGTH, 1)[at]
    piece = (one % np.uint64(pieces)).astype(np.int64)
    order = np.lexsort((two, one, piece))
    out = []
    cuts = np.flatnonzero(np.diff(piece[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        o = order[a:b]
        out.append({
            "kind": STRINGS, "part": part, "piece": int(piece[o[0]]), "batch": -1,
            "docs": doc[owner[o]].tobytes(), "ties": tie[owner[o]].tobytes(),
            "starts": begin[o].tobytes(), "ends": batch[owner[o]].astype(np.int64).tobytes(),
            "digests": one[o].tobytes() + two[o].tobytes()})
    return out


def _merge(table: pa.Table) -> pa.Table:
    """Ranges pass; of strings that several shards hold, all but the earliest are removed."""
    rows = table.to_pylist()
    found = [r for r in rows if r["kind"] == REMOVED]
    runs = [r for r in rows if r["kind"] == STRINGS]
    if not runs:
        return table
    pair = np.dtype([("one", np.uint64), ("two", np.uint64)])
    digests = []
    for r in runs:
        both = np.frombuffer(r["digests"], np.uint64).reshape(2, -1)
        digests.append(np.empty(both.shape[1], pair))
        digests[-1]["one"], digests[-1]["two"] = both
    every = np.concatenate(digests)
    doc, tie, start, batch = (np.frombuffer(b"".join(r[c] for r in runs), np.int64)
                              for c in ("docs", "ties", "starts", "ends"))
    order = np.lexsort((start, tie, doc, every["two"], every["one"]))
    lead = np.ones(len(order), bool)
    lead[1:] = every[order[1:]] != every[order[:-1]]
    first = order[lead]
    table_ = every[first]  # one row for each string, sorted by digest
    lost = []
    offset = 0
    for run in digests:
        # Runs are sorted as well, so this is the merge: each is searched in the common table.
        hit = first[np.searchsorted(table_, run)]
        mine = np.arange(offset, offset + len(run))
        later = (doc[hit] != doc[mine]) | (tie[hit] != tie[mine]) | (start[hit] != start[mine])
        lost.append(mine[later])
        offset += len(run)
    m = np.concatenate(lost)
    return _table(found + _ranges(batch[m], doc[m], tie[m], start[m], start[m] + LENGTH), FOUND)


def _apply(id_col: str, plain: str, kept_columns: list[str], out: pa.Schema):
    def run(documents: pa.Table, found: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return out.empty_table()
        docs = Documents(documents, id_col, plain)
        row_of = {k: i for i, k in enumerate(zip(docs.doc.tolist(), docs.tie.tolist()))}
        doc, tie, start, end = (_joined(found, c, np.int64) for c in ("docs", "ties", "starts", "ends"))
        order = np.lexsort((start, tie, doc))
        spans: dict[int, list[list[int]]] = {}
        for i in order.tolist():
            own = spans.setdefault(row_of[int(doc[i]), int(tie[i])], [])
            if own and start[i] <= own[-1][1]:
                own[-1][1] = max(own[-1][1], int(end[i]))
            else:
                own.append([int(start[i]), int(end[i])])
        kept, removed, n_spans = [], [], []
        for i, text in enumerate(docs.texts):
            own = spans.get(i, [])
            edges = [0, *(x for s in own for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append(len(text) - len(kept[-1]))
            n_spans.append(len(own))
        lists = [documents.column(c) for c in kept_columns] + [
            pa.array([len(t) for t in docs.texts], pa.int64()), pa.array(removed, pa.int64()),
            pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(lists, out)], schema=out)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   batch_bytes: int = BATCH, bucket_bytes: int = BUCKET, shard_bytes: int = SHARD,
                   spread: int = SPREAD) -> DataFrame:
    """``docs`` without the text, with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary).

    Null texts are empty, and texts under 100 bytes lose nothing. Rows of one id are documents in
    the order of their texts; null ids come after all others. Extra columns of simple types stay,
    columns named like the results are replaced, and an empty table gives an empty result. The last
    four arguments bound what one task holds and change no result.
    """
    ship_package(docs.sparkSession)
    results = ("n_bytes", "n_removed", "n_spans", "kept")
    docs = without(docs, *(set(results) - {id_col, text_col}))
    plain, batch = fresh(docs, "plain_text", "batch")
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    batches, buckets, shards = (max(1, math.ceil(size / x)) for x in (batch_bytes, bucket_bytes, shard_bytes))
    salt = F.when(F.col(id_col).isNull(), F.xxhash64(plain)).otherwise(0)
    dealt = (docs.withColumn(plain, text_of(text_col)).drop(text_col)
             .withColumn(batch, F.pmod(F.xxhash64(id_col, salt), F.lit(batches)).cast("int")))
    kept_columns = [c for c in dealt.columns if c not in (plain, batch)]
    schema = dealt.select(*[F.col(f"`{c}`") for c in kept_columns]).withColumns(
        {"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"),
         "n_spans": F.lit(0).cast("long"), "kept": F.lit(b"")}).schema
    grouped = dealt.groupBy(batch)
    hashes = grouped.applyInArrow(releasing_groups(_hashes(id_col, plain, batch, buckets)), HASHES)
    flags = hashes.groupBy("bucket").applyInArrow(releasing_groups(_repeated(spread)), REPEATED)
    contexts = grouped.cogroup(flags.groupBy("batch")).applyInArrow(
        releasing_groups(_contexts(id_col, plain, shards)), CONTEXTS)
    found = contexts.groupBy("shard", "hot", "sub").applyInArrow(releasing_groups(_shard), FOUND)
    merged = found.groupBy("kind", "part", "piece").applyInArrow(releasing_groups(_merge), FOUND)
    return grouped.cogroup(merged.groupBy("batch")).applyInArrow(
        releasing_groups(_apply(id_col, plain, kept_columns, to_arrow_schema(schema))), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
