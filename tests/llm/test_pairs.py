"""Operators that look at several documents: SimHash, suffix arrays, passages, neighbours, pipeline."""

import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from fixtures_llm import (SCHEMA, awkward, awkward_rows, components_of, empty, lowered, sha, simhash_by_bits, unique,
                          unique_rows, with_clashes, without_repeats, words)
from pyspark.sql import functions as F

from trialweave.llm import components, hilbert, passages, simhash, suffix_arrays, suffix_dedup
from trialweave.llm.passages import NO_ID
from trialweave.session import free_shuffles, work_folder, written


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (20, 20), (30, None)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_simhash_components(spark):
    rows = unique_rows()
    prints = [simhash_by_bits(r[1]) for r in rows]
    root = components_of(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    for r in simhash.near_duplicates(with_clashes(unique(spark))).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == root[r.doc_id]


def test_simhash_edges(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    alone = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert simhash.near_duplicates(alone).first().component_id is None


@pytest.mark.parametrize("bits,blocks,most", [(4, 6, 1 << 15), (2, 4, 3)])
def test_simhash_links_of_near_fingerprints(spark, bits, blocks, most):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 64, 40, np.uint64)
    near = values[rng.integers(0, 40, 300)]
    for _ in range(4):
        near = near ^ np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    every = sorted(set(np.concatenate([values, near]).view(np.int64).tolist()))
    frame = spark.createDataFrame([(x,) for x in every], "fp long")
    root = dict(components.components(simhash.links(frame, bits, blocks, most)).collect())
    u = np.array(every).view(np.uint64)
    want = components_of(len(u), lambda i, j: int(u[i] ^ u[j]).bit_count() <= bits)
    assert [root.get(x, x) for x in every] == [every[w] for w in want]


@pytest.mark.parametrize("bits, blocks, most", [(8, 10, 1 << 15), (8, 10, 20), (4, 6, 30)])
def test_open_pairs_are_passed_on_once(spark, bits, blocks, most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, np.int64)
    prints = {int(b ^ sum(1 << int(x) for x in rng.choice(63, int(rng.integers(0, 7)), replace=False))) for b in base for _ in range(30)}
    prints = sorted({-p if i % 5 == 0 else p for i, p in enumerate(prints)})
    rows = [(p, i % 3 == 0) for i, p in enumerate(prints)]
    got = simhash.open_pairs(spark.createDataFrame(rows, "fp long, open boolean"), bits, blocks, most).collect()
    want = {frozenset((p, q)) for p, a in rows for q, b in rows
            if p != q and (a or b) and ((p ^ q) & ((1 << 64) - 1)).bit_count() <= bits}
    assert len(got) == len(want) and {frozenset((r.a, r.b)) for r in got} == want and len(want) > 100


def test_trie_prunes_but_loses_nothing():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 12, 900, np.uint64))
    i, j = simhash.trie_links(prints, np.zeros(len(prints), np.int64), 2)
    got = {(int(a), int(b)) for a, b in zip(np.minimum(i, j), np.maximum(i, j))}
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints))
            if int(prints[a] ^ prints[b]).bit_count() <= 2}
    assert got == want and len(i) == len(got)


def test_one_of_each_group_stays(spark):
    kept = simhash.deduplicated(with_clashes(unique(spark)))
    assert set(kept.columns) == set(with_clashes(unique(spark)).columns)
    rows = {r[0]: set(shingles(r[1])) for r in unique_rows()}
    left = {r.doc_id for r in kept.collect()}
    like = lambda a, b: len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b])
    for i in rows:
        if i not in left:
            assert any(like(i, j) for j in left if j < i)
    assert len({unique_rows()[i][1] for i in left}) == len(left)
    assert simhash.deduplicated(empty(spark)).collect() == []
    assert simhash.deduplicated(awkward(spark)).select("doc_id", "text").distinct().count() == simhash.deduplicated(
        awkward(spark)).count()


def test_copies_go_beside_an_unlike_head(spark, monkeypatch):
    rng = np.random.default_rng(12)
    text = [f"w{x}" for x in rng.integers(0, 10 ** 6, 200)]
    changed = text[:100] + ["changed"] + text[101:]
    rows = [(1, [f"u{x}" for x in rng.integers(0, 10 ** 6, 200)]), (5, text), (6, text), (7, text), (8, changed), (9, changed),
            (10, [f"v{x}" for x in rng.integers(0, 10 ** 6, 200)]), (None, text), (11, text[:60] + [f"z{x}" for x in range(140)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    # All fingerprints are close: id 1 is the smallest of the group and like none of the others.
    real = simhash.with_fingerprint
    monkeypatch.setattr(simhash, "with_fingerprint", lambda *a, **b: real(*a, **b).withColumn(
        "fp", F.col("fp").bitwiseAND(F.lit(15))))
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [1, 5, 10, 11]


def shingles(text):
    w = words(lowered(text))
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(1, 150))
        s = rng.integers(1, 1 + rng.integers(1, 4), n).astype(np.uint8)
        if k % 3 == 0:
            s = np.tile(s[:7], n // 7 + 1)[:n]
        order, rank = suffix_arrays.suffix_array(s)
        b = s.tobytes()
        want = sorted(range(n), key=lambda i: b[i:])
        assert order.tolist() == want
        shared = [0]
        for x, y in zip(want, want[1:]):
            c = 0
            while max(x, y) + c < n and b[x + c] == b[y + c]:
                c += 1
            shared.append(c)
        assert suffix_arrays.common_prefixes(s, order, rank).tolist() == shared


def repeated_rows():
    import random

    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef ") for _ in range(160))
    rows = []
    for i in range(90):
        n = rng.choice([0, 5, 99, 100, 101, 150, 300, 2000])
        t = "".join(rng.choice("xyzw ") for _ in range(n))
        r = rng.random()
        if r < .3:
            t = t[:n // 2] + passage + t[n // 2:]
        elif r < .4:
            t = "a" * rng.randint(90, 400)
        elif r < .5:
            t = (rng.choice(["ab", "é日", "xyz1234"]) * 200)[:rng.randint(50, 400)]
        elif r < .6:
            t = passage[rng.randint(0, 70):] + t
        elif r < .65 and rows:
            t = rows[-1][1]
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"batch_bytes": 2000, "bucket_bytes": 4000, "shard_bytes": 3000, "spread": 2}])
def test_repeats_are_removed(spark, bounds):
    rows = repeated_rows() + [(1000 + r[0], r[1]) for r in unique_rows()]
    want = without_repeats([t for _, t in sorted(rows)])
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(suffix_dedup.remove_repeats(docs, **bounds).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == want


def test_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).collect() == []
    got = suffix_dedup.remove_repeats(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    # Rows of one id are documents in the order of their texts, null ids last.
    order = sorted(awkward_rows(), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    want = without_repeats([r[1] for r in order])
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted(w[:2] for w in want)


def passages_by_brute_force(rows, least=20):
    found = []
    for i, text, *_ in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if len(words(line)) >= least:
                found.append((i, k, set(shingles(line))))
    root = components_of(len(found), lambda a, b: len(found[a][2] & found[b][2]) >= 0.8 * len(found[a][2] | found[b][2]))
    removed = {}
    for n, r in enumerate(root):
        if r != n:
            removed.setdefault(found[n][0], []).append(found[n][1])
    return removed


def test_passages(spark):
    rows = unique_rows()
    line = rows[6][1].split("\n")[0].split()[:80]
    for i in range(12):  # a family of near-copies with the same word changed elsewhere
        changed = list(line)
        changed[6 * i] = "changed"
        rows.append((100 + i, "short\n" + " ".join(changed), None, None, 0))
    want = passages_by_brute_force(rows)
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r.removed for r in passages.removed_passages(docs).collect()}
    assert len(got) == len(rows)
    assert {i: x for i, x in got.items() if x} == want
    assert passages.removed_passages(empty(spark)).collect() == []
    assert passages.removed_passages(awkward(spark)).count() == len(awkward_rows())


def test_query_takes_short_lines(spark, tmp_path):
    near = "a b c d e f g h i j k l m n o p q r s"
    texts = ["all rights reserved\nalone here", "all rights reserved\n\nyes", "No\nyes\n\n" + near, near + " t"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in passages.query(spark, str(tmp_path)).collect()}
    assert got == {0: [], 1: [0], 2: [1], 3: [0]}


def test_passages_across_lines(spark, tmp_path):
    rng = np.random.default_rng(7)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 6, n)]
    passage = some(80)
    texts = [some(40) + passage + some(70), some(9) + ["\n"] + some(30) + passage[:33] + ["\n"] + passage[33:] + some(50),
             some(120), passage + ["\n"] + some(5)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in passages.query(spark, str(tmp_path)).collect()}
    assert got[0] == [] and got[2] == []
    for i, at in ((1, 39), (3, 0)):  # words of the passage and no others
        ((first, n),) = got[i]
        assert at <= first and first + n <= at + 80 and n >= 50


def spans_by_brute_force(rows):
    """Runs of words in pieces that stand earlier, and the removed lines, of rows by (id, hash of text)."""
    place = lambda r: (NO_ID if r[0] is None else r[0], np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    order = sorted(rows, key=place)
    removed, first = {}, {}
    lines = [(n, i, set(shingles(x))) for n, r in enumerate(order) for i, x in enumerate((r[1] or "").split("\n")) if words(x)]
    for c, head in enumerate(components_of(len(lines), lambda a, b: len(lines[a][2] & lines[b][2]) >= 0.8 * len(lines[a][2] | lines[b][2]))):
        if head != c:
            removed.setdefault(lines[c][0], []).append(lines[c][1])
    pieces = [list(zip(*[x.tolist() for x in passages.pieces_of(r[1])])) for r in order]
    for n, found in enumerate(pieces):
        for name, at, _, a, b in found:
            if not any(a <= x <= b for x in removed.get(n, [])):
                first[name] = min(first.get(name, (n, at)), (n, at))
    out = []
    for n, found in enumerate(pieces):
        cut = {w for name, at, k, *_ in found if name in first and first[name] < (n, at) for w in range(at, at + k)}
        if n and order[n][:2] == order[n - 1][:2]:  # a copy of the row before
            cut = set(range(len((order[n][1] or "").split()))) if found else set()
            removed[n] = [i for m, i, _ in lines if m == n]
        out.append((order[n][0], tuple(removed.get(n, [])), tuple(sorted(cut))))
    return sorted(out, key=str)


def test_spans_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(11)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 6, n)]
    passage, other = some(60), some(70)
    make = lambda *parts: " ".join(w for p in parts for w in p)
    rows = [(None, make(some(8), passage)), (None, make(some(3), passage, some(9))), (7, make(some(30), other)),
            (7, make(other, some(12))), (9, make(passage, ["\n"], other)), (9, make(passage, ["\n"], other)),
            (None, make(other, some(2))), (None, make(other, some(2))), (5, None), (5, ""), (5, None), (6, "few words"), (6, "few words")]
    rows += [rows[6]]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = passages.removed_passages(docs, least_words=1, pieces=True).collect()
    shown = sorted(((r.doc_id, tuple(r.removed), tuple(w for a, n in r.spans for w in range(a, a + n))) for r in got), key=str)
    assert shown == spans_by_brute_force([(i, t or "") for i, t in rows])
    assert len(got) == len(rows)


def test_near_copies_that_are_unlike_the_first_of_their_band(spark, monkeypatch):
    rng = np.random.default_rng(23)
    base, rows = [f"w{x}" for x in rng.integers(0, 10 ** 6, 60)], []
    for i in range(60):  # up to six words changed: some pairs reach the similarity, some do not
        line = list(base)
        for at in rng.choice(60, i % 7, replace=False):
            line[at] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(line)))
    several = "\n".join(f"line {j}" for j in range(70_000))  # more lines than one row holds
    rows += [(100, several), (101, several)]
    asked, plain = [], passages._rare_pairs
    monkeypatch.setattr(passages, "_rare_pairs", lambda *a: asked.append(a[-1]) or plain(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in passages.removed_passages(docs, least_words=1).collect()}
    assert got.pop(101) == list(range(70_000)) and got.pop(100) == []
    want = passages_by_brute_force(rows[:60])
    assert {i: x for i, x in got.items() if x} == want and 0 < len(want) < 59
    assert asked == [*range(passages.DRAWS), None]


def test_near_copies_need_few_searches_for_classes(spark, monkeypatch):
    """Every search is a row of small exchanges, whose files add up on disk."""
    rng = np.random.default_rng(29)
    base, rows = [f"w{x}" for x in rng.integers(0, 10 ** 6, 60)], []
    for i in range(40):
        line = list(base)
        for at in rng.choice(60, i % 7, replace=False):
            line[at] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(line)))
    searched, plain = [], passages.components
    monkeypatch.setattr(passages, "components", lambda links: searched.append(1) or plain(links))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in passages.removed_passages(docs, least_words=1).collect()}
    want = passages_by_brute_force(rows)
    assert {i: x for i, x in got.items() if x} == want and 0 < len(want) < 39
    assert len(searched) == 3


def test_passages_leave_no_table_that_nothing_reads(spark):
    """Disk is bounded by what a step reads and writes, not by the sum of all steps."""
    rng = np.random.default_rng(31)
    base, rows = [f"w{x}" for x in rng.integers(0, 10 ** 6, 60)], []
    for i in range(30):
        line = list(base)
        for at in rng.choice(60, i % 7, replace=False):
            line[at] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Path(work_folder(spark).removeprefix("file://")) / "trialweave"
    before = set(folder.glob("*"))
    found = passages.removed_passages(docs, least_words=1, pieces=True)
    left = [x.name.rpartition("-")[0] for x in set(folder.glob("*")) - before]
    assert sorted(set(left) - {"edges"}) == ["passage-cuts", "passage-names", "passages-removed", "pieces-repeated"]
    assert left.count("edges") <= 3  # the last round of each search for classes
    want = passages_by_brute_force(rows)
    for _ in range(2):  # read again: what is left is all that it needs
        assert {r.doc_id: r.removed for r in found.collect() if r.removed} == want


def test_shuffle_files_of_the_last_query_go_too(spark):
    dirs = [x.getPath() for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x.name for d in dirs for x in Path(d).glob("*/shuffle_*.data")}
    free_shuffles(spark)
    before = files()
    written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "sums")
    assert files() - before
    free_shuffles(spark)
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before


def test_bands_miss_little():
    bands, rows = passages.bands_for(0.8, 40, 0.01)
    assert bands * rows <= 40 and (1 - 0.8 ** rows) ** bands <= 0.01


def test_hilbert_curve_is_a_path():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), -1).reshape(-1, dims)
        place = hilbert.hilbert_index(cells, bits)
        assert sorted(place.tolist()) == list(range(side ** dims))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def brute_neighbours(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i)
            out[i] = [(r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return out


def test_neighbours_of_a_small_table(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(60)]
    rows += [(100 + i, rows[10][1]) for i in range(15)]
    rows += [(200, None), (300, [0.0] * 8), (400, [float("nan")] * 8), (500, [1.0, None] + [1.0] * 6), (None, [1.0] * 8),
             (600, [float("inf")] * 8), rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    want = brute_neighbours(list(dict((repr(r), r) for r in rows).values()), 10, 10)
    got = {}
    for r in hilbert.nearest(frame, every=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert [x[:2] for x in sorted(found)] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in sorted(found)], [x[2] for x in want[q]])
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert hilbert.nearest(none).collect() == []
    two = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in hilbert.nearest(two).collect()] == [(0, 1)]


def test_neighbours_in_many_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hilbert.nearest(frame, least=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_neighbours(rows, 10, 100)
    recall = np.mean([len(got[q] & {x[1] for x in w}) / 10 for q, w in want.items()])
    assert recall >= 0.9


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline
    from test_rows import toxic_tables

    docs, labels = toxic_tables(spark, 400)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"),
                       F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.filter("doc_id in (1, 2, 3)").withColumn("doc_id", F.col("doc_id") + 5000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.collect()
    now, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        sizes.append(now.count())
        assert now.columns == docs.columns
        if name == "toxicity":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in rows if r.doc_id % 8 or r.doc_id > 5000}
        if name == "near_duplicates":
            assert not {5001, 5002, 5003} & {r.doc_id for r in now.collect()}
            before = sorted(now.collect(), key=lambda r: r.doc_id)
        if name == "repeated_text":
            want = without_repeats([r.text for r in before])
            got = sorted(now.collect(), key=lambda r: r.doc_id)
            assert [r.text for r in got] == [w[3].decode() for w in want]
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.count() == sizes[-1] and len(corpus_pipeline.STAGES) == 5
    assert sha("") == sha(b"")
