"""Operators that give a row for each document: multiset hash, tokens, sharding, mixing, toxicity."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import (awkward, awkward_rows, empty, sha, unique, unique_rows, with_clashes, words)
from pyspark.sql import functions as F

from trialweave.llm import mixing, multiset_hash, noisy_channel, sentencepieces, sharding, toxicity

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_mixing_counts_and_targets(spark):
    rows = unique_rows()
    got = {r.doc_id: r for r in mixing.systematic_mix(unique(spark)).collect()}
    assert len(got) == len(rows)
    sizes = Counter()
    for i, text, _, source, _ in rows:
        assert got[i]["size"] == len(words(text))
        sizes[source] += got[i]["size"]
    left, share, target = dict(sizes), 1.5 * sum(sizes.values()), {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        level = (share - sum(target.values())) / max(1e-9, sum(weight[s] for s in left))
        over = [s for s in left if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            del left[s]
    target |= {s: level * weight[s] for s in left}
    for i, _, _, source, _ in rows:
        assert got[i]["source_size"] == sizes[source]
        assert got[i]["target"] == pytest.approx(target[source])
        assert 0 <= got[i]["taken"] <= 2 * got[i]["size"]
        assert got[i]["taken"] == got[i]["copies"] * got[i]["size"]
    for s in sizes:
        n = sum(1 for r in rows if r[3] == s)
        copies = sum(got[r[0]]["copies"] for r in rows if r[3] == s)
        assert abs(copies - n * target[s] / sizes[s]) < 1
    again = {r.doc_id: r for r in mixing.systematic_mix(unique(spark).repartition(5)).collect()}
    assert got == again


def test_mixing_edges(spark):
    assert mixing.systematic_mix(empty(spark)).collect() == []
    mixed = mixing.systematic_mix(with_clashes(awkward(spark)))
    assert mixed.count() == len(awkward_rows())
    assert mixing.emitted(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.copies) for r in mixing.systematic_mix(blank).collect()] == [(0.0, 0)] * 2


def test_hypergeometric_draws_follow_the_distribution():
    from math import comb

    good, bad, draws = 13, 20, 9
    rng = np.random.default_rng(1)
    got = Counter(sharding.hypergeometric(good, bad, draws, rng.random()) for _ in range(20000))
    for k in range(draws + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert got[k] / 20000 == pytest.approx(p, abs=0.015)
    assert sharding.hypergeometric(5, 0, 3, 0.5) == 3
    big = sharding.hypergeometric(10 ** 10, 23 * 10 ** 10, 10 ** 6, 0.5)
    assert abs(big - 10 ** 6 / 24) < 100


def test_matrix_adds_up():
    blocks, shards = [5, 0, 17, 30, 1], sharding.shard_sizes(53, 7)
    matrix = sharding.communication_matrix(blocks, shards, 3)
    assert [sum(r) for r in matrix] == blocks
    assert [sum(c) for c in zip(*matrix)] == shards


@pytest.mark.parametrize("make", [awkward, unique, empty])
def test_sharding_is_exact_and_gapless(spark, make):
    docs = with_clashes(make(spark))
    got = sharding.hypergeometric_shuffle(docs, 6, rows_per_task=4).collect()
    total = docs.count()
    assert len(got) == total
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(len(s) for s in slots.values()) == sorted(x for x in sharding.shard_sizes(total, 6) if x)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r.text for r in got) == Counter(r.text for r in docs.collect())


def test_sharding_shuffles_the_texts(spark, monkeypatch, tmp_path):
    unique(spark).write.parquet(f"{tmp_path}/documents.parquet")
    given, real = [], sharding.hypergeometric_shuffle
    monkeypatch.setattr(sharding, "hypergeometric_shuffle", lambda docs: given.append(docs) or real(docs))
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.query(spark, str(tmp_path)).collect()}
    assert "text" in given[0].columns
    texts = {r[0]: (r[1] or "").encode() for r in unique_rows()}
    assert got == {i: (len(x) + 8, zlib.crc32(x)) for i, x in texts.items()}


def test_multiset_hash_of_edits(spark):
    rows = sorted(unique_rows(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in multiset_hash.edited_fingerprints(with_clashes(unique(spark))).collect()}
    prints = {}
    for i, row in enumerate(rows):
        text, following = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.near_edited == 1
        if following == text:
            assert r.near_next == 1


def test_multiset_hash_edges(spark):
    assert multiset_hash.edited_fingerprints(empty(spark)).collect() == []
    got = multiset_hash.edited_fingerprints(awkward(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward_rows())
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    r = multiset_hash.edited_fingerprints(one).first()
    assert r.edited_sha256 == sha("a b a b") and r.near_next == 1.0


def test_multiset_hash_of_a_million_equal_words(spark):
    docs = spark.createDataFrame([(1, "a " * 600_000 + "b " * 100_000), (2, "a " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in multiset_hash.edited_fingerprints(docs).collect()}
    assert got[1].near_edited > 0.5


def test_multiset_hash_is_a_sum(spark):
    texts = spark.createDataFrame([(1, "b c\nd e f"), (2, "d e f\nb c"), (3, "b c"), (4, "d e f")],
                                  "i long, text string")
    p = {r.i: r for r in multiset_hash.fingerprints(texts, ["i"]).collect()}
    assert (p[1].exact, p[1].lanes, p[1].pairs) == (p[2].exact, p[2].lanes, p[2].pairs)
    both = multiset_hash.fingerprints(texts, ["i"])
    a, b = both.filter("i = 1").alias("a"), both.filter("i = 4").alias("b")
    col = lambda t: {c: F.col(f"{t}.{c}") for c in ("exact", "lanes", "pairs")}
    less = a.crossJoin(b).select(*[v.alias(k) for k, v in multiset_hash.combined(col("a"), col("b"), -1).items()]).first()
    assert (less.exact, less.lanes, less.pairs) == (p[3].exact, p[3].lanes, p[3].pairs)


def test_tokens_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = with_clashes(awkward(spark))
    got = sentencepieces.encode_and_decode(docs, MODEL).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        ids = sp.encode(r.text or "", add_eos=True)
        assert r.ids == ids and r.decoded == sp.decode(ids)
    assert sentencepieces.encode_and_decode(empty(spark), MODEL).collect() == []


def test_small_chunk_table():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = sentencepieces.ChunkTable(sentencepieces.read_model(MODEL), limit=3)
    for text in ("a b c d e f a b", " ", "  ", "a ", "", "f f f", "<unk> </s>"):
        assert table.encode(text) == sp.encode(text, add_eos=True)


def test_disguises_are_undone():
    plain = ["idiot", "loser", "stupid", "house", "table", "number", "the", "this", "is"] * 50
    model = noisy_channel.log_model(noisy_channel.trigram_counts([" ".join(plain)]), ["idiot", "loser"])
    known = frozenset(["idiot", "loser"])
    for token, want in (("1d10t", "idiot"), ("l0$er", "loser"), ("idiooooot", "idiot"), ("l.o.s.e.r", "loser"),
                        ("idioot", "idiot"), ("house,", "house"), ("THE!!".lower(), "the")):
        assert noisy_channel.restored(token, model, known) == [want]
    assert noisy_channel.viterbi("s t u p i d", model) == "stupid"
    assert noisy_channel.restored("12345", model, known) == [] and noisy_channel.restored("", model, known) == []


def test_signs_alone_are_undone():
    model = noisy_channel.log_model(noisy_channel.trigram_counts(["ass lol is the house " * 50]), ["ass", "lol"])
    known = frozenset(["ass", "lol"])
    assert noisy_channel.restored("4$$", model, known) == ["ass"]
    assert noisy_channel.restored("|0|", model, known) == ["lol"]
    assert noisy_channel.restored("2024", model, known) == [] and noisy_channel.restored("$$", model, known) == []


def best_by_enumeration(token, model):
    """(log probability, text) of the best path, all paths written out."""
    nc, best = noisy_channel, None
    choices = []
    for c, run in itertools.groupby(token):
        n = len(list(run))
        if c in nc.SYMBOL:
            choices.append([(c, 0.0 if n == 1 else nc.COLLAPSED)] + [(2 * c, 0.0 if n == 2 else nc.COLLAPSED)] * (n > 1))
        elif c in nc.LOOKALIKES:
            alike = nc.LOOKALIKES[c]
            choices.append([("", nc.DROPPED)] + [(x, nc.SUBSTITUTED + nc.COLLAPSED * (n > 1)) for x in alike]
                           + [(2 * x, 2 * nc.SUBSTITUTED) for x in alike] * (n > 1))
        else:
            choices.append([("", nc.JOINED), (" ", nc.SPACED)])
    for path in itertools.product(*choices):
        # A space after a space, or at the start, is no symbol.
        text = "".join(x for x, _ in path)
        symbols = [0, 0]
        total = sum(cost for _, cost in path)
        for z in [nc.SYMBOL.get(c, 0) for c in text]:
            if z or symbols[-1]:
                total += model[(symbols[-2] * nc.SIZE + symbols[-1]) * nc.SIZE + z]
                symbols.append(z)
        total += model[(symbols[-2] * nc.SIZE + symbols[-1]) * nc.SIZE]
        if best is None or total > best[0]:
            best = (total, text.split())
    return best


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    model = noisy_channel.log_model(noisy_channel.trigram_counts(
        ["the loser is stupid and all bells see the glass " * 20]), ["loser", "stupid"])
    for _ in range(300):
        token = "".join(rng.choice(list("aelosst10$.3!"), int(rng.integers(1, 8))))
        assert noisy_channel.viterbi(token, model).split() == best_by_enumeration(token, model)[1], token


def toxic_tables(spark, n=1200):
    rng = np.random.default_rng(0)
    vocabulary = ["house", "table", "number", "tree", "green", "walks", "over", "under", "river"]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(vocabulary, 30))
        toxic = i % 8 == 0
        if toxic:
            text[int(rng.integers(30))] = ["idiot", "1d10t", "i d i o t", "idiooot"][i // 8 % 4]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, 1, None), (9, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs.withColumn("held", toxicity.held_out()), model).collect()
    held = [r for r in got if r.held]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted != (r.doc_id % 8 == 0) for r in held) == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    # Labels of held-out rows are not read.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(docs, turned)
    assert other.marks == model.marks and np.allclose(other.weights, model.weights)
    edge = toxicity.score_toxicity(with_clashes(awkward(spark)), model).collect()
    assert len(edge) == len(awkward_rows()) and all(r.score is not None for r in edge)
    assert toxicity.score_toxicity(empty(spark), model).collect() == []


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark, 40)
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.train(docs, few)
        assert len({r.score for r in toxicity.score_toxicity(docs, model).collect()}) == 1
    assert toxicity.train(empty(spark), labels.limit(0)).marks == {}


def test_chunks_are_segmented_once(monkeypatch):
    """A full table keeps what it has, and what many texts share is segmented once for all of them."""
    table = sentencepieces.ChunkTable(sentencepieces.read_model(MODEL), limit=4)
    plain, calls = table.model, []

    class Counted:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode(self, chunks, **options):
            calls.extend(chunks)
            return plain.encode(chunks, **options)

    table.model = Counted()
    texts = ["one two three", "two three four  five ", "three ▁x " + "six " * 9, "", " ", "a"] * 3
    for _ in range(2):
        calls.clear()
        assert [x.tolist() for x in table.encode_all(texts)] == [plain.encode(t, add_eos=True) for t in texts]
        assert len(calls) == len(set(calls)) and len(table.ids) == 4


def test_texts_go_to_tasks_once(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6)], "doc_id long, text string, n int")
    model = toxicity.Model({}, [0.0] * noisy_channel.SIZE ** 3, np.zeros(0), 0.0)
    for out in (sentencepieces.encode_and_decode(docs, MODEL), toxicity.score_toxicity(docs, model)):
        assert "plain_text" not in out._jdf.queryExecution().analyzed().toString()
        assert [(r.doc_id, r.text, r.n) for r in out.orderBy("doc_id").collect()] == [(1, "a b", 5), (2, None, 6)]


def test_scores_leave_a_task_in_parts(spark, monkeypatch):
    """A batch of long texts does not come back as one batch."""
    import pyarrow as pa

    held = {}
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: held.update(run=run) or self.withColumn("score", F.lit(0.0)))
    model = toxicity.Model({}, [0.0] * noisy_channel.SIZE ** 3, np.zeros(0), 0.0)
    toxicity.score_toxicity(spark.createDataFrame([], "doc_id long, text string"), model)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["x" * 400_000, None, "y" * 900_000, "z"]})
    parts = list(held["run"](iter([batch])))
    assert [p.num_rows for p in parts] == [3, 1]
    assert pa.Table.from_batches(parts).select(["doc_id", "text"]).to_pydict() == batch.to_pydict()
