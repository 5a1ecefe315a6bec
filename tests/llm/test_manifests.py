"""Merkle manifest, prefix trie and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import SCHEMA, awkward_rows, empty, sha, with_clashes
from pyspark.sql import functions as F

from trialweave.llm import merkle, packing, prefix_trie


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def proof_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 3])))
        at //= 3
    return out


def manifest_by_hand(rows):
    """rows (doc_id, text, lang, source, n_chars) -> sorted (doc_id, leaf, altered, subroot, root, proof)."""
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1] and r[1].replace(" ", ""))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    return sorted(
        (str(x[1] if x[0] else None), x[2], x[3], trees[s][-1][0], top[-1][0], str(proof_of(trees[s], i) + proof_of(top, k)))
        for k, s in enumerate(names) for i, x in enumerate(sorted(by[s])))


def manifest_rows(df, band):
    leaves, nodes, _ = merkle.manifest(df, F.replace(F.col("text"), F.lit(" "), F.lit("")), band=band)
    got = leaves.collect()
    return sorted((str(r.id), r.leaf, r.altered, r.subroot, r.root, str([tuple(p) for p in r.proof])) for r in got), nodes


@pytest.mark.parametrize("band", [1, 2, 7])
def test_manifest(spark, band):
    rows = awkward_rows() + [(1000 + i, f"text {i}", "en", "hot", i) for i in range(100)]
    got, nodes = manifest_rows(with_clashes(spark.createDataFrame(rows, SCHEMA)).withColumn("digest", F.lit("x")), band)
    assert got == manifest_by_hand(rows)
    # Nested intervals: the children of a node cover it without gaps.
    kept = [(r.owner, r.level, r.lo, r.hi) for r in nodes.collect()]
    assert len(kept) == len(set(kept))
    for owner, level, lo, hi in kept:
        below = sorted((a, b) for o, at, a, b in kept if o == owner and at == level - 1 and lo <= a and b <= hi)
        if level > 1:
            assert below[0][0] == lo and below[-1][1] == hi and all(x[1] == y[0] for x, y in zip(below, below[1:]))


def test_small_manifests(spark):
    assert manifest_rows(empty(spark), 7)[0] == []
    for rows in ([(5, "alone", None, None, 1)], [(5, "one", "x", "a", 1), (5, "one", "x", "a", 1), (None, None, None, "b", None)]):
        assert manifest_rows(spark.createDataFrame(rows, SCHEMA), 7)[0] == manifest_by_hand(rows)


def test_very_long_text(spark):
    rows = [(1, "long text " * 300_000, "en", "a", 0), (2, "b", "en", "a", 0)]
    assert manifest_rows(spark.createDataFrame(rows, SCHEMA), 7)[0] == manifest_by_hand(rows)


def test_tampering_is_seen(spark, sf_dir):
    rows = {r.doc_id: r for r in merkle.query(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        touched = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")
        assert rows[r.doc_id].verified == (not touched)


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, said, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        weight = (len(v) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += weight
    return sorted(
        (min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k],
         sha(",".join(map(str, sorted(c for c in v if len(paths[c]) == len(k)))))) for k, v in members.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit(c) for c in ("depth", "a", "b", "at", "said", "length", "owner", "uid")})
    out = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df)).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256) for r in out)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-n // 4, n):
        if rng.random() < 0.85:
            for t in range(rng.choice((1, 2, 3, 9, 12, 40))):
                rows.append((c, rng.choice((None, t)) if t < 2 else t, rng.choice(("user", "assistant", None)) if t > 3 else "user",
                             rng.choice((None, "", "é", "same", "long " * 9)) if t % 4 else "hello"))
    copy = [(t, r, x) for c, t, r, x in rows if c == 0] or [(0, "user", "x")]
    rows += [(c, *x) for c in range(1000, 1030) for x in copy]
    rows += [(5000, t, "user", f"turn {t}") for t in range(300)] + [(5001, t, "user", f"turn {t}") for t in range(300)]
    return rows + [(None, 0, "user", "lost"), (77777, 0, "user", "x")]


@pytest.mark.parametrize("chunk,shard,most", [(4096, 100_000, 4096), (7, 50, 3), (1, 10, 1)])
def test_trie(spark, monkeypatch, chunk, shard, most):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(prefix_trie, "LIST", most)
    rows = conversations(chunk, 40)
    # Exact repeats of a row tie in every column, so the order does not matter.
    rows += [r for r in rows if r[0] == 3]
    assert trie_rows(spark, rows) == trie_by_hand(rows)


def test_small_tries(spark):
    assert trie_rows(spark, []) == []
    # Conversation 1 takes turns of 0, which is absent; its own first turns go.
    for rows in ([(1, 0, "user", "a")], [(0, 0, "user", "a")], [(None, 0, "user", "a")], [(2, None, None, None), (2, 1, "u", "x" * 100_000)]):
        assert trie_rows(spark, rows) == trie_by_hand(rows)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2**63, 2**63, 5000), rng.integers(0, 3, 5000)
    table = prefix_trie.SlotTable(a, b)
    assert sorted(table.slots(a, b)) == list(range(5000))
    assert (table.slots(a, b + 9) == -1).all()
    assert list(prefix_trie.SlotTable(a[:0], b[:0]).slots(a[:2], b[:2])) == [-1, -1]
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


def model_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_table():
    import tokenizers

    model = tokenizers.Tokenizer.from_file(model_path())
    with open(model_path()) as f:
        table = packing.WordIds(f.read(), limit=40)
    rng = random.Random(3)
    odd = ["", " ", "It's WE'VE 12ab", "Σας ΟΔΟΣ", "J̌ é İİ", "a\x1cb\x1d \x1e\x1f", "x<|endoftext|>y <|ENDOFTEXT|>", "日本 語",
           "a\xa0b c\x85d e", "\x00 \x7f", "K Å ﬁ", "'S 'lL''d", "🎉🎉 é", "각 각"]
    texts = odd + ["".join(rng.choice("aZ 's.\n\t9éßΣ́\x1f\xa0<|") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for i in range(0, len(texts), 7):
        part = texts[i:i + 7]
        for text, ids in zip(part, table.encode(part)):
            assert np.frombuffer(ids, np.uint32).tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(table.ids) <= 40


def fewest(lengths, capacity):
    """Fewest bins by trying everything."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in {b: k for k, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1:]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bounds_and_best_fit():
    rng = random.Random(4)
    for _ in range(150):
        lengths = np.array(sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True))
        where, offset, left = packing.best_fit(lengths, 20)
        best = fewest(lengths.tolist(), 20)
        assert packing.lower_bound(lengths, 20) <= best <= len(left)
        for b in range(len(left)):
            used = sorted((o, n) for o, n, w in zip(offset, lengths, where) if w == b)
            assert [o for o, _ in used] == [sum(n for _, n in used[:i]) for i in range(len(used))]
            assert sum(n for _, n in used) == 20 - left[b]
    # Three of a third each fit; two thirds of a bin never share one.
    assert packing.lower_bound(np.array([14, 14, 14, 6]), 20) == 3


def places(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.sequence_id].append((r.offset, r.length))
    for held in out.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
    return out


@pytest.mark.parametrize("group", [10, 100, 100_000])
def test_rounds(spark, group):
    rng = random.Random(group)
    lengths = [rng.choice((rng.randint(1, 60), rng.randint(300, 700), 1024, 2048)) for _ in range(1500)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    out = packing.packed(pieces, group_rows=group).join(pieces, "uid")
    held = places(out)
    assert sorted(n for v in held.values() for _, n in v) == sorted(lengths)
    assert all(sum(n for _, n in v) <= 2048 for v in held.values())
    least = packing.lower_bound(np.array(lengths))
    assert len(held) <= (least if group > 1500 else least * 1.03)


def test_packed_documents(spark):
    import tokenizers

    model = tokenizers.Tokenizer.from_file(model_path())
    rows = awkward_rows() + [(900, "very long words " * 40_000, "en", "a", 0)]
    out = packing.pack_documents(with_clashes(spark.createDataFrame(rows, SCHEMA)), model_path()).cache()
    want = Counter()
    for doc, text, *_ in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            piece = np.array(ids[at:at + 2048], "<u4").tobytes()
            want[(doc, at // 2048, at, len(piece) // 4, piece, zlib.crc32(piece))] += 1
    assert Counter((r.id, r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32) for r in out.collect()) == want
    held = places(out)
    assert len(held) == packing.lower_bound(np.array([k[3] for k in want.elements()]))
    assert packing.pack_documents(empty(spark), model_path()).count() == 0


def test_shard_sums_agree_with_a_table():
    table = pa.table({"depth": [1, 2, 2, 1], "a": [5, 6, 7, 5], "b": [0, 0, 0, 0], "up_a": [0, 5, 5, 0], "up_b": [0, 0, 0, 0],
                      "n_leaves": [0, 1, 1, 0], "saved": [10, 1, 2, 0], "owned": [1, 1, 1, 0],
                      "linked": [True] * 4})
    got = {(r["depth"], r["a"]): (r["n_leaves"], r["saved"], r["n_children"]) for r in prefix_trie.add_up(table).to_pylist()}
    assert got == {(0, 0): (2, 13, 1), (1, 5): (2, 13, 2), (2, 6): (1, 1, 0), (2, 7): (1, 2, 0)}


def test_words_are_coded_once_whatever_signs_follow():
    import tokenizers

    model = tokenizers.Tokenizer.from_file(model_path())
    with open(model_path()) as f:
        table = packing.WordIds(f.read())
    assert table.letters is not None
    coded = []
    plain = table.coded
    table.coded = lambda by, words: coded.extend(words) or plain(by, words)
    texts = ["Word word, word! word... (word) word's 'word' né, Ⱥb Ⱥb; İx, ǅ! ½a a½. x1, 1x.", "word?! ÉTÉ!! été' it's, 'S's word"]
    for text, ids in zip(texts, table.encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == model.encode(text, add_special_tokens=False).ids
    assert coded.count("word") == 1 and "word," not in coded and "word..." not in coded
