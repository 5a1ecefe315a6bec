"""Small tables with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import types as T

SPACE = r"[^\x20\x09-\x0D]+"
PASSAGE = " ".join(f"pass{i}age{i * 7 % 13}" for i in range(60))
CLASHING = ("size", "score", "shard", "slot", "batch", "k", "h", "n", "key", "kind", "part", "rank", "uid",
            "plain_text", "copies", "target", "fp", "ids", "kept")


def words(text):
    return re.findall(SPACE, text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empties, repeats, ties, a very long text."""
    rng = random.Random(5)
    some = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    base = some(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   ", "\n", "one", "one two", some(3000) + "\n" + some(9000), base, base, " ".join(near),
             some(40) + "\n" + PASSAGE, PASSAGE + "\n" + some(30), some(50) + PASSAGE + some(5), "a" * 500,
             "ab" * 300, "日本 語 🎉 " * 40, "The THE the " * 50, "x\ty\x0bz\r\n q", "▁ ▁▁ \x00 ", base.upper()]
    rows = [(i * 3 % 61, t, ("en", "fr", None)[i % 3], ("src1", "src0", None, "é")[i % 4], 0)
            for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[4], (None, base, "en", "src1", 0), (None, None, None, None, None)]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def unique_rows():
    """The awkward rows with an id each."""
    return [(i, *r[1:]) for i, r in enumerate(awkward_rows())]


def unique(spark):
    return spark.createDataFrame(unique_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASHING})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def simhash_by_bits(text, n=4):
    w = words(lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(n, near):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def without_repeats(texts, length=100):
    """(bytes, removed, spans, kept) of texts in the order of their documents."""
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                covered[s:s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out.append((len(b), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), kept))
    return out
