"""Repeated passages: paragraph MinHash banding, exact verification and components.

A paragraph is a line of a text. Python reads a text once: it names the lines, signs those of a
shingle or more with MinHash values cut into bands, and names the pieces below. The bands are tuned so
that a pair at the threshold is missed less than once in a hundred times. Equal paragraphs are one.
Paragraphs that share a band are compared with the first of the band by exact Jaccard similarity, and
those that do not reach the threshold there with the first among themselves. What is left of a band that
holds such a paragraph is compared where two of them share one of their rarest shingles, as sets of that
similarity must, with enough behind it, and are not in one class yet: first with a few drawn for each such
shingle, then with all; so no link between classes is lost and copies of one passage do not make all pairs. Only lines that share a band are read once more
for their shingles. Components of the links are the classes, and all but the first paragraph of a class go.

Passages inside longer or differing lines are found by pieces of the text as one run of words. A
word is a border if the hash of it and the next is the least among its neighbours, so borders move
with the words around them. From every border a piece goes to the first border ``PIECE`` words on or
later; pieces overlap, and equal ones are found by their hash. What lies in pieces that also stand
earlier is cut.

Each step is written. Its shuffle files, and the tables that no later step reads, are deleted before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.llm.common import releasing, text_of
from trialweave.llm.components import components
from trialweave.session import drop_written, free_shuffles, ship_package, written

WORDS, SIMILARITY, LEAST_WORDS = 5, 0.8, 20
SIGNATURE, MISSED = 40, 0.01
#: Least words of a piece, and the words on either side that decide on a border. A repeated run of 50
#: random words holds a whole piece in 99.8 of 100 cases.
PIECE, SIDE = 20, 3
#: Words that are signed at once, and lines or pieces in one row; longer texts give several rows.
AT_ONCE, IN_A_ROW = 1 << 17, 1 << 16
#: Names that are drawn to stand for all that share a rare shingle; they change no result. All are
#: compared at once: each search for classes costs many small exchanges.
DRAWS = 3


def bands_for(similarity: float, hashes: int, missed: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band at which a pair of that similarity is missed at most
    that often; more rows let fewer dissimilar pairs through."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if (1 - similarity ** rows) ** bands <= missed:
            return bands, rows
    return hashes, 1


_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, 256, np.uint64)


def signatures(shingles: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """(hashes, paragraphs): for each hash the least value among the paragraph's shingles."""
    out = np.empty((hashes, len(starts)), np.uint64)
    for i in range(hashes):
        # Multiplication carries upwards only, so the high half is compared.
        x = shingles * _A[i] + _B[i]
        out[i] = np.minimum.reduceat(x ^ x >> np.uint64(32), starts)
    return out


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, h, text): id and hash of the text name a row, so rows of one id or of none stay apart.

    Rows equal in both are copies and have equal names; a null id is the same as ``NO_ID``.
    """
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def _step(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``df`` written; its shuffle files and the tables ``done``, which only it had still to read, are deleted."""
    out = written(df, name)
    drop_written(*done)
    free_shuffles(df.sparkSession)
    return out


class Words(NamedTuple):
    """Words of a text with A-Z in lower case: their hashes and lines, and where they start in ``joined``."""

    one: np.ndarray
    line: np.ndarray
    n_lines: int
    joined: bytes
    offset: np.ndarray

    def names(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each run of words."""
        import xxhash

        return np.fromiter((xxhash.xxh64_intdigest(self.joined[x:y]) for x, y in zip(
            self.offset[first].tolist(), (self.offset[end] - 1).tolist())), np.uint64, len(first)).view(np.int64)


def words_of(text: str | None) -> Words:
    import xxhash

    lines = [x.split() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    tokens = [w for x in lines for w in x]
    return Words(np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)),
                 np.repeat(np.arange(len(lines), dtype=np.int32), [len(x) for x in lines]), len(lines),
                 b" ".join(tokens), np.cumsum([0, *[len(w) + 1 for w in tokens]]))


def lines_of(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end): the words of each line that has ``least`` words or more."""
    first = np.flatnonzero(np.diff(w.line, prepend=np.int32(-1)))
    end = np.append(first, len(w.line))[1:]
    long = end - first >= least
    return first[long], end[long]


def shingles_of(w: Words, first: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of lines one after the other, repeats included, and their number in each.

    Lines under ``n`` words have none.
    """
    sizes = np.maximum(end - first - (n - 1), 0)
    total = len(w.one) - n + 1
    if not sizes.sum():
        return np.zeros(0, np.uint64), sizes
    run = np.zeros(total, np.uint64)
    for j in range(n):
        run += w.one[j:total + j] * _A[j]
    run = (run ^ run >> np.uint64(32)) * _B[0]
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return run[at], sizes


LINES = "array<struct<line:int,name:bigint,bands:array<bigint>>>"
PIECES = "array<struct<name:bigint,at:int,n:int,first_line:int,last_line:int>>"
CUT = f"k bigint, h bigint, part int, n_paragraphs bigint, n_words bigint, lines {LINES}, pieces {PIECES}"


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def cut_texts(keyed: DataFrame, words: int, least_words: int, bands: int, rows: int, pieces: bool) -> DataFrame:
    """``CUT`` of ``keyed_rows``: lines of ``least_words`` words or more with their bands, and pieces if asked for.

    A row holds ``IN_A_ROW`` lines and pieces at most; the rows of a longer text are counted by ``part``.
    """
    def batch_of(cuts: list[tuple]) -> pa.RecordBatch:
        sizes = np.concatenate([c[7] for c in cuts])
        signed = sizes > 0
        keys = np.zeros((bands, int(signed.sum())), np.uint64)
        if keys.size:
            some = sizes[signed]
            sign = signatures(np.concatenate([c[6] for c in cuts]), np.cumsum(some) - some, bands * rows)
            for i in range(bands * rows):
                keys[i // rows] = (keys[i // rows] ^ sign[i]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= np.arange(bands, dtype=np.uint64)[:, None]
        lines = _struct(line=pa.array(np.concatenate([c[4] for c in cuts]), pa.int32()),
                        name=pa.array(np.concatenate([c[5] for c in cuts])),
                        bands=_lists((signed * bands).tolist(), pa.array(keys.T.ravel().view(np.int64))))
        kinds = dict(zip(("name", "at", "n", "first_line", "last_line"), zip(*[c[8] for c in cuts])))
        found = _struct(**{n: pa.array(np.concatenate(x)) for n, x in kinds.items()})
        out, n_lines, n_pieces = [], [], []
        for k, h, n_paragraphs, n_words, line, *_, own in cuts:
            most = max(len(line), len(own[0]), 1)
            for part, a in enumerate(range(0, most, IN_A_ROW)):
                out.append((k, h, part, n_paragraphs, n_words))
                n_lines.append(min(max(len(line) - a, 0), IN_A_ROW))
                n_pieces.append(min(max(len(own[0]) - a, 0), IN_A_ROW))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), types)] + [_lists(n_lines, lines), _lists(n_pieces, found)],
            names=["k", "h", "part", "n_paragraphs", "n_words", "lines", "pieces"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, held = [], 0
        for batch in batches:
            ids, hashes, texts = (batch.column(c) for c in ("k", "h", "text"))
            for i in range(batch.num_rows):
                w = words_of(texts[i].as_py())
                first, end = lines_of(w, least_words)
                cuts.append((ids[i].as_py(), hashes[i].as_py(), w.n_lines, len(w.one), w.line[first], w.names(first, end),
                             *shingles_of(w, first, end, words), pieces_in(w) if pieces else NO_PIECES))
                held += len(w.one) + 64
                if held > AT_ONCE:
                    yield batch_of(cuts)
                    cuts, held = [], 0
        if cuts:
            yield batch_of(cuts)

    ship_package(keyed.sparkSession)
    return written(keyed.mapInArrow(run, CUT), "passage-cuts", codec="zstd")


def _shingled(keyed: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(name, shingles) of ``wanted`` (name, k, h, line): the set of a line's shingles, read from its text."""
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, want = batch.column("text"), batch.column("want")
            for i in range(batch.num_rows):
                w = words_of(texts[i].as_py())
                first, end = lines_of(w, words)
                by_line = {n: j for j, n in enumerate(w.line[first].tolist())}
                at = [(x["name"], by_line[x["line"]]) for x in want[i].as_py()]
                some = np.array([j for _, j in at])
                runs, sizes = shingles_of(w, first[some], end[some], words)
                sets = [np.unique(x).view(np.int64) for x in np.split(runs, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in at], pa.int64()),
                     _lists([len(x) for x in sets], pa.array(np.concatenate(sets)))], names=["name", "shingles"])

    lists = wanted.groupBy("k", "h").agg(F.collect_list(F.struct("line", "name")).alias("want"))
    found = (keyed.join(lists, ["k", "h"]).select("text", "want")
             .mapInArrow(run, "name bigint, shingles array<bigint>"))
    return _step(found.dropDuplicates(["name"]), "passage-shingles")  # copies of a row give their lines again


def _similar(pairs: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b, ...) with ``near``: whether their Jaccard similarity reaches the threshold."""
    side = lambda n: shingled.select(F.col("name").alias(n), F.col("shingles").alias(f"s{n}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .withColumn("near", both >= similarity * (F.size("sa") + F.size("sb") - both)).drop("sa", "sb"))


def _rare_shingles(judged: DataFrame, members: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """(name, rest, n, bands, shingle, alone) of the bands that hold a name not near their first, which is ``alone``.

    Of sets ordered by how rare their shingles are, two that reach the similarity share one of the first
    n - ceil(similarity n) + 1. ``rest`` counts the shingles from this one on.
    """
    failed = judged.filter("not near").select(F.col("a").alias("name"), F.col("b").alias("lead"))
    alone = failed.select("name", F.lit(True).alias("alone")).distinct()
    bands = members.join(failed, ["name", "lead"], "left_semi").select("band").distinct()
    # A name has as many bands as a signature at most.
    opened = _step(members.join(bands, "band", "left_semi").groupBy("name")
                   .agg(F.collect_set("band").alias("bands")), "passage-opened")
    sets = (shingled.join(opened, "name", "left_semi")
            .select("name", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    sets = _step(sets, "passage-open")
    often = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    # Rounded, so that whole numbers stay whole.
    least = F.ceil(F.round(F.lit(similarity) * F.col("n"), 7))
    first = F.slice("s", F.lit(1), (F.col("n") - least + 1).cast("int"))
    return _step(
        sets.join(often, "shingle").groupBy("name", "n")
        .agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("s"))
        .select("name", "n", F.posexplode(first).alias("at", "s")).filter("s.times > 1")
        .join(opened, "name").join(alone, "name", "left")
        .select("name", (F.col("n") - F.col("at")).alias("rest"), "n", "bands", F.col("s.shingle").alias("shingle"),
                F.coalesce("alone", F.lit(False)).alias("alone")), "passage-rare", sets, opened)


def _rare_pairs(rare: DataFrame, roots: DataFrame, similarity: float, draw: int | None = None) -> DataFrame:
    """(a, b) that share a rare shingle and a band, one of them alone, and may be near by exact bounds.

    What two sets share lies from the first such shingle on, so as much as the similarity asks for must
    follow it in both. Pairs within one class of ``roots`` would add nothing and are left out. With
    ``draw``, ``b`` is one name for each shingle, drawn among those that have the most behind it.
    """
    rows = (rare.join(roots.withColumnRenamed("node", "name"), "name", "left")
            .withColumn("root", F.coalesce("root", "name")))
    side = lambda x, n: x.select("shingle", *[F.col(c).alias(f"{c}_{n}") for c in rows.columns if c != "shingle"])
    if draw is None:
        one, other = rows.filter("alone"), rows
    else:
        drawn = rare.groupBy("shingle").agg(F.min(
            F.struct(F.col("n") - F.col("rest"), F.xxhash64("name", F.lit(draw)), "name")).alias("x"))
        one, other = rows, rows.join(drawn.select("shingle", F.col("x.name").alias("name")), ["shingle", "name"])
    both = similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b"))
    return (side(one, "a").join(side(other, "b"), "shingle")
            .filter((F.col("root_a") != F.col("root_b")) & (F.col("alone_a") | F.col("alone_b"))
                    & (F.least("rest_a", "rest_b") >= both - 1e-7) & F.arrays_overlap("bands_a", "bands_b"))
            .select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")))


def _joined(links: DataFrame, judged: DataFrame) -> DataFrame:
    return links.unionByName(judged.filter("near").select("a", "b"))


def passage_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY,
                    least_words: int = LEAST_WORDS, hashes: int = SIGNATURE, missed: float = MISSED,
                    id_col: str = "doc_id", text_col: str = "text", cuts: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, line, class_id, first) for each paragraph that has an equal or near one elsewhere.

    ``class_id`` is the id of the smallest document with a paragraph of the class, and ``first`` is
    true for the earliest paragraph of each class by (doc_id, h, line), null ids last; ``h`` is the hash
    of the row's text. Rows equal in id and text are copies of one place and are all marked alike.
    Paragraphs under ``least_words`` words are left alone: 20 keeps licence lines and the like, 1 takes every line
    that has a word. Null and empty texts have none. Other columns are not read. ``cuts`` may hand in what
    ``cut_texts`` has made of these documents with the same settings.
    """
    keyed = keyed_rows(docs, id_col, text_col)
    if cuts is None:
        cuts = cut_texts(keyed, words, least_words, *bands_for(similarity, hashes, missed), pieces=False)
    rows = cuts.select("k", "h", F.explode("lines").alias("x")).select("k", "h", "x.line", "x.name", "x.bands")
    lines = _step(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first"),
                                           F.first("bands").alias("bands")), "passage-lines")
    banded = lines.select("name", F.explode("bands").alias("band"))
    # Bands alone are counted: names are added once it is known that a band has several.
    shared = _step(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "passage-several")
    found = _step(banded.join(shared, "band"), "passage-shared", shared)
    members = _step(found.join(found.groupBy("band").agg(F.min("name").alias("lead")), "band"), "passage-bands", found)
    wanted = (lines.join(members.select("name").distinct(), "name", "left_semi")
              .select("name", "first.k", "first.h", "first.line"))
    shingled = _shingled(keyed, wanted, words)

    done = [lines, members, shingled]

    def kept(table: DataFrame) -> DataFrame:
        done.append(table)
        return table

    def judge(pairs: DataFrame) -> DataFrame:
        return kept(_step(_similar(pairs.distinct(), shingled, similarity), "passage-stars"))

    judged = judge(members.filter("name <> lead").select(F.col("name").alias("a"), F.col("lead").alias("b")))
    # Of what is not near the first of its band, the first stands for the others once more.
    failed = judged.filter("not near").select(F.col("a").alias("name"), F.col("b").alias("lead"))
    left = kept(_step(members.join(failed, ["name", "lead"], "left_semi").select("name", "band"), "passage-left"))
    second = left.groupBy("band").agg(F.min("name").alias("b"))
    again = judge(left.withColumnRenamed("name", "a").join(second, "band").filter("a <> b").select("a", "b"))
    links = _joined(judged.filter("near").select("a", "b"), again)
    roots = kept(written(components(links), "passage-roots"))
    if not left.isEmpty():
        rare = kept(_rare_shingles(judged, members, shingled, similarity))
        # Drawn ones first, which join most of a group of near copies by few pairs; then all that is left.
        drawn = [_rare_pairs(rare, roots, similarity, draw) for draw in range(DRAWS)]
        links = _joined(links, judge(reduce(DataFrame.unionByName, drawn)))
        roots = kept(written(components(links), "passage-roots"))
        links = _joined(links, judge(_rare_pairs(rare, roots, similarity, None)))
        roots = kept(written(components(links), "passage-roots"))
    named = (lines.select("name", "n", "first").join(roots.withColumnRenamed("node", "name"), "name", "left")
             .filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "name")))
    classes = named.groupBy("root").agg(F.sum("n").alias("n"), F.min("first").alias("head")).filter("n > 1")
    by_name = _step(named.select("name", "root").join(classes, "root").select("name", "head"), "passage-names", *done)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (rows.select("k", "h", "line", "name").join(by_name, "name")
            .select(known("k").alias("doc_id"), "h", "line", known("head.k").alias("class_id"),
                    (_place() == F.col("head")).alias("first")))


NO_ID = (1 << 63) - 1


def _place() -> Column:
    return F.struct("k", "h", "line")


NO_PIECES = tuple(np.zeros(0, t) for t in (np.int64, *[np.int32] * 4))


def pieces_of(text: str | None) -> tuple[np.ndarray, ...]:
    """(name, at, n, first_line, last_line) of the pieces: ``n`` words from word ``at`` on."""
    return pieces_in(words_of(text))


def pieces_in(w: Words) -> tuple[np.ndarray, ...]:
    if len(w.one) < PIECE:
        return NO_PIECES
    pair = w.one[:-1] * _A[0] + w.one[1:] * _A[1]
    pair ^= pair >> np.uint64(32)
    least = pair.copy()
    for d in range(1, SIDE + 1):
        np.minimum(least[d:], pair[:-d], out=least[d:])
        np.minimum(least[:-d], pair[d:], out=least[:-d])
    borders = np.unique(np.concatenate([[0], np.flatnonzero(pair == least), [len(w.one)]]))
    stop = np.searchsorted(borders, borders + PIECE)
    whole = stop < len(borders)
    at, end = borders[whole], borders[stop[whole]]
    return (w.names(at, end), at.astype(np.int32), (end - at).astype(np.int32), w.line[at], w.line[end - 1])


def repeated_spans(cuts: DataFrame, removed: DataFrame) -> DataFrame:
    """(k, h, spans): runs of words, first word and number, in pieces that also stand earlier.

    ``cuts`` are texts cut with pieces. ``k`` and ``h`` name a row as in ``keyed_rows``; earlier is a smaller (k, h), or the same and an
    earlier word. A piece that touches a line of ``removed`` (k, h, removed) is not the earlier one of
    another, so every word that is cut stays at some earlier place. Rows equal in id and text are one
    place here. Null and empty texts and those under ``PIECE`` words have no piece and give no row.
    """
    pieces = cuts.select("k", "h", F.explode("pieces").alias("x")).select("k", "h", "x.*")
    # As with bands, names alone are counted, and their shuffle files are gone before the rest is exchanged.
    several = _step(pieces.groupBy("name").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("name"), "pieces-several")
    repeated = _step(pieces.join(several, "name"), "pieces-repeated", several)
    touched = F.exists("removed", lambda x: x.between(F.col("first_line"), F.col("last_line")))
    place = F.struct("k", "h", "at")
    earliest = (repeated.join(removed, ["k", "h"], "left").filter(~F.coalesce(touched, F.lit(False)))
                .groupBy("name").agg(F.min(place).alias("earliest")))
    cut = repeated.join(earliest, "name").filter(place > F.col("earliest")).groupBy("k", "h", "at").agg(
        (F.col("at") + F.max("n")).alias("end"))
    before = W.partitionBy("k", "h").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    fresh_run = F.coalesce((F.col("at") > F.max("end").over(before)).cast("int"), F.lit(1))
    runs = (cut.withColumn("start", fresh_run)
            .withColumn("run", F.sum("start").over(W.partitionBy("k", "h").orderBy("at")))
            .groupBy("k", "h", "run").agg(F.min("at").alias("first"), F.max("end").alias("end")))
    return runs.groupBy("k", "h").agg(F.array_sort(F.collect_list(
        F.struct("first", (F.col("end") - F.col("first")).alias("words")))).alias("spans"))


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: bool = False,
                     **options) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_paragraphs``, ``n_removed``, ``removed`` and ``classes``.

    ``removed`` lists the lines to remove, all of their class but the first; ``classes`` lists the
    classes of all of the document's repeated paragraphs. Rows of one id with different texts, and rows
    without an id, are documents of their own. Of rows equal in id and text one has the lists of its place;
    the others are copies of it and lose all paragraphs, and with ``pieces`` all words if ``PIECE`` or more.
    With ``pieces``, ``spans`` lists the runs of words, counted over the whole text from 0, of passages that
    stand in an earlier place of the corpus, whatever the lines there.
    """
    bands = bands_for(options.get("similarity", SIMILARITY), options.get("hashes", SIGNATURE), options.get("missed", MISSED))
    cuts = cut_texts(keyed_rows(docs, id_col, text_col), options.get("words", WORDS),
                     options.get("least_words", LEAST_WORDS), *bands, pieces=pieces)
    found = (passage_classes(docs, id_col=id_col, text_col=text_col, cuts=cuts, **options)
             .groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "h")
             .agg(F.array_sort(F.collect_set(F.when(~F.col("first"), F.col("line")))).alias("removed"),
                  F.array_sort(F.collect_set("line")).alias("repeated"),
                  F.array_sort(F.collect_set("class_id")).alias("classes")))
    found = _step(found, "passages-removed")
    if pieces:
        spans = repeated_spans(cuts, found.select("k", "h", "removed"))
    own = (cuts.filter("part = 0").groupBy("k", "h", "n_paragraphs", "n_words")
           .agg(F.count(F.lit(1)).alias("copies")))
    out = own.join(found, ["k", "h"], "left")
    none = F.array().cast("array<struct<first:int,words:int>>")
    if pieces:
        out = out.join(spans, ["k", "h"], "left")
        whole = F.when(F.col("n_words") >= PIECE, F.array(
            F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("words")))).otherwise(none)
        out = out.withColumn("spans", F.coalesce("spans", none)).withColumn("all_words", whole)
    again = F.col("copy") > 1
    out = (out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
           .withColumn("removed", F.coalesce(F.when(again, F.col("repeated")).otherwise(F.col("removed")),
                                             F.array().cast("array<int>"))))
    more = [F.when(again, F.col("all_words")).otherwise(F.col("spans")).alias("spans")] if pieces else []
    return out.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias(id_col), "n_paragraphs",
        F.size("removed").cast("long").alias("n_removed"), "removed",
        F.coalesce("classes", F.array().cast("array<bigint>")).alias("classes"), *more)


def query(spark, sf_dir: str) -> DataFrame:
    return removed_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), least_words=1, pieces=True)
