"""Packing of token sequences: best-fit decreasing in partitions, certified by lower bounds.

Pieces are dealt to partitions of about ``GROUP_ROWS`` pieces. Each partition is packed by best-fit
decreasing, and dual-feasible functions give a number of bins that no packing of it can undercut.
Where both agree the partition is certified and gives up only its emptiest bin; where a gap is left
it gives up the emptier half of its bins. What was given up is exchanged, that is dealt anew, and
packed again, until one partition takes all of it. A round that would need more bins than it
replaces is not used. The bins that are kept never move again, so the rounds shrink.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import releasing, slices, text_of
from trialweave.session import ship_package, written

CAPACITY = 2048
#: Pieces of a partition.
GROUP_ROWS = 50_000
#: Words that a Python worker keeps with their ids.
TABLE = 800_000
#: Thresholds of the stepwise dual-feasible functions.
STEPS = range(1, 33)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Text that cannot be put in lower case or split by Python as the tokenizer does it: separators that
#: the tokenizer keeps, and characters from the combining ones on.
UNUSUAL = re.compile("[\x1c-\x1f̀-\U0010ffff]|<[|]")
SIGNS = string.punctuation
#: What a tokenizer may do before it merges bytes that leaves letters in lower case, below the combining ones, as they are.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PACKED = "uid long, length long, sequence_id long, offset long, open boolean"


def unusual(text: str) -> bool:
    """Whether ``UNUSUAL`` is in the text; most texts need no search for that."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(UNUSUAL.search(text))
    return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")


class WordIds:
    """Ids of texts, as bytes of four each, by a table of the words met so far.

    The tokenizer drops white space and nothing in it looks across white space, so words are
    encoded on their own; it lowers all letters, so usual texts are lowered first. Where it cuts
    between letters and the signs behind them, those are encoded apart, so that a word is encoded
    once whatever signs follow it; and lowered letters alone go to its byte pairs directly.
    """

    def __init__(self, model: str, limit: int = TABLE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.model, self.limit, self.ids = tokenizers.Tokenizer.from_str(model), limit, {}
        probe = "It's  a\tTest, é <|x|>\n1234"
        if self.exact(probe) != b"".join(map(self.exact, probe.split())) or self.exact(probe) != self.exact(probe.lower()):
            raise ValueError("the tokenizer looks at white space or case; words cannot be encoded alone")
        steps = json.loads(model)
        self.letters = None
        if ((steps.get("normalizer") or {}).get("normalizers") == NORMALIZERS
                and (steps.get("pre_tokenizer") or {}).get("pretokenizers") == [SPLIT, BYTES] and not steps.get("post_processor")):
            self.letters = tokenizers.Tokenizer(self.model.model)
            self.letters.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def exact(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def each(self, words: set[str]) -> dict[str, bytes]:
        return self.coded(self.model, list(words))

    def coded(self, model, words: list[str]) -> dict[str, bytes]:
        coded = model.encode_batch_fast(words, add_special_tokens=False)
        return {w: array("I", e.ids).tobytes() for w, e in zip(words, coded)}

    def each_lowered(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words of usual texts that are not in the table, and of the parts that they are cut into."""
        if self.letters is None:
            return self.each(words)
        parts = {w: (a, w[len(a):]) for w in words
                 if not w.isalpha() and (a := w.rstrip(SIGNS)).isalpha() and len(a) < len(w)}
        whole = words.difference(parts).union(*parts.values()).difference(self.ids)
        letters = [w for w in whole if w.isalpha()]
        new = self.coded(self.letters, letters) | self.each(whole.difference(letters))
        of = lambda w: new[w] if w in new else self.ids[w]
        return new | {w: of(a) + of(b) for w, (a, b) in parts.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [unusual(t) for t in texts]
        split = [WORD.findall(t) if o else t.lower().split() for t, o in zip(texts, odd)]
        # The words of these texts alone, as a small table is faster to ask again and again.
        words = set().union(*split)
        here = dict(zip(words, map(self.ids.get, words)))
        missing = {w for w, ids in here.items() if ids is None}
        raw = missing & set().union(*(ws for ws, o in zip(split, odd) if o))
        new = self.each(raw)
        new |= self.each_lowered(missing - raw)
        here |= new
        if len(self.ids) + len(new) <= self.limit:
            self.ids |= new
        return [b"".join(map(here.__getitem__, ws)) for ws in split]


_tables: dict[int, WordIds] = {}


def word_ids(model: str) -> WordIds:
    """The table of this Python worker; it outlives a task and is bounded by ``TABLE``."""
    key = hash(model)
    if key not in _tables:
        _tables.clear()
        _tables[key] = WordIds(model)
    return _tables[key]


def tokenized_pieces(docs: DataFrame, model_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids (bytes of four each, little-endian), ids_crc32.

    A document is its ids and the end id. Null texts are empty: one piece, the end id. Repeated rows
    are documents of their own. The model is read on the driver; nothing is shuffled.
    """
    ship_package(docs.sparkSession)
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    end, most = np.uint32(end_id).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(model.value)
        for whole in batches:
            for batch in slices(whole, 1):
                of, piece, start, ids = [], [], [], []
                for row, coded in enumerate(table.encode(batch.column(1).to_pylist())):
                    coded += end
                    for i, at in enumerate(range(0, len(coded), most)):
                        of.append(row)
                        piece.append(i)
                        start.append(at // 4)
                        ids.append(coded[at:at + most])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                    names=["id", "piece", "start", "length", "ids", "ids_crc32"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(releasing(run), f"id {kind}, piece int, start long, length long, ids binary, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these lengths (1 to ``capacity``) needs, by dual-feasible functions.

    The plain sum; for every threshold t up to half the capacity, lengths above ``capacity - t``
    count as whole bins and lengths below t as nothing; and the stepwise functions, where a length
    that is no multiple of ``capacity / (k + 1)`` is rounded down to one and divided by k.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(0, capacity // 2 + 1)
    middle = total[capacity - t + 1] - total[t]
    best = int((number[-1] - number[capacity - t + 1] - (-middle // capacity)).max())
    for k in STEPS:
        scaled = size * (k + 1)
        # In units of 1 / (k * capacity), so that everything stays an integer.
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-(value * count).sum() // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in descending order of length, and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    # Bins by the room they have left, and a bit mask of the rooms for which there are any.
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        where[i], offset[i], left[b] = b, capacity - room, room - length
        if left[b]:
            by_room[left[b]].append(b)
            rooms |= 1 << left[b]
    return where, offset, np.array(left, np.int64)


def pack_group(round_: int, capacity: int, final: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        lengths = table.column("length").to_numpy()
        where, offset, left = best_fit(lengths, capacity)
        given_up = np.zeros(len(left), bool)
        if not final:
            certified = len(left) == lower_bound(lengths, capacity)
            emptiest = np.argsort(-left, kind="stable")
            given_up[emptiest[:1 if certified else max(1, len(left) // 2)]] = True
        start = round_ << 56 | table.column("deal")[0].as_py() << 24
        return pa.table({"uid": table.column("uid"), "length": table.column("length"),
                         "sequence_id": pa.array(start + where), "offset": pa.array(offset), "open": pa.array(given_up[where])})
    return run


def packed(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(uid, length), each uid once, lengths 1 to ``capacity`` -> uid, sequence_id, offset.

    Every uid is placed once; the offsets of a sequence are gapless from 0. Equal rows give equal
    results. No rows: no sequences.
    """
    ship_package(pieces.sparkSession)
    whole = F.col("length") >= capacity
    done = pieces.filter(whole).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    free, before, round_ = pieces.filter(~whole).select("uid", "length"), None, 0
    bins = lambda df: df.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
    rows = free.count()
    while rows:
        groups = -(-rows // group_rows)
        deal = F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)).alias("deal")
        now = written(free.select("uid", "length", deal).groupBy("deal")
                      .applyInArrow(pack_group(round_, capacity, groups == 1), PACKED), "packing-round")
        if before is not None and bins(now)[1] > bins(before)[1]:
            return done.unionByName(before.select("uid", "sequence_id", "offset"))
        done = done.unionByName(now.filter("NOT open").select("uid", "sequence_id", "offset"))
        before = now.filter("open")
        free, rows, round_ = before.select("uid", "length"), before.count(), round_ + 1
    return done


def pack_documents(docs: DataFrame, model_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of the documents with their place: id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    Only documents of more than ``capacity`` tokens are cut. Null ids and texts, repeated rows and
    empty tables are fine, see ``tokenized_pieces``; columns other than id and text are not read.
    """
    pieces = written(tokenized_pieces(docs, model_path, capacity, id_col, text_col)
                     .withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    return pieces.join(packed(pieces.select("uid", "length"), capacity), "uid").drop("uid")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
