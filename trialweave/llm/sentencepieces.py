"""SentencePiece encoding and decoding with a table of distinct marked chunks.

The library writes a mark in front of the text and in place of every space. Where no piece of the
vocabulary has a mark after another character, no merge crosses the start of a run of marks, so a
text is the sequence of its marked chunks (a run of marks and what follows it) and each distinct
chunk has to be segmented only once. Tasks keep a table of the first chunks they have met, segment
the distinct missing ones of many documents in one call, and join the ids back by position. A table
over the whole corpus would have to shuffle every word of every document, several times the size of
the input; the table of a task shuffles nothing and takes no more chunks when it is full.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import releasing, slices, with_text, without
from trialweave.session import ship_package

MARK = "▁"
CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")
#: Chunks that a task keeps; memory of a task is bounded by this, not by the input.
TABLE = 200_000


def chunks_of(text: str) -> list[str]:
    """The marked chunks of a text, each without its first mark."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return CHUNK.findall(MARK + text.replace(" ", MARK))
    return text.split(" ")


class ChunkTable:
    """Ids of the distinct marked chunks of texts, exactly as the library gives them."""

    def __init__(self, model: bytes, limit: int = TABLE) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a whitespace mark; chunks cannot be segmented alone")
        probe = "  two  marks \n end "
        self.limit, self.ids = limit, {}
        if self.encode(probe) != self.model.encode(probe, add_eos=True):
            raise ValueError("the model changes white space; chunks cannot be segmented alone")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text, the end id last."""
        split, end = [chunks_of(t) for t in texts], array("i", [self.model.eos_id()]).tobytes()
        # The chunks of these texts alone, as a small table is faster to ask again and again.
        chunks = set().union(*split)
        here = dict(zip(chunks, map(self.ids.get, chunks)))
        missing = [c for c, ids in here.items() if ids is None]
        # The library puts the first mark back itself, except before an empty text.
        new = {c: array("i", ids if c else [self.model.piece_to_id(MARK)]).tobytes()
               for c, ids in zip(missing, self.model.encode(missing, num_threads=1))}
        here |= new
        self.ids.update(itertools.islice(new.items(), max(0, self.limit - len(self.ids))))
        return [np.frombuffer(b"".join([*map(here.__getitem__, cs), end]), np.int32) for cs in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int, the end id last) and ``decoded`` (string).

    Null texts are empty: the end id only, decoded to an empty text. Repeated rows and columns of
    any name pass through; ``ids`` and ``decoded`` are replaced. Texts of any length are encoded
    whole. Nothing is shuffled. The model is read once on the driver and sent to the tasks.
    """
    ship_package(docs.sparkSession)
    docs = without(docs, *({"ids", "decoded"} - {text_col}))
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    docs, plain, added = with_text(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model.value)
        for whole in batches:
            for batch in slices(whole, whole.schema.names.index(plain)):
                at = batch.schema.names.index(plain)
                coded = table.encode_all([t or "" for t in batch.column(at).to_pylist()])
                ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, coded)], dtype=np.int32), np.concatenate(coded))
                rest = [i for i in range(batch.num_columns) if i != at or not added]
                decoded = pa.array([table.decode(x.tolist()) for x in coded], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in rest), ids, decoded],
                    names=[*(batch.schema.names[i] for i in rest), "ids", "decoded"])

    return docs.mapInArrow(releasing(run), f"{schema}, ids array<int>, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
