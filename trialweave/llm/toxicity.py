"""Toxicity of documents after undoing disguises of words.

1. A character trigram model is counted over all documents.
2. Words and beginnings of words that mark toxic documents are found in a bounded sample of labelled
   rows; the words also weigh on the character model.
3. Every document's disguised tokens are restored (``noisy_channel``), and a logistic regression
   over presence and rate of the marks in the restored text gives the score. It is fitted on the
   sample and weighted to the share of toxic rows among all labelled ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import releasing, slices, text_of, with_text, without
from trialweave.llm.noisy_channel import (PUNCTUATION, SIZE, SPACED_OUT, log_model, restored,
                                          trigram_counts, viterbi)
from trialweave.session import ship_package, written

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 6000
#: Marks of the model.
MARKS = 200
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Tokens whose marks a task remembers.
REMEMBERED = 200_000


def marks_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of ids that labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    marks: dict[str, int]
    characters: list[float]
    weights: np.ndarray
    intercept: float


class Reader:
    """Counts of the model's marks in the restored text of documents."""

    def __init__(self, marks: dict[str, int], characters: list[float]) -> None:
        self.marks, self.characters = marks, characters
        self.known = frozenset(m[1:] for m in marks if m[0] == "=")
        self.memory: dict[str, tuple[int, ...]] = {}

    def of_words(self, words: list[str]) -> tuple[int, ...]:
        marks = self.marks
        return tuple(marks[m] for w in words for m in marks_of(w) if m in marks)

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        """({mark: count}, tokens)."""
        text = text.lower()
        tokens = Counter(text.split())
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        out: dict[int, int] = {}
        single = 0
        for token, n in tokens.items():
            found = memory.get(token)
            if found is None:
                found = memory[token] = self.of_words(restored(token, self.characters, self.known))
            for m in found:
                out[m] = out.get(m, 0) + n
            if len(token) == 1:
                single += n
        if single > 2:
            for spread in SPACED_OUT.findall(text):
                for m in self.of_words(viterbi(spread, self.characters).split()):
                    out[m] = out.get(m, 0) + 1
        return out, tokens.total()

    def vector(self, text: str) -> np.ndarray:
        counts, total = self.counts(text)
        row = np.zeros(2 * len(self.marks), np.float32)
        for m, n in counts.items():
            row[m] = 1.0
            row[len(self.marks) + m] = min(1.0, 50.0 * n / total)
        return row


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all documents; the result is bounded by the alphabet."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 256):
                total += trigram_counts(texts.slice(at, 256).to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = (docs.select(text_of(text_col).alias("text")).mapInArrow(releasing(run), "gram bigint, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(SIZE ** 3, np.int64)
    for gram, n in rows:
        out[gram] = n
    return out


def find_marks(sample: DataFrame, most: int = MARKS, least: int = 3, lift: float = 3.0) -> dict[str, int]:
    """The words and beginnings that tell the toxic rows of (text, toxic) best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {t.strip(PUNCTUATION) for t in text.lower().split()}
                marks = {m for w in words if w.isalpha() for m in marks_of(w)}
                counts.update((m, toxic) for m in marks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in counts]), pa.array([t for _, t in counts], pa.int32()),
                 pa.array(list(counts.values()), pa.int64())], names=["mark", "toxic", "n"])

    size = {t: n for t, n in sample.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return {}
    bad, good = F.col("bad") / size[1], (F.col("good") + 0.5) / size[0]
    top = (
        sample.mapInArrow(releasing(run), "mark string, toxic int, n bigint").groupBy("mark")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
        .filter((F.col("bad") >= least) & (bad >= lift * good))
        .orderBy((F.col("bad") * F.log(bad / good)).desc(), "mark").limit(most).collect()
    )
    return {r["mark"]: i for i, r in enumerate(top)}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0,
                 rounds: int = 12) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on all but the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * beta
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None].astype(x.dtype)).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out.

    ``sample`` rows of each class at most, those of the smallest hash of their id, are fitted on;
    their weights restore the shares that all labelled rows have. Null labels are no labels, a
    row labelled twice has its higher label. With no labelled rows of one class, all scores are
    the share of toxic rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = (labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("label_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("label_id"))
             .groupBy("label_id").agg(F.max("toxic").alias("toxic")))
    share = {t: n for t, n in known.groupBy("toxic").count().collect()}
    chosen = None
    for t in (0, 1):
        part = known.filter(F.col("toxic") == t).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = written(docs.select(F.col(id_col).alias("label_id"), text_of(text_col).alias("text"))
                   .join(chosen, "label_id").select("label_id", "text", "toxic"), "toxicity-sample")
    marks = find_marks(rows)
    words = [m[1:] for m in marks if m[0] == "="]
    characters = log_model(character_counts(docs, text_col), words)
    total = sum(share.values())
    base = (share.get(1, 0) + 0.5) / (total + 1.0)
    if not marks:
        return Model({}, characters, np.zeros(0), float(np.log(base / (1 - base))))
    reader = spark.sparkContext.broadcast((marks, characters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(*reader.value)
        for batch in batches:
            vectors = [read.vector(t) for t in batch.column("text").to_pylist()]
            some = [np.flatnonzero(v) for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(some, pa.list_(pa.int32())),
                 pa.array([v[s] for v, s in zip(vectors, some)], pa.list_(pa.float32()))],
                names=["toxic", "at", "value"])

    # Bounded by the sample: one short row for each of its documents.
    fitted = rows.mapInArrow(releasing(run), "toxic int, at array<int>, value array<float>").collect()
    x = np.zeros((len(fitted), 2 * len(marks)), np.float32)
    for i, r in enumerate(fitted):
        x[i, r["at"]] = r["value"]
    y = np.array([r["toxic"] for r in fitted])
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    weight *= len(y) / weight.sum()
    return Model(marks, characters, *fit_logistic(x, y, weight))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on).

    Null texts count as empty and get the score of a text without any mark, as other texts without
    marks do. Texts of any length are read whole. Columns of any name pass through; columns named
    like the results are replaced.
    """
    ship_package(docs.sparkSession)
    docs = without(docs, *({"score", "predicted"} - {text_col}))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    docs, plain, added = with_text(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        read = Reader(m.marks, m.characters)
        weights, half = m.weights.tolist(), len(m.marks)

        def score(text: str) -> float:
            counts, total = read.counts(text)
            z = m.intercept + sum(weights[k] + weights[half + k] * min(1.0, 50.0 * n / total)
                                  for k, n in counts.items())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        for whole in batches:
            for batch in slices(whole, whole.schema.names.index(plain)):
                at = batch.schema.names.index(plain)
                rest = [i for i in range(batch.num_columns) if i != at or not added]
                scores = pa.array([score(t.as_py() or "") for t in batch.column(at)], pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in rest), scores],
                    names=[*(batch.schema.names[i] for i in rest), "score"])

    scored = docs.mapInArrow(releasing(run), f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
