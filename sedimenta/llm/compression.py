"""Quality classifier: which of two zstandard dictionaries, of good and of bad text, compresses a text better.

A text is cut into pieces of PIECE bytes, each compressed with the dictionary of good text (g bytes)
and with that of bad text (b bytes); a dictionary outweighs a piece's own content only in short pieces,
so a long text is judged throughout and not by its beginning. The normalised difference (b - g) / (b + g) alone
goes through a logistic calibration to a score from 0 to 1.

The fit reads whole texts of SAMPLE_ROWS labelled rows of each class at most. Null and empty texts have difference 0 and the
calibration's score for that. Rows repeat as they are; only doc_id and text are read, so further columns and their names don't
matter. With fewer than three labelled rows of one class every score is the share of good labels, or 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.tables import fold_of

PIECE = 1024
LEVEL = 3
#: Differences are some hundredths; the calibration sees them larger.
SCALE = 10.0
DICTIONARY_BYTES = 1 << 16
#: Labelled texts of each class that a fit reads at most, whole, those of the least hashes.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]  # of 1 and of the difference


def _pieces(data: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(data), PIECE):
        yield data[at : at + PIECE]


class _Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, data: memoryview) -> float:
        if not len(data):
            return 0.0
        good = bad = 0
        for piece in _pieces(data):
            good += len(self.by[0].compress(piece))
            bad += len(self.by[1].compress(piece))
        return (bad - good) / (bad + good)


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [bytes(p) for t in texts for p in _pieces(memoryview(t))]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short for the trainer: the texts themselves are the dictionary
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights by Newton's method, both classes weighing the same."""
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    penalty = np.full(x.shape[1], ridge / len(y))
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (share * (p - y)) + penalty * w)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> list[tuple[bytes, int]]:
    """At most rows whole texts of each class, by a hash of doc_id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"), F.xxhash64(F.lit("sample"), "doc_id").alias("_h"))
    known = known.where("_y = 0").orderBy("_h", "_id").limit(rows).unionAll(known.where("_y = 1").orderBy("_h", "_id").limit(rows))
    found = (
        docs.where(F.col("text").isNotNull()).select("doc_id", "text")
        .join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # 2 * rows at most
        .groupBy("_h", "_id", "_y").agg(F.min("text").alias("_text"))
        .collect()
    )
    return [(r["_text"].encode(), r["_y"]) for r in sorted(found, key=lambda r: (r["_h"], r["_id"], r["_y"]))]


def train(rows: list[tuple[bytes, int]]) -> Model:
    """Two of three texts make the dictionaries, the rest, which these don't know, the calibration. Both classes weigh alike."""
    parts = {y: [t for t, label in rows if label == y] for y in (0, 1)}
    if min(len(parts[0]), len(parts[1])) < 3:
        share = min(max(len(parts[1]) / len(rows) if rows else 0.5, 0.01), 0.99)
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0))
    good, bad = (_dictionary([t for i, t in enumerate(parts[y]) if i % 3]) for y in (1, 0))
    sizes = _Sizes(good, bad)
    held = [(sizes.difference(memoryview(t)), y) for y in (0, 1) for t in parts[y][::3]]
    x = np.array([(1.0, d * SCALE) for d, _ in held])
    bias, slope = logistic(x, np.array([y for _, y in held]))
    return Model(good, bad, (float(bias), float(slope * SCALE)))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> Model:
    keep = F.lit(True) if keep is None else keep
    model = train(labelled(docs, labels, "quality", keep, SAMPLE_ROWS))
    n = labels.where(F.col("quality").isin(0, 1) & keep).agg(F.sum("quality").alias("good"), F.count("*").alias("all")).first()
    if not model.good:
        return model
    # the calibration weighs both classes alike, the corpus doesn't
    return Model(model.good, model.bad, (model.weights[0] + float(np.log(n["good"] / (n["all"] - n["good"]))), model.weights[1]))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch, and the scores of its texts, in which no other column has a part."""
    sizes = _Sizes(model.good, model.bad)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        z = model.weights[0] + model.weights[1] * np.array([sizes.difference(memoryview(t.as_buffer())) for t in texts])
        yield batch, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, whatever their columns, whose text scores threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scored(batches, model):
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)


def weighed(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs, whatever their columns, and the score as a further column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classified(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, threshold: float = 0.7) -> DataFrame:
    """A row per document with its score; labels are learnt from the folds other than held_fold."""
    model = fit(docs, labels, fold_of(F.col("doc_id"), folds) != held_fold)
    return score(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id"), folds) == held_fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
