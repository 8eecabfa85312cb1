"""Quality classifier: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

A text is cut into runs of word characters and runs of other marks, with a mark for either
edge of the text; one and two of these in a row are hashed into 2^BITS features, and a unit
followed by itself is the same feature for all units. A text's score is the sparse dot product of its
n-gram counts, scaled by the root of their number, with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.fastwords import WordHashes, n_grams

UNITS = re.compile(r"\w+|[^\w\s]+")
BITS = 18
#: Stands before the first and after the last unit of a text.
EDGE = "\n"
#: The n-gram of a unit with itself, whatever the unit.
AGAIN = np.uint64(0x5851F42D4C957F2D)

_hashes = WordHashes()


def features(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams of a text, with repeats. A null text counts as an empty one."""
    hashed = _hashes.of([EDGE, *UNITS.findall(text or ""), EDGE])
    grams = [n_grams(hashed, n) for n in (1, 2)]
    grams[1][hashed[1:] == hashed[:-1]] = AGAIN
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the per-coordinate FTRL-Proximal updates."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w


@dataclass(frozen=True)
class QualityModel:
    bias: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        found = features(text)
        margin = self.bias
        if len(found):
            margin += float(self.weights[found].sum()) / np.sqrt(len(found))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def train(examples: DataFrame, params: Ftrl = Ftrl(), text: str = "text", label: str = "label", order: str = "doc_id") -> QualityModel:
    """One pass of FTRL updates over `examples` in the order of a hash of `order`.

    Updates follow one another, so one task takes them; callers bound the sample (see `sample_labelled`).
    Rows with a null label are passed over; repeated rows are learnt as often as they are there. Without rows every score is 0.5.
    """

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bias_z, bias_n = np.zeros(1), np.zeros(1)
        for batch in it:
            for one_text, y in zip(batch.column(0), batch.column(1)):
                found, times = np.unique(features(one_text.as_py()), return_counts=True)
                x = times / np.sqrt(max(1, times.sum()))
                w, b = params.weights(z[found], n[found]), params.weights(bias_z, bias_n)
                p = 1 / (1 + np.exp(-np.clip(w @ x + b[0], -30, 30)))
                g = (p - y.as_py()) * x
                sigma = (np.sqrt(n[found] + g * g) - np.sqrt(n[found])) / params.alpha
                z[found] += g - sigma * w
                n[found] += g * g
                gb = np.array([p - y.as_py()])
                sigma = (np.sqrt(bias_n + gb * gb) - np.sqrt(bias_n)) / params.alpha
                bias_z += gb - sigma * b
                bias_n += gb * gb
        w = params.weights(z, n)
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept, -1), pa.int32()), pa.array(np.append(w[kept], params.weights(bias_z, bias_n)), pa.float64())],
            names=["feature", "weight"],
        )

    one = examples.filter(F.col(label).isNotNull()).select(text, F.col(label).cast("double").alias("y"), order)
    one = one.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("ftrl"), order), order, text, "y")
    weights, bias = np.zeros(1 << BITS), 0.0
    for row in one.select(text, "y").mapInArrow(fit, "feature int, weight double").collect():  # 2^BITS + 1 rows at most
        if row["feature"] < 0:
            bias = row["weight"]
        else:
            weights[row["feature"]] = row["weight"]
    return QualityModel(bias, weights)


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 3, is not 1. Null ids are learnable."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0)) != 1


def sample_labelled(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Learnable labelled documents, `most` labels and `most` rows at most: those with the least hash of the id, then of id and text.

    The chosen ids are `most` rows at most, so they are broadcast to the documents.
    A doc_id labelled twice is taken with each label; ids without a document go. Where many documents share an id, so that there are more
    rows than labels, the hash of id and text decides which stay.
    """
    chosen = (
        labels.filter(learnable() & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).alias("label"))
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", "label")
        .limit(most)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.orderBy(F.xxhash64(F.lit("row"), "doc_id", "text"), "doc_id", "text", "label").limit(most)


def score(df: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score of every whole text in a column `name`, which replaces one of that name.

    A null text scores as an empty one, from the bias alone.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    kept = [c for c in df.columns if c.lower() != name.lower()]
    at = kept.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        for batch in it:
            scores = pa.array([own.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*kept, name])

    fields = [df.schema[c].dataType.simpleString() for c in kept]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(kept, fields)), f"`{name}` double"])
    return df.select(*kept).mapInArrow(batches, schema)

