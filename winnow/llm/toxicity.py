"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the buckets of its words, of their stems (first 4 and 5
bytes), of its pairs of neighbours and its pairs with one word between, each
counted once.  FTRL-proximal keeps a learning
rate for each coordinate and sets weights to exactly zero under its L1 penalty, so
the model is a short list of (bucket, weight) of at most ``2 ** bits`` entries,
which bounds what is broadcast.  Scoring is one pass over the texts without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import PLAIN, Words, col, join_hash, slices, text_of


class Ftrl(NamedTuple):
    """Settings: ``rows`` bounds the labelled rows that are learned from, ``bits`` the buckets."""

    rows: int = 12_000
    bits: int = 20
    passes: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0


class Model(NamedTuple):
    bits: int
    bias: float
    buckets: np.ndarray
    weights: np.ndarray


def _features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all features, repeats included."""
    h, row = words.hashes(), words.rows
    rows, out = [row] * 3, [join_hash(np.full_like(h, 1), h), *(join_hash(np.full_like(h, k), words.hashes(k)) for k in (4, 5))]
    for gap in (1, 2):
        n = max(0, len(h) - gap)
        same = np.flatnonzero(row[:n] == row[gap:])
        pair = join_hash(h[same] + np.uint64(gap), h[same + gap])
        rows.append(row[same])
        out.append(pair)
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


def _extract(bits: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, buckets = _features(Words(part.column("_text"), PLAIN), bits)
                pairs = np.unique((rows << bits) | buckets)
                cuts = np.searchsorted(pairs >> bits, np.arange(part.num_rows + 1))
                own = (pairs & ((1 << bits) - 1)).astype(np.int32)
                sets = pa.array([own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_order"), part.column("_label"), sets], ["_order", "_label", "set"])

    return extract


def _learn(s: Ftrl):
    """FTRL-proximal over the rows in their given order; one row out: the weights."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(x, np.int32)) for b in batches for y, x in zip(b.column("_label").to_pylist(), b.column("set").to_pylist(), strict=True)]
        size = 1 << s.bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, without penalty

        def weights(at) -> np.ndarray:
            w = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
            return np.where(np.abs(z[at]) <= s.l1, 0.0, w)

        def bias() -> float:
            return float(-z[size] / ((s.beta + np.sqrt(n[size])) / s.alpha))

        for _ in range(s.passes):
            for y, x in rows:
                w, b = weights(x), bias()
                p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
                g = p - y
                sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / s.alpha
                z[x] += g - sigma * w
                n[x] += g * g
                z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / s.alpha * b
                n[size] += g * g
        w = weights(np.arange(size))
        at = np.flatnonzero(w).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([bias()]), pa.array([at.tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary())], ["bias", "buckets", "weights"])

    return learn


def held_out(id_col: str, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``which``; not so for null."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % parts == which, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Ftrl = Ftrl()) -> Model:
    """Fits the model on the labelled rows whose id isn't held out.

    At most ``settings.rows`` labelled ids are used: those with the smallest hash of
    their id, a sample that doesn't depend on order or partitions.  Rows without a
    label or without an id aren't learned from; of an id with several labels the
    largest counts, and of its rows the one whose text has the smallest hash.  Without any row the model gives every text a score of 0.1.
    """
    wanted = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull() & ~held_out(id_col, 4, 2))
    wanted = wanted.groupBy(col(id_col).alias("_id")).agg(F.max(col(label_col)).cast("double").alias("_label"))
    wanted = wanted.select("_id", "_label", F.xxhash64("_id").alias("_order")).orderBy("_order", "_id").limit(settings.rows)
    texts = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(wanted), "_id")
    texts = texts.groupBy("_order", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("t")).select("_order", "_label", F.col("t._text").alias("_text"))
    sets = texts.select("_order", "_label", "_text").mapInArrow(_extract(settings.bits), "_order bigint, _label double, set binary")
    one = sets.repartition(1).sortWithinPartitions("_order", "set").mapInArrow(_learn(settings), "bias double, buckets binary, weights binary").first()
    if one is None:  # no labelled row: odds of one to nine
        return Model(settings.bits, -float(np.log(9)), np.zeros(0, np.int32), np.zeros(0))
    return Model(settings.bits, one.bias, np.frombuffer(one.buckets, np.int32), np.frombuffer(one.weights, np.float64))


def _score(sent, at: int | None):
    """Scores of the text in field ``at`` of the row that is carried, or else of the column ``_text``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        table = np.zeros(1 << model.bits, np.float32)
        table[model.buckets] = model.weights
        for batch in batches:
            if at is not None:
                texts = pc.fill_null(batch.column("_row").field(at).cast(pa.string()), "")
                batch = pa.RecordBatch.from_arrays([batch.column("_row"), texts], ["_row", "_text"])
            for part in slices(batch):
                rows, buckets = _features(Words(part.column("_text"), PLAIN), model.bits)
                used = table[buckets] != 0
                pairs = np.unique((rows[used] << model.bits) | buckets[used])
                sums = np.bincount(pairs >> model.bits, table[pairs & ((1 << model.bits) - 1)], part.num_rows) + model.bias
                out = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(out)], ["_row", "_score"])

    return score


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """(id, columns ``carry``, ``score_col``): the probability that a text is toxic, for each row in.

    Only the text is scored.  Defined cases: a null or empty text has the model's
    base score; repeated rows and null ids come out as they are; columns not named
    aren't read, and those of ``carry`` may have any name but ``score_col``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits entries at most
    names = list(dict.fromkeys((id_col, *carry)))
    rows = docs.select(F.struct(*[col(c) for c in names]).alias("_row"), text_of(text_col).alias("_text"))
    at = names.index(text_col) if text_col in names else None
    scored = (rows if at is None else rows.select("_row")).mapInArrow(_score(sent, at), StructType([rows.schema["_row"], StructField("_score", DoubleType())]))
    return scored.select(*[F.col("_row").getField(c).alias(c) for c in names], F.col("_score").alias(score_col))
