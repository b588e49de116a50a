"""Calls to a model as a plan step (UDF1-UDF10): any callable, in batches, once for each distinct input."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import durable

Model = Callable[[str, list[str]], list[str]]


def echo_model(role: str, payloads: list[str]) -> list[str]:
    """A deterministic stand-in: a JSON object in a code fence, as replies come."""
    return ["```json\n" + '{"role": "' + role + '", "digest": "' + hashlib.sha1(p.encode()).hexdigest()[:12] + '"}\n```' for p in payloads]


def ask(df: DataFrame, role: str, payload: str, reply: str, model: Model = echo_model, error: str | None = None) -> DataFrame:
    """UDF1, UDF2, UDF8, UDF10: a reply for each row; equal payloads are sent once.

    A failed call gives null and, in the column ``error`` if one is named, what went
    wrong, so that failures can be counted and told from empty replies.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, why = [None] * len(pdf), None
            try:
                out = model(role, pdf["_p"].tolist())
            except Exception as failure:  # a service's failure is data here, not the job's
                why = f"{type(failure).__name__}: {failure}"
            yield pdf.assign(_r=out, _e=why)

    asked = df.select(F.coalesce(F.col(payload), F.lit("")).alias("_p")).distinct().mapInPandas(call, "_p string, _r string, _e string")
    out = df.withColumn("_p", F.coalesce(F.col(payload), F.lit(""))).join(asked, "_p", "left").withColumnRenamed("_r", reply).drop("_p")
    return out.withColumnRenamed("_e", error) if error else out.drop("_e")


def embed(df: DataFrame, text: str, vector: str, model: Callable[[list[str]], list[Sequence[float]]]) -> DataFrame:
    """UDF3: a vector for each row; where the model fails it is empty, and similarity steps pass the row."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                out = [list(map(float, v)) for v in model(pdf["_t"].tolist())]
            except Exception:
                out = [[]] * len(pdf)
            yield pdf.assign(_v=out)

    done = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct().mapInPandas(call, "_t string, _v array<float>")
    return df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).join(done, "_t", "left").withColumnRenamed("_v", vector).drop("_t")


def letter_model(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in: how often each vowel is in a text, and its length."""
    return [[float(t.count(v)) for v in "aeiou"] + [float(len(t))] for t in texts]


def select_with_retries(candidates: DataFrame, key: str, count: int, choose: Callable[[DataFrame], DataFrame], rounds: int = 3, order: Sequence[Column | str] = ()) -> DataFrame:
    """UDF4, UDF5, STM2: ask for a choice again without what was chosen or rejected, until it is enough.

    ``choose`` returns rows of the candidates with a boolean ``accepted``; each round
    reads the candidates that no earlier round has returned.  Of more than ``count``
    accepted rows those of earlier rounds come first, then by ``order`` and ``key``.
    Adds ``round`` from 1.  Only counts reach the driver.
    """
    seen = kept = None
    for n in range(1, rounds + 1):
        left = candidates if seen is None else candidates.join(seen, key, "left_anti")
        got = durable(choose(left).withColumn("round", F.lit(n)))
        new = got.filter("accepted").drop("accepted")
        kept = new if kept is None else kept.unionByName(new)
        seen = got.select(key) if seen is None else seen.unionByName(got.select(key))
        if got.isEmpty() or kept.count() >= count:
            break
    return kept.orderBy("round", *order, key).limit(count)
