"""From raw documents to packed training sequences: five stages over the text operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
``documents``; the last returns the pieces of the packed sequences.  Between stages
the rows are written as Parquet to the folder that executors share; ``run`` removes
what no later stage reads.

Every stage takes empty tables, null texts and ids, repeated rows, and further columns
of any name, which come out as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import col, remove, row_key, shared_folder
from winnow.llm.decontaminate import drop_contaminated
from winnow.llm.line_dedup import line_dedup
from winnow.llm.near_copies import first_of_near_copies
from winnow.llm.packing import pack
from winnow.llm.queries import tokenizer_path
from winnow.llm.toxicity import toxicity, train

#: A document goes if its score is this or more.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of ``sf_dir``, scores under ``TOXIC_FROM``.

    Null and empty texts have the model's base score and stay.
    """
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "_" * (1 + max(map(len, docs.columns)))  # no column's name
    return toxicity(docs, model, carry=tuple(docs.columns), score_col=score).filter(F.col(score) < TOXIC_FROM).select(*map(col, docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; ``n_chars`` follows the text.

    A null text comes out empty; rows without an id count as the last document.
    """
    rest = [c for c in docs.columns if c != "text"]
    kept = line_dedup(docs.select(col("doc_id"), col("text"), F.struct(*map(col, rest)).alias("row")), carry=("row",))
    columns = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[(columns[c] if c in columns else F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more between their sets of shingles
    of five words.  SimHash and MinHash find candidates, which are verified.  Documents
    without an id can't be told apart and stay.  Of rows with one id and one text the
    first by all columns stays; unlike texts that share an id are two documents.
    """
    named = docs.filter("doc_id IS NOT NULL")
    own = named.select(row_key("doc_id", "text").alias("_key"), F.struct(*map(col, docs.columns)).alias("_row"))
    kept = own.join(first_of_near_copies(named), "_key", "left_semi").groupBy("_key").agg(F.min("_row").alias("_row")).select("_row")
    alone = docs.filter("doc_id IS NULL").select(F.struct(*map(col, docs.columns)).alias("_row"))
    return kept.unionByName(alone).select("_row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids; a null or empty text is the closing id alone, a repeated row is packed again."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Neither the classifier nor the fingerprints can be written in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last is read from what the one before it has written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/stage-{n}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            if before is not None:
                remove(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
