"""Ranked lexical search over posting lists cut into blocks of similar documents.

Only terms that the query set asks for get a posting list.  One pass over the whole
texts makes a vector of each document, (term, frequency) and its length; from these
come N, L and the document frequencies, so weights rest on all documents.

Tasks then take the vectors as they lie, in chunks of a bounded number of postings.
In a chunk each term's posting list is cut into blocks: some of its documents serve
as centres, and each document joins the centre whose signed projection is nearest.  A
block keeps the largest impact of each term, coordinate by coordinate.  Lists are
taken heaviest first.  For a query, the sum of weight times largest impact over the
terms whose lists are still to come bounds the score of each document of a block that
no earlier list has shown; a block is skipped only if this bound is under the score
of the query's last place so far, and the query ends when all lists to come can't
reach it.  So the result is exact, ties included.

Queries go to the tasks in blocks of a bounded number of terms; the vectors are read
once for each block, the texts once for all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, Words, col, mix, remove, shared, shared_folder, slices, text_of

#: A-Z lower-cased; all ASCII but letters and digits parts terms.
_TERMS = LOWER.copy()
_TERMS[[b for b in range(128) if not chr(b).isalnum()]] = 32
#: Bits of the fixed-size filter by which a text's terms are told from those that no query has.
_FILTER = 20
_PER_BLOCK = 64
_SKETCH = 32


def _vectors(sent):
    """Rows (_id, _n, _h, _tf): the terms of each text that pass the filter, and how many it has in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None else sent.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("_text"), _TERMS)
                h, rows = words.hashes(), words.rows
                if wanted is not None:
                    keep = wanted[h & np.uint64((1 << _FILTER) - 1)]
                    h, rows = h[keep], rows[keep]
                order = np.lexsort((h, rows))
                h, rows = h[order], rows[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(first)
                tf = np.diff(np.append(at, len(h)))
                offsets = pa.array(np.searchsorted(rows[at], np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(np.diff(words.bounds), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(h[at].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["_id", "_n", "_h", "_tf"]
                )

    return run


class Queries(NamedTuple):
    """A block of queries: ``vocab`` sorted, each query's terms as places in it, and the weights of these."""

    vocab: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    n_terms: int


def queries_of(rows: list[tuple[list[int], list[int]]], n_docs: int, n_terms: int) -> Queries:
    """From (hashes, weights) of each query."""
    hashes = [np.array(h, np.int64).view(np.uint64) for h, _ in rows]
    vocab = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    return Queries(vocab, [np.searchsorted(vocab, h) for h in hashes], [np.array(w, np.int64) for _, w in rows], n_docs, n_terms)


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Chunk:
    """Vectors of some documents by document, and their posting lists by term."""

    def __init__(self, table: pa.Table, q: Queries):
        lists = table.column("_h").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):  # pyarrow may leave one chunk wrapped
            lists = lists.chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        h = lists.flatten().to_numpy().view(np.uint64)
        tf = table.column("_tf").combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(q.vocab, h), max(0, len(q.vocab) - 1))
        keep = q.vocab[at] == h if len(q.vocab) else np.zeros(len(h), bool)
        self.doc, self.term, tf = doc[keep], at[keep], tf[keep].astype(np.int64)
        n = table.column("_n").to_numpy().astype(np.int64)
        m = 50 + (50 * n[self.doc] * q.n_docs) // max(1, q.n_terms)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
        self.bounds = np.searchsorted(self.doc, np.arange(len(sizes) + 1))
        order = np.argsort(self.term, kind="stable")
        self.posted = self.doc[order]
        self.ends = np.searchsorted(self.term[order], np.arange(len(q.vocab) + 1))
        self.most = np.zeros(len(q.vocab), np.int64)
        np.maximum.at(self.most, self.term, self.impact)
        self._vocab, self._sketch = q.vocab, None

    def _projected(self) -> np.ndarray:
        """Each document's impacts, added up with the signs that its terms' hashes give."""
        if self._sketch is None:
            signs = ((mix(self._vocab)[:, None] >> np.arange(_SKETCH, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
            self._sketch = np.zeros((len(self.bounds) - 1, _SKETCH), np.float32)
            for k in range(_SKETCH):
                self._sketch[:, k] = np.bincount(self.doc, signs[self.term, k] * self.impact, len(self._sketch))
            self._sketch /= np.maximum(1, np.linalg.norm(self._sketch, axis=1, keepdims=True))
        return self._sketch

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of term t's list by block, where each block begins (and the end), and its summary."""
        docs = self.posted[self.ends[t] : self.ends[t + 1]]
        starts = np.array([0, len(docs)])
        if len(docs) > _PER_BLOCK:
            centres = docs[:: -(-len(docs) // int(np.ceil(len(docs) / _PER_BLOCK)))]
            sketch = self._projected()
            near = np.concatenate([np.argmax(sketch[docs[a : a + 8192]] @ sketch[centres].T, axis=1) for a in range(0, len(docs), 8192)])
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            starts = np.append(np.flatnonzero(np.append(True, near[1:] != near[:-1])), len(docs))
        entries = _spans(self.bounds[docs], self.bounds[docs + 1])
        block = np.repeat(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), self.bounds[docs + 1] - self.bounds[docs])
        summary = np.zeros((len(starts) - 1, len(self._vocab)), np.int64)
        np.maximum.at(summary, (block, self.term[entries]), self.impact[entries])
        return docs, starts, summary


class Ranking:
    """The best documents of each query over all chunks that a task has seen."""

    def __init__(self, q: Queries, top: int):
        self.q, self.top = q, top
        self.best: list[list[tuple[int, object]]] = [[] for _ in q.terms]
        self.met = self.skipped = 0
        self.users: list[list[tuple[int, int]]] = [[] for _ in q.vocab]  # of each term, query and place in it
        for k, terms in enumerate(q.terms):
            for p, t in enumerate(terms.tolist()):
                self.users[t].append((k, p))
        self._dense = np.zeros(len(q.vocab), np.int64)

    def _scores(self, chunk: Chunk, k: int, docs: np.ndarray) -> np.ndarray:
        self._dense[self.q.terms[k]] = self.q.weights[k]
        starts, ends = chunk.bounds[docs], chunk.bounds[docs + 1]
        at = _spans(starts, ends)
        out = np.add.reduceat(chunk.impact[at] * self._dense[chunk.term[at]], np.cumsum(ends - starts) - (ends - starts))
        self._dense[self.q.terms[k]] = 0
        return out

    def add(self, table: pa.Table) -> None:
        chunk, q = Chunk(table, self.q), self.q
        if not len(chunk.doc):
            return
        ids = table.column("_id")
        place = np.empty(len(ids), np.int64)
        place[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        rest = [w.copy() for w in q.weights]  # zero for terms whose lists are done
        reach = [int((w * chunk.most[t]).sum()) for w, t in zip(q.weights, q.terms, strict=True)]
        seen = np.zeros((len(q.terms), len(ids)), bool)
        last = [sorted(s for s, _ in b) for b in self.best]  # scores of the places taken, worst first
        mine = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q.terms]

        def least(k: int) -> int:
            return last[k][0] if len(last[k]) >= self.top else 1

        weight = np.zeros(len(q.vocab), np.int64)
        for t, w in zip(q.terms, q.weights, strict=True):
            weight[t] = w
        heavy = weight * chunk.most
        for t in np.argsort(-heavy, kind="stable").tolist():
            if not heavy[t]:
                break
            listed = None
            for k, p in self.users[t]:
                if reach[k] >= least(k):
                    listed = listed or chunk.blocks(t)
                    docs, starts, summary = listed
                    bounds = summary[:, q.terms[k]] @ rest[k]
                    passed = bounds >= least(k)
                    self.met += len(passed)
                    self.skipped += int((~passed).sum())
                    new = docs[np.repeat(passed, np.diff(starts))]
                    new = new[~seen[k, new]]
                    if len(new):
                        seen[k, new] = True
                        scores = np.append(mine[k][0], self._scores(chunk, k, new))
                        new = np.append(mine[k][1], new)
                        order = np.lexsort((place[new], -scores))[: self.top]
                        order = order[scores[order] > 0]
                        mine[k] = scores[order], new[order]
                        last[k] = sorted([*(s for s, _ in self.best[k]), *scores[order].tolist()])[-self.top :]
                reach[k] -= int(heavy[t])
                rest[k][p] = 0
        for k, (scores, docs) in enumerate(mine):
            if len(docs):
                found = list(zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist(), strict=True))
                self.best[k] = sorted(self.best[k] + found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[: self.top]


def _search(sent, top: int, postings: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking, held, size = Ranking(sent.value, top), [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("_h").flatten()) + batch.num_rows
            if size >= postings:
                ranking.add(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            ranking.add(pa.Table.from_batches(held))
        rows = [(k, s, i) for k, best in enumerate(ranking.best) for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())], ["_query", "_id", "score"])

    return run


def weight(n_docs: Column, df: Column) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 50, block_terms: int = 1 << 15, postings: int = 1 << 20) -> DataFrame:
    """The ``top`` documents of each item with a score above 0: (item_id, rank, doc_id, score), for any names of columns.

    Terms are runs of ASCII letters and digits and of all characters from U+0080 on,
    A-Z lower-cased, told apart by 64-bit hash.  Over an item's distinct terms the score
    adds weight * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L.

    ``block_terms`` bounds the terms of the items that are searched for at once,
    ``postings`` those of a chunk of documents.  Defined cases: null or empty texts have
    no terms; items without a term, or whose terms no document has, have no rows; equal
    scores rank by id, nulls last; each row of ``docs`` is a document, so repeated rows
    take a rank each; items equal in id and terms are one, those that share an id only
    are ranked each for itself; empty tables give no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    shape = "_n long, _h array<long>, _tf array<long>"
    doc_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType

    def vectors(table: DataFrame, id_: str, text: str, sent) -> DataFrame:
        return table.select(col(id_).alias("_id"), text_of(text).alias("_text")).mapInArrow(_vectors(sent), f"_id {table.schema[id_].dataType.simpleString()}, {shape}")

    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    vectors(items, item_col, item_text_col, None).select("_id", "_h").distinct().write.parquet(f"{path}/items")
    asked = spark.read.schema(f"_id {item_type.simpleString()}, _h array<long>").parquet(f"{path}/items")
    bits = np.zeros(1 << _FILTER, bool)
    bits[[r[0] for r in asked.select(F.explode("_h").alias("h")).select(F.col("h").bitwiseAND((1 << _FILTER) - 1).alias("b")).distinct().collect()]] = True
    vectors(docs, id_col, text_col, context.broadcast(bits)).write.parquet(f"{path}/vectors")
    rows = spark.read.schema(f"_id {doc_type.simpleString()}, {shape}").parquet(f"{path}/vectors")
    n_docs, n_terms = rows.agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()

    terms = asked.select("_id", "_h", F.explode("_h").alias("h"))
    df = rows.select(F.explode("_h").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "h").withColumn("w", weight(F.lit(n_docs), F.col("df"))).groupBy("_id", "_h").agg(F.collect_list(F.struct("h", "w")).alias("terms"))
    blocks = -(-(asked.agg(F.sum(F.size("_h"))).first()[0] or 0) // block_terms) or 1
    weighed.withColumn("_block", F.pmod(F.xxhash64("_id", "_h"), F.lit(blocks))).write.parquet(f"{path}/weighed")
    weighed = spark.read.schema(f"_id {item_type.simpleString()}, terms array<struct<h:long,w:long>>, _block long").parquet(f"{path}/weighed")

    kind = rows.select("_id").limit(0).toArrow().schema.field(0).type
    out = None
    for block in range(blocks):
        queries = weighed.filter(F.col("_block") == block).collect()
        sent = context.broadcast(queries_of([([x.h for x in r.terms], [x.w for x in r.terms]) for r in queries], n_docs, n_terms))
        names = spark.createDataFrame([(k, r._id) for k, r in enumerate(queries)], f"_query long, _item {item_type.simpleString()}")
        found = rows.mapInArrow(_search(sent, top, postings, kind), f"_query long, _id {doc_type.simpleString()}, score long")
        order = Window.partitionBy("_query").orderBy(F.desc("score"), F.col("_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(F.broadcast(names), "_query")
        best = best.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
        best = shared(best)  # at most top rows an item; what it was made from can go
        out = best if out is None else out.unionByName(best)
    remove(spark, path)
    return out
