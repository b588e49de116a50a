"""Benchmark passages in documents, found by pigeonhole pieces and verified by bit-parallel distance.

A benchmark item of m words may differ from its copy by k = floor(rate * m) words
inserted, deleted or replaced.  Split into k + 1 pieces, one of them is then in the
copy word for word.  The first words of every piece are looked up at each word of
a document; where one is found, Myers' bit-parallel algorithm gives the smallest
edit distance between the item and any stretch of the words around it.

Items are taken in blocks of at most ``block_bytes`` of text, which bounds what is
broadcast whatever the size of the benchmark; each block is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, Words, col, gram_hashes, slices, text_of

_Q = 5  # words of a piece that are looked up


class Pieces(NamedTuple):
    """Pieces whose looked-up part has ``size`` words, by its hash; item and place of each."""

    size: int
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray


class Block(NamedTuple):
    words: list[np.ndarray]
    errors: list[int]
    pieces: list[Pieces]


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance between the item and any stretch of the text, and where the first such ends."""
    m = len(item)
    bits: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        bits[w] = bits.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text.tolist()):
        eq = bits.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(xv | plus) & full
        down = plus & xv
        if now < best:
            best, end = now, j + 1
    return best, end


def build(texts: list[str], rate: float, least: int) -> Block:
    """Pieces of a block of items; items of fewer than ``least`` words have none."""
    words = Words(pa.array(texts, pa.string()), PLAIN, apart=True)
    hashes = words.hashes()
    items = [hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    errors = [int(rate * len(x)) for x in items]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for n, (x, k) in enumerate(zip(items, errors, strict=True)):
        if len(x) < max(1, least):
            continue
        cuts = [len(x) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            size = min(b - a, _Q)
            found.setdefault(size, []).append((int(gram_hashes(x[a : a + size], size)[0]), n, a))
    pieces = []
    for size, rows in found.items():
        rows.sort()
        h = np.array([r[0] for r in rows], np.uint64)
        seen = np.zeros(1 << 20, bool)
        seen[h & np.uint64((1 << 20) - 1)] = True
        pieces.append(Pieces(size, h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen))
    return Block(items, errors, pieces)


def _hits(words: Words, block: Block) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, end) of each row and item within the error budget, the nearest."""
    if not len(words):
        return []
    h, row = words.hashes(), words.rows
    seeds, whole = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    sizes = np.array([len(x) for x in block.words])
    for p in block.pieces:
        grams = gram_hashes(h, p.size)
        at = np.flatnonzero(p.filter[grams & np.uint64((1 << 20) - 1)])
        at = at[row[at] == row[at + p.size - 1]]
        lo, hi = np.searchsorted(p.hashes, grams[at], "left"), np.searchsorted(p.hashes, grams[at], "right")
        n = hi - lo
        at, k = np.repeat(at, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.stack([row[at], p.items[k], at - p.places[k]], axis=1)
        full = sizes[found[:, 1]] == p.size  # the piece is its item: found word for word
        seeds.append(found[~full])
        whole.append(found[full])
    out = []
    exact = np.unique(np.concatenate(whole), axis=0)
    first = np.unique(exact[:, :2], axis=0, return_index=True)[1]
    for r, n, begin in exact[first].tolist():
        out.append((r, n, 0, begin - int(words.bounds[r]), begin - int(words.bounds[r]) + int(sizes[n])))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    every = np.unique(np.concatenate(seeds), axis=0)
    limits = np.array([*block.errors, 0])[every[:, 1]]
    new = np.ones(len(every), bool)  # one alignment gives a seed for each piece: those within the error budget are verified as one
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1) | (every[1:, 2] - every[:-1, 2] > limits[1:])
    first = np.flatnonzero(new)
    ends = np.append(first, len(every))[1:] - 1
    for (r, n, begin), until in zip(every[first].tolist(), every[ends, 2].tolist(), strict=True):
        k, m = block.errors[n], len(block.words[n])
        a, b = max(words.bounds[r], begin - k), min(words.bounds[r + 1], until + m + 2 * k)
        d, end = distance(block.words[n], h[a:b])
        if d <= k:
            last = a + end - words.bounds[r]
            back, size = distance(block.words[n][::-1], h[a : a + end][::-1])
            if (r, n) not in best or d < best[r, n][0]:
                best[r, n] = (d, int(last - size), int(last))
    return out + [(r, n, *x) for (r, n), x in best.items()]


def _scan(sent, ids: pa.Array):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for part in slices(batch):
                found = sorted(_hits(Words(part.column("_text"), PLAIN, apart=True), block))
                cols = list(zip(*found, strict=True)) or [[]] * 5
                items = pa.array(cols[1], pa.int64())
                sizes = [len(block.words[n]) for n in cols[1]]
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(cols[0], pa.int64())), ids.take(items), *(pa.array(x, pa.int64()) for x in (cols[2], sizes, cols[3], cols[4]))], ["_id", "_item", "distance", "item_words", "first_word", "end_word"])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.15, least: int = 1, block_bytes: int = 8 << 20) -> DataFrame:
    """Pairs of a document and a benchmark item that is in it, with at most ``rate`` of its words changed.

    Result: (id, item id, distance, item_words, first_word, end_word), the nearest
    stretch of each pair; documents without an item have no row.  Words are runs of
    letters and digits (ASCII punctuation parts them), A-Z lower-cased, compared by
    64-bit hash over whole texts; a letter from U+3000 on is a word by itself.

    Defined cases: null or empty texts match nothing; short items have no error to
    spend and are found word for word; with ``least``, items of fewer words aren't
    searched for, which keeps one-word answers from matching everywhere; ids may be null or repeat, each row giving its own
    pairs; an empty benchmark gives no rows; other columns aren't read.
    """
    item_type = benchmark.schema[item_col].dataType
    rows = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = rows.select("_id").schema.add("_item", item_type)
    for name in ("distance", "item_words", "first_word", "end_word"):
        schema = schema.add(name, "long")
    kind = benchmark.select(col(item_col).alias("_item")).limit(0).toArrow().schema.field(0).type
    out = None
    for ids, sent in _blocks(benchmark, item_col, item_text_col, rate, least, block_bytes):
        found = rows.mapInArrow(_scan(sent, pa.array(ids, kind)), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "distance", "item_words", "first_word", "end_word")


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, rate: float, least: int, block_bytes: int):
    """Ids and the broadcast pieces of each block of items; one block at least, one at a time on the driver."""
    context = benchmark.sparkSession.sparkContext
    ids, texts, size, none = [], [], 0, True
    for r in benchmark.select(col(item_col).alias("item"), text_of(item_text_col).alias("text")).toLocalIterator():
        if size + len(r.text) > block_bytes and ids:
            yield ids, context.broadcast(build(texts, rate, least))
            ids, texts, size, none = [], [], 0, False
        ids.append(r.item)
        texts.append(r.text)
        size += len(r.text)
    if ids or none:
        yield ids, context.broadcast(build(texts, rate, least))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.15, least: int = 1, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows in which ``decontaminate`` finds no item, all columns as they are; no shuffle.

    Defined cases: as there; rows with a null or empty text stay; columns may have any name.
    """
    at = docs.columns.index(text_col)

    def keep(sent):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                texts = pc.fill_null(batch.column("_row").field(at).cast(pa.string()), "")
                done = 0
                for part in slices(pa.RecordBatch.from_arrays([texts], ["_text"])):
                    bad = {r for r, *_ in _hits(Words(part.column("_text"), PLAIN, apart=True), block)}
                    yield batch.slice(done, part.num_rows).filter(pa.array([r not in bad for r in range(part.num_rows)], pa.bool_()))
                    done += part.num_rows

        return clean

    rows = docs.select(F.struct(*map(col, docs.columns)).alias("_row"))
    for _, sent in _blocks(benchmark, item_col, item_text_col, rate, least, block_bytes):
        rows = rows.mapInArrow(keep(sent), rows.schema)
    return rows.select("_row.*")
