"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; the rest is cut into pieces
of at most ``grain`` ids.  Pieces are dealt to groups by a hash of what they are and of the
partition that they come from, so that a group has about ``group_bytes`` of text at any
size of the table, and equal rows are spread as far as they lie apart.  In each group
runs of at most ``most`` pieces are packed, each with its share of long and short ones:
the differencing method merges partial partitions with opposing imbalances until one
remains, the run's pieces in k windows of near-equal length.  k starts at the fewest
windows that could hold them and rises by one whenever a window is over the capacity.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, col, mix, own_name, slices, text_of

_KINDS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other; within simple texts
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = 2


def _simple(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has only ASCII and letters up to U+024F, no contraction and no special token.

    The others take the tokenizer's own way.
    """
    if not len(data):
        return np.ones(len(offsets) - 1, bool)
    follow = np.append(data[1:], np.uint8(0))
    odd = (data >= 0xCA) | (data == 0xC2) | ((data >= 28) & (data < 32))
    odd |= (data == 0xC3) & ((follow == 0x97) | (follow == 0xB7)) | (data == 0xC6) & (follow == 0xBB) | (data == 0xC7) & (follow < 0x84)
    odd |= (data == 39) & np.isin(follow, np.frombuffer(b"stmdrvl", np.uint8)) | (data == 60) & (follow == 124)
    bad = np.concatenate([[0], np.cumsum(odd)])[offsets]
    return bad[1:] == bad[:-1]


class _Spans:
    """Byte ranges that a byte-level tokenizer encodes on their own, of many simple texts at once.

    A span is a run of letters, of digits or of other characters with the space before
    it, or a run of white space without the last character when something follows.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffers(texts)
        data, n = self.data, len(self.data)
        kind = _KINDS[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True  # where a text begins or ends
        new = edge[:-1].copy()
        space = kind == 0
        new[1:] |= kind[1:] != kind[:-1]
        glued = np.zeros(n, bool)  # after one blank, which goes with what follows
        glued[1:] = ~space[1:] & (data[:-1] == 32)
        new &= ~(glued & ~edge[:-1])
        last = np.zeros(n, bool)  # the last white space before something in the same text
        last[:-1] = space[:-1] & ~space[1:]
        new |= last & ~edge[1:]
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], n)
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        size = self.ends - self.starts
        place = np.arange(len(self.data)) - np.repeat(self.starts, size)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
            return mix(np.add.reduceat((self.data + np.uint64(1)) * power[place], self.starts) + size.astype(np.uint64)) if len(self.starts) else np.zeros(0, np.uint64)


def _parts_alike(declared: dict) -> bool:
    """Whether a tokenizer declares the byte-level rules of ``_Spans``, no normaliser, and no special token that a simple text could hold."""
    rules = declared.get("pre_tokenizer") or {}
    model = declared.get("model") or {}
    return (
        declared.get("normalizer") is None
        and (rules.get("type"), rules.get("add_prefix_space"), rules.get("use_regex")) == ("ByteLevel", False, True)
        and (model.get("type"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")) == ("BPE", None, None, None)
        and all(t["content"].startswith("<|") for t in declared.get("added_tokens") or ())
    )


class _Encoder:
    """The ids of spans by their 64-bit hash: those seen first in a worker are kept, up to ``most``; new ones are encoded."""

    def __init__(self, path: str, most: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: Whether the tokenizer parts texts as ``_Spans`` does; else each takes its own way.
        self.known = _parts_alike(json.loads(self.tokenizer.to_str()))
        self.pool, self.old, self.new = np.zeros(0, np.uint32), self._empty(), self._empty()

    @staticmethod
    def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    @staticmethod
    def _merged(a, b):
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple texts, and the bounds of each text's."""
        spans = _Spans(texts)
        keys, first, back = np.unique(spans.hashes(), return_index=True, return_inverse=True)
        at = self._find(self.old[0], keys)
        begin = np.where(at >= 0, self.old[1][at] if len(self.old[1]) else 0, -1)
        size = np.where(at >= 0, self.old[2][at] if len(self.old[2]) else 0, 0)
        left = np.flatnonzero(at < 0)
        at = self._find(self.new[0], keys[left])
        hit = left[at >= 0]
        begin[hit], size[hit] = self.new[1][at[at >= 0]], self.new[2][at[at >= 0]]
        left = left[at < 0]
        pool = self.pool
        if len(left):
            raw = spans.data.tobytes()
            parts = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(spans.starts[first[left]].tolist(), spans.ends[first[left]].tolist(), strict=True)], add_special_tokens=False)]
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            added = np.fromiter(chain.from_iterable(parts), np.uint32, int(n.sum()))
            begin[left], size[left] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, added])
            if len(self.old[0]) + len(self.new[0]) < self.most:
                self.pool = pool
                self.new = self._merged(self.new, (keys[left], begin[left], n))
                if len(self.new[0]) > 100_000:
                    self.old, self.new = self._merged(self.old, self.new), self._empty()
        begin, size = begin[back], size[back]
        ends = np.cumsum(size)
        ids = pool[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - begin, size)]
        return ids, np.concatenate([[0], ends])[spans.bounds]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    encoder = _encoder(path)
    column = pa.array(texts, pa.string())
    simple = _simple(*buffers(column)) if encoder.known else np.zeros(len(texts), bool)
    ids, bounds = encoder.spans(column.filter(pa.array(simple)))
    data = ids.astype("<u4").tobytes()
    one = iter([data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    other = iter([x.astype("<u4").tobytes() for x in encoder.whole([t for t, ok in zip(texts, simple, strict=True) if not ok])])
    return [next(one) if ok else next(other) for ok in simple]


def _pieces(path: str, capacity: int, grain: int, last: int):
    end = np.array([last], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                rows, starts, ids, totals = [], [], [], []
                for r, code in enumerate(encode(part.column("_text").to_pylist(), path)):
                    code += end
                    n = len(code) // 4
                    full = n // capacity * capacity
                    rest = np.linspace(full, n, -(-(n - full) // grain) + 1).astype(int).tolist() if n > full else [n]
                    cuts = [*range(0, full, capacity), *rest]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        rows.append(r)
                        starts.append(a)
                        ids.append(code[4 * a : 4 * b])
                        totals.append(n)
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], ["_id", "start", "ids", "doc_tokens"])

    return pieces


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Part (0 to k - 1) of each number in a partition into k parts by multiway differencing."""
    if k == 1 or not len(sizes):
        return np.zeros(len(sizes), np.int64)
    heap, tree, parts = [], [], {}
    for i, x in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[-1] = x
        parts[i] = sums
        tree.append(None)
        heap.append((-x, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = parts.pop(a) + parts.pop(b)[::-1]  # the largest of one with the smallest of the other
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        tree.append((a, b, order))
        parts[len(tree) - 1] = sums
        heapq.heappush(heap, (-int(sums[-1]), len(tree) - 1))
    out = np.zeros(len(sizes), np.int64)
    stack = [(heap[0][1], np.arange(k))]  # slots of a partial partition, as parts of the whole
    while stack:
        node, slot = stack.pop()
        if tree[node] is None:
            out[node] = slot[-1]
        else:
            a, b, order = tree[node]
            own = np.empty(k, np.int64)
            own[order] = slot
            stack += [(a, own), (b, own[::-1])]
    return out


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece, and the number of windows: the fewest from the bound that all keep to the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, k)
        if np.bincount(at, sizes, k).max(initial=0) <= capacity:
            return at, k
        k += 1


def _pack(capacity: int, most: int):
    def pack(table: pa.Table) -> pa.Table:
        lengths = pc.binary_length(table.column("ids")).to_numpy().astype(np.int64) // 4
        starts = table.column("start").to_numpy()
        short = np.flatnonzero(lengths < capacity)
        by = short[np.lexsort((starts[short], -lengths[short]))]
        sequence = np.zeros(len(lengths), np.int64)
        k, runs = 0, -(-len(by) // most)
        for run in range(runs):
            at, n = windows(lengths[by[run::runs]], capacity)
            sequence[by[run::runs]] = k + at
            k += n
        full = np.flatnonzero(lengths == capacity)
        sequence[full] = k + np.arange(len(full))
        order = np.lexsort((starts, sequence))
        ends = np.cumsum(lengths[order])
        first = np.append(True, np.diff(sequence[order]) != 0)
        offset = np.empty(len(lengths), np.int64)
        before = ends - lengths[order]
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        group = table.column("_group").to_numpy()
        return pa.table({"_id": table.column("_id"), "start": table.column("start"), "length": pa.array(lengths), "ids": table.column("ids"), "doc_tokens": table.column("doc_tokens"), "sequence_id": pa.array((group << 32) + sequence), "offset": pa.array(offset)})

    return pack


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, grain: int = 192, group_bytes: int = 1 << 20, most: int = 1024) -> DataFrame:
    """Packs all ids of all texts into sequences of at most ``capacity``.

    Result, one row for each piece of a document: (id, start, length, ids,
    doc_tokens, sequence_id, offset).  ``ids`` are little-endian unsigned 32-bit
    numbers.  A document's ids are those of the tokenizer file ``tokenizer`` (of the
    tokenizers library, byte-level, present on every executor) without special
    tokens around them, then ``end_id``; each is in exactly one piece.

    A group's work and memory follow its bytes; equal rows of one partition meet in one
    group, in as many runs as they need.

    Defined cases: a null or empty text is ``end_id`` alone; repeated rows and null
    ids are documents like any other; an empty table gives no rows; other columns
    aren't read.
    """
    own_name(id_col, ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"))
    rows = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    octets = rows.agg(F.sum(F.octet_length("_text") + F.lit(64))).first()[0] or 0
    groups = max(1, -(-octets // group_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity, grain, end_id), f"_id {kind}, start bigint, ids binary, doc_tokens bigint")
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", F.expr(f"start div {capacity}"), "ids", F.spark_partition_id()), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(_pack(capacity, most), f"_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("_id", id_col)
