"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint's 64 bits are split into three segments of 22, 21 and 21.  The anchors
of a segment are the 4096 words of the binary Golay code of length 23 (the segment's
missing bits are 0): the code is perfect, so every segment has just one anchor within
its covering radius of 3, its home.  Of two fingerprints at most 4 bits apart, some
two segments differ in at most 2 bits together; in these, the second fingerprint is
within the radius plus those bits of the first one's home.  So each fingerprint is
replicated, for each two segments, to the pairs of anchors that exceed the radius by
at most 2 together (some 61 of 16.7 million), and compared per pair of anchors with
those that are at home there.

Equal fingerprints are one node.  Where many meet at an anchor, only a spanning set
of links leaves the group.  Components are found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, own_name, shared, slices, split_join, text_of
from .components import components

_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_RADIUS = 3
_GENERATOR = 0b101011100011  # of the binary Golay code


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's low 12 and high 11 bits, error patterns of up to 5 bits by syndrome, and their bounds."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, _GENERATOR << (bit - 11), 0)
        return words

    errors = [np.zeros(1, np.int64)]
    level = np.zeros(1, np.int64)
    for _ in range(_RADIUS + 2):  # each pattern from one whose highest bit is lower
        level = np.concatenate([level[level < 1 << b] | 1 << b for b in range(23)])
        errors.append(level)
    errors = np.concatenate(errors)
    of = syndrome(errors)
    order = np.lexsort((np.bitwise_count(errors), of))
    return syndrome(np.arange(1 << 23)).astype(np.int16), errors[order], np.searchsorted(of[order], np.arange((1 << 11) + 1))


def _anchors(segment: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For an excess of 0, 1 and 2 bits over the radius: index of each value, and an anchor of it."""
    syndromes, errors, bounds = _code()
    s = syndromes[segment]
    n = bounds[s + 1] - bounds[s]
    row = np.repeat(np.arange(len(segment)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + bounds[s][row]
    error = errors[at]
    excess = np.maximum(np.bitwise_count(error).astype(np.int64) - _RADIUS, 0)
    word = (segment[row] ^ error) >> 11  # the code is systematic: 12 bits name a word
    return [(row[excess == e], word[excess == e]) for e in range(3)]


def _places(prints: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each fingerprint, pair of anchors, and whether it is at home there."""
    bits = prints.view(np.uint64)
    near = [_anchors(((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in _SEGMENTS]
    rows, keys, homes = [], [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for e in range(spare + 1):
            for f in range(spare + 1 - e):
                (ri, wi), (rj, wj) = near[i][e], near[j][f]
                ni, nj = np.bincount(ri, minlength=len(prints)), np.bincount(rj, minlength=len(prints))
                starts_j = np.cumsum(nj) - nj
                reps = nj[ri]
                left = np.repeat(np.arange(len(ri)), reps)
                right = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + starts_j[ri[left]]
                rows.append(ri[left])
                keys.append((np.int64(pair) << 24) | (wi[left] << 12) | wj[right])
                homes.append(np.full(len(left), e == f == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(spare: int):
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy()
            for a in range(0, len(prints), 2000):
                some = prints[a : a + 2000]
                rows, keys, homes = _places(some, spare)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(some[rows]), pa.array(homes)], ["anchor", "print", "home"])

    return replicate


def _spanning(prints: np.ndarray, home: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links of a large group that join what any of its links join, by union and find over blocks of rows.

    A row of the largest component so far is compared only with what is outside it, so
    a dense cloud, which few rows join, costs little more than its size.
    """
    prints, at = np.unique(prints, return_inverse=True)
    homes = np.unique(at[home])
    root = np.arange(len(prints))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    us, vs = [], []

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        while True:
            while np.any(root != root[root]):
                root = root[root]
            apart = np.flatnonzero(root[i] != root[j])
            if not len(apart):
                break
            i, j = i[apart], j[apart]
            pairs = np.unique(np.stack([root[i], root[j]], 1), axis=0, return_index=True)[1]
            for p in pairs.tolist():
                x, y = find(int(i[p])), find(int(j[p]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    us.append(int(prints[i[p]]))
                    vs.append(int(prints[j[p]]))

    done, size = 0, 1
    while done < len(homes):
        main = int(np.bincount(root).argmax())
        if np.all(root == main):
            break
        some, inside = homes[done : done + size], root[homes[done : done + size]] == main
        for rows, others in ((some[inside], np.flatnonzero(root != main)), (some[~inside], np.arange(len(prints)))):
            step = max(1, 4_000_000 // len(others))
            for a in range(0, len(rows), step):
                i, j = np.nonzero(np.bitwise_count(prints[rows[a : a + step], None] ^ prints[None, others]) <= most)
                join(rows[a + i], others[j])
        done, size = done + size, min(8 * size, 4096)
    return us, vs


def _compare(most: int, small: int = 12):
    """Links of each anchor's rows, which come one after the other."""

    def links(anchor: np.ndarray, prints: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(anchor)) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(anchor))
        size = np.repeat(ends - starts, ends - starts)
        us, vs = [], []
        few = size <= small
        for s in range(1, small):
            i = np.flatnonzero(few[:-s] & (anchor[:-s] == anchor[s:])) if s < len(anchor) else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[(home[i] | home[i + s]) & (prints[i] != prints[i + s])]
            i = i[np.bitwise_count(prints[i] ^ prints[i + s]) <= most]
            us.append(prints[i])
            vs.append(prints[i + s])
        for a, b in zip(starts[ends - starts > small], ends[ends - starts > small], strict=True):
            if home[a:b].any():
                u, v = _spanning(prints[a:b], home[a:b], most)
                us.append(np.array(u, np.uint64))
                vs.append(np.array(v, np.uint64))
        u, v = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, bool)]
        for batch in batches:
            new = [batch.column("anchor").to_numpy(), batch.column("print").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]):
                whole = int(np.searchsorted(held[0], held[0][-1], "left"))
                if whole:
                    yield links(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield links(*held)

    return compare


def _prints(shingle: int, seed: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                hashes, sizes = [], []
                for text in part.column("_text").to_pylist():
                    words = text.encode().split()
                    joined = b" ".join(words)
                    n = len(words)
                    if n <= shingle:
                        hashes += [digest(joined, seed)] if n else []
                        sizes.append(min(n, 1))
                        continue
                    ends = np.cumsum([len(w) + 1 for w in words])
                    begins = (ends - [len(w) + 1 for w in words])[: n - shingle + 1]
                    hashes += [digest(joined[a:b], seed) for a, b in zip(begins.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
                    sizes.append(n - shingle + 1)
                bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.zeros((len(sizes), 64), np.int64)
                n = np.array(sizes)
                some = np.flatnonzero(n)
                if len(some):
                    sums[some] = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
                out = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(out)], [*part.schema.names[:-1], "print"])

    return prints


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, print): the SimHash of each text's word shingles as a long; see ``simhash_groups``."""
    own_name(id_col, ("print",))
    return _fingerprints(docs, id_col, text_col, shingle, seed).withColumnRenamed("_id", id_col)


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int = 42) -> DataFrame:
    rows = docs.select(col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_text"))
    return rows.mapInArrow(_prints(shingle, seed), rows.select("_id").schema.add("print", "long"))


def near_prints(prints: DataFrame, most: int = 4) -> DataFrame:
    """Links (u, v) among the distinct values of ``print`` at most ``most`` (up to 4) bits apart: enough to join all that any link joins."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or few bytes would be put in few tasks
    placed = prints.select("print").distinct().repartition(tasks, "print").mapInArrow(_replicate(2 * most // 3), "anchor int, print bigint, home boolean")
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(most), "u bigint, v bigint").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row in.

    Words are taken as they are but for A-Z lower-cased.  A bit of the fingerprint is
    1 if it is set in over half of the XXH64 hashes (seed 42) of the word shingles,
    repeats included; a text of fewer words is one shingle.  Fingerprints at most
    ``most`` bits apart are linked; ``component_id`` is the smallest id that links lead
    to, the row's own included.

    Defined cases: a text without words, or null, has the fingerprint zero, linked
    like any other; repeated rows are linked as equal texts are; ids that are null
    don't count for the smallest, so it is null only where all are; other columns
    aren't read.
    """
    own_name(id_col, ("fingerprint", "component_id"))
    own = shared(_fingerprints(docs, id_col, text_col, shingle))
    nodes = own.groupBy("print").agg(F.min("_id").alias("least"))
    roots = components(near_prints(nodes, most)).withColumnRenamed("node", "print")
    named = nodes.join(roots, "print", "left").select("print", F.coalesce("root", "print").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = split_join(named.select("print", "root"), least, "root").select("print", "component_id")
    text = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return own.join(found, "print").select(F.col("_id").alias(id_col), text.alias("fingerprint"), "component_id")
