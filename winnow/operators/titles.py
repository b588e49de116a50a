"""Titles alike by matching blocks (JON15, DED3).

With M matching characters of titles of l and m characters the ratio is 2 M / (l + m).
Over a ratio r above 2/3 a pair of titles

- has M >= floor(r (l + m) / 2) + 1, which neither title may be shorter than;
- shares at least 3 M - l - m - 1 pairs of neighbouring characters, each at most
  max(l, m) - M places apart, since each unmatched character parts two pairs of its own
  title and one of the other's;
- so shares one among the rarest of both, all but that number less one (prefix filter);
- has a common subsequence of M characters or more.

In either title an unmatched character before a matched one moves it by a place, so a
matched character's places differ by at most l - M one way and m - M the other.

``like_titles`` deals titles to blocks and lets each two blocks meet in one task, where
pairs of titles are counted, not shipped.  For titles of up to 64 characters, a table
holds for each place and pair of characters the titles of a block that have it at a place
near enough, as bits; the bits of a title's own places, added up for 64 others at a time,
leave few to the common subsequence, bit-parallel as well and within the same places.
Longer titles count shared pairs of characters by a matrix product.  What is left is
matched block by block.  Only links leave the task, so disk grows with titles times
blocks, not with pairs of titles.

``indexed_grams`` and ``candidates`` are an inverted index of the same pairs of characters.
It is worth its rows where few titles share them (a wide alphabet); in prose at a ratio
of 0.8 most titles do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable

_WORD = 64
#: Titles of a block, and the fewest worth a task; two blocks meet in one task.
ROWS, _FEWEST = 16384, 2048
#: Columns that pairs of characters of long titles are hashed to for counting, and titles counted at once.
_COLUMNS, _CHUNK = 1024, 256
#: Pairs of characters that a table tells apart, words of bits added up at once, bits of a sum.
_GRAMS, _SUMMED, _BITS = 1023, 8192, 7
#: Lengths that share a table: at least and, where titles are fewer than the third, at most.
_BAND = (4, 16, 1024)
#: Characters of a block, by letter and how often before, that have a bit of their own, and pairs that are counted at once.
_OWN, _PAIRS = 256, 16384
#: Characters after which pairs that can't get there any more are left out.
_LOOKS = (24, 28, 32, 36, 40)


def _needed(both: Column, ratio: float) -> Column:
    """Matching characters that a pair of titles of ``both`` characters in all needs."""
    return F.floor(F.lit(ratio) * both / 2) + 1


def _shared_grams(size: Column, ratio: float) -> Column:
    """At least as many pairs of characters does a title of ``size`` share with any that is alike."""
    shortest = size + F.floor(size * ratio / (2 - ratio)) + 1
    return F.greatest(F.lit(1), F.floor(shortest * (1.5 * ratio - 1) - 1e-9))


def indexed_grams(titles: DataFrame, ratio: float) -> DataFrame:
    """(id, size, gram, at): of each title (id, title) the rarest pairs of characters, as many as the prefix filter needs.

    Order is by the number of occurrences in all titles, then by gram, then by place.
    """
    size = F.char_length("title")
    at = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at")
    grams = titles.select("id", "title", size.alias("size")).filter("size > 1").select("id", "title", "size", at).select("id", "size", "at", F.substring("title", F.col("at"), F.lit(2)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("id").orderBy("often", "gram", "at")
    ranked = grams.join(often, "gram").withColumn("_r", F.row_number().over(rarest))
    return ranked.filter(F.col("_r") <= F.col("size") - _shared_grams(F.col("size"), ratio)).select("id", "size", "gram", "at")


def candidates(grams: DataFrame, ratio: float) -> DataFrame:
    """(u, v) with u < v, once each: titles that share an indexed pair of characters within the bounds."""
    a, b = grams.alias("a"), grams.alias("b")
    l, m = F.col("a.size"), F.col("b.size")
    need = _needed(l + m, ratio)
    near = F.abs(F.col("a.at") - F.col("b.at")) <= F.greatest(l, m) - need
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & (need <= F.least(l, m)) & near)
    return met.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def _matrix(texts: list[str]) -> np.ndarray:
    """Code points of titles of at most 64 characters, filled up with a number that is none."""
    out = np.full((len(texts), _WORD), 0xFFFFFFFF, np.uint32)
    for n, t in enumerate(texts):
        out[n, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, at most 64 characters each, bit-parallel over all pairs."""
    x, y = _matrix(a), _matrix(b)
    y[y == 0xFFFFFFFF] = 0xFFFFFFFE
    v = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(max(map(len, b), default=0)):
            hit = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
            u = v & hit
            v = (v + u) | (v - u)
    size = np.array([len(t) for t in a])
    ones = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return size - (ones * (np.arange(_WORD) < size[:, None])).sum(axis=1)


def alike(a: str, b: str, ratio: float) -> bool:
    """Whether matching blocks, looked for from either side, are over ``ratio``."""
    return SequenceMatcher(None, a, b).ratio() > ratio or SequenceMatcher(None, b, a).ratio() > ratio


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code point) of all characters, text after text."""
    return np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _counted(texts: list[str]) -> np.ndarray:
    """Rows whose products are at least the pairs of characters that two texts share: the nth use of a pair is a column, by hash."""
    row, point = _points(texts)
    at = np.flatnonzero(row[1:] == row[:-1])
    row, gram = row[at], point[at] << 21 | point[at + 1]
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    places = np.arange(len(row))
    nth = places - np.maximum.accumulate(np.where(new, places, 0))
    with np.errstate(over="ignore"):
        column = ((gram * 1000003 + nth * 7919).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % _COLUMNS
    return np.bincount(row * _COLUMNS + column, minlength=len(texts) * _COLUMNS).reshape(-1, _COLUMNS).astype(np.float32)


class _Side:
    """A block's titles by length, as rows to count by and, up to 64 characters, as columns of codes."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        self.texts = sorted(texts, key=lambda t: (len(t), t))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.short = int(np.searchsorted(self.size, _WORD, side="right"))
        row, point = _points(self.texts[: self.short])
        first = np.cumsum([0, *self.size[: self.short]])[:-1]
        self.codes = np.full((_WORD, self.short), len(alphabet), np.uint16 if len(alphabet) < 1 << 16 else np.int32)
        self.codes[np.arange(len(row)) - first[row], row] = np.searchsorted(alphabet, point)

    @cached_property
    def grams(self) -> np.ndarray:
        return _counted(self.texts)

    def uses(self) -> np.ndarray:
        """At each place a number for the letter and how often the title has it before, -1 beyond its end."""
        order = np.argsort(self.codes, axis=0, kind="stable")
        ordered = np.take_along_axis(self.codes, order, axis=0)
        at = np.arange(_WORD)[:, None]
        first = np.maximum.accumulate(np.where(np.vstack([np.ones((1, self.short), bool), ordered[1:] != ordered[:-1]]), at, 0), axis=0)
        nth = np.empty_like(order)
        np.put_along_axis(nth, order, at - first, axis=0)
        return np.where(at < self.size[: self.short], self.codes.astype(np.int64) * _WORD + nth, -1)

    def pairs(self, letters: int) -> np.ndarray:
        """Numbers of the pairs of characters at each place, -1 beyond a title's end."""
        return np.where(self.codes[1:] < letters, self.codes[:-1].astype(np.int64) * (letters + 1) + self.codes[1:], -1)


def _columns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns for the pairs of characters of two blocks; the last is for those that the second lacks.

    By hash where there are too many, which can only add to what titles seem to share.
    """
    known = np.unique(b[b >= 0])
    if len(known) <= _GRAMS:
        at = [np.minimum(np.searchsorted(known, x), len(known) - 1) for x in (a, b)]
        n = len(known)
        return *(np.where(known[k] == x, k, n) if n else np.full(x.shape, 0) for x, k in zip((a, b), at, strict=True)), n
    with np.errstate(over="ignore"):
        return *(np.where(x < 0, _GRAMS, ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % _GRAMS) for x in (a, b)), _GRAMS


def _table(columns: np.ndarray, n: int, places: int, up: int, down: int) -> np.ndarray:
    """Bits by (place, column, title): whether a title has the column at a place from ``up`` before to ``down`` behind."""
    titles = columns.shape[1]
    words = -(-titles // 64)
    out = np.zeros((places, n + 1, words), np.uint64)
    at, title = np.nonzero(columns[:places] < n)
    # a title has one column at a place, so that no bit is added twice
    np.add.at(out.reshape(-1), (at * (n + 1) + columns[at, title]) * words + title // 64, np.uint64(1) << (title % 64).astype(np.uint64))
    wide = up + down + 1
    step = max(1, 65536 // ((places + wide) * words))
    for c in range(0, n, step):
        near = np.zeros((places + wide - 1, min(step, n - c), words), np.uint64)
        near[up : up + places] = out[:, c : c + near.shape[1]]
        k = 1
        while 2 * k <= wide:
            near = near[:-k] | near[k:]
            k *= 2
        np.bitwise_or(near[:places], near[wide - k : wide - k + places], out=out[:, c : c + near.shape[1]])
    return out


def _bands(size: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of titles by length that share a table, the longest titles last; ``size`` is in order."""
    out, stop = [], len(size)
    while stop:
        narrow, wide = (int(np.searchsorted(size, size[stop - 1] - n, side="right")) for n in _BAND[:2])
        start = min(narrow, max(wide, stop - _BAND[2]))
        start = int(np.searchsorted(size, size[start]))  # titles of one length stay together
        out.append((start, stop))
        stop = start
    return out[::-1]


def _own_bits(uses: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each title the uses of letters that are ``known``, as bits, and the number of the others."""
    k = np.minimum(np.searchsorted(known, uses), len(known) - 1)
    has = (uses >= 0) & (known[k] == uses)
    at, title = np.nonzero(has)
    bits = np.zeros((_OWN // 64, uses.shape[1]), np.uint64)
    np.add.at(bits, (k[at, title] // 64, title), np.uint64(1) << (k[at, title] % 64).astype(np.uint64))
    return bits, ((uses >= 0) & ~has).sum(axis=0)


def _letters(a: _Side, b: _Side):
    """The titles' letters with their numbers, the commonest as bits of their own."""
    uses = [x.uses() for x in (a, b)]
    known, often = np.unique(uses[1][uses[1] >= 0], return_counts=True)
    known = np.sort(known[np.argsort(-often, kind="stable")[:_OWN]])
    return [_own_bits(x, known) if len(known) else (np.zeros((_OWN // 64, x.shape[1]), np.uint64), (x >= 0).sum(axis=0)) for x in uses]


def _share_letters(ours, theirs, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Pairs that may have the ``need`` letters in common, in any order."""
    shared = np.minimum(ours[1].take(i, mode="clip"), theirs[1].take(j, mode="clip"))
    for x, y in zip(ours[0], theirs[0], strict=True):
        shared += np.bitwise_count(x.take(i, mode="clip") & y.take(j, mode="clip"))
    return np.flatnonzero(shared >= need)


def _added(rows: Iterator[np.ndarray]) -> list[np.ndarray]:
    """Sums of bits at the same place, as bits from the lowest on: two are taken in at a time, what carries goes up."""
    sums: list[np.ndarray] = []
    waiting: list[np.ndarray | None] = []

    def add(k: int, x: np.ndarray) -> None:
        if k == len(sums):
            sums.append(x)
            waiting.append(None)
        elif waiting[k] is None:
            waiting[k] = x
        else:
            y, waiting[k] = waiting[k], None
            u = sums[k] ^ x
            x &= sums[k]
            x |= u & y
            u ^= y
            sums[k] = u
            add(k + 1, x)

    for x in rows:
        add(0, x)
    k = 0
    while k < len(sums):
        if waiting[k] is not None:
            x, waiting[k] = waiting[k], None
            carry = sums[k] & x
            sums[k] = sums[k] ^ x
            add(k + 1, carry)
        k += 1
    return sums


def _at_least(sums: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Bits that say whether a sum is at least its column's number of ``least``."""
    bits = np.packbits(least[None, :] >> np.arange(_BITS)[:, None] & 1, axis=1, bitorder="little").view(np.uint64)
    good = np.full(sums[0].shape, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(_BITS):
        free = ~bits[k]
        if k < len(sums):
            good &= sums[k] | free
            good |= sums[k] & free
        else:
            good &= free
    return good


def _common_within(masks: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray, other: np.ndarray, sizes: np.ndarray, need: np.ndarray, up: int, down: int) -> np.ndarray:
    """Pairs whose common subsequence, its places at most ``up`` and ``down`` apart, has the ``need`` characters.

    A pair is a title, as bits by code from ``first`` of ``masks`` on and its ``size``, and a column ``other`` of codes.
    """
    left, n = np.arange(len(first)), len(first)
    low = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64) >> (_WORD - size).astype(np.uint64)
    v, u, w = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    code, at = np.empty(n, codes.dtype), np.empty(n, np.int64)
    longest = int(sizes.max(initial=0))
    with np.errstate(over="ignore"):
        for q in range(longest):
            if q in _LOOKS:
                stay = np.flatnonzero(np.bitwise_count(~v & low) + np.maximum(sizes - q, 0) >= need)
                left, low, v, first, other, sizes, need = (x[stay] for x in (left, low, v, first, other, sizes, need))
                u, w, code, at = (x[: len(stay)] for x in (u, w, code, at))
            near = ((1 << min(_WORD, q + up + 1)) - 1) & ~((1 << max(0, q - down)) - 1)
            np.take(codes[q], other, out=code, mode="clip")  # nothing is out of bounds; the check would cost a copy
            np.add(code, first, out=at)
            np.take(masks, at, out=u, mode="clip")
            u &= np.uint64(near)
            u &= v
            np.subtract(v, u, out=w)
            v += u
            v |= w
    return left[np.bitwise_count(~v & low) >= need]


def _needs(size: np.ndarray, other: np.ndarray, ratio: float) -> np.ndarray:
    """Matching characters that pairs of such lengths need."""
    return np.floor(ratio * (size + other) / 2 - 1e-9).astype(np.int64) + 1


def _short_pairs(a: _Side, b: _Side, letters: int, ratio: float, same: bool) -> Iterator[tuple[int, int]]:
    """Titles of up to 64 characters that have the common subsequence, by number; of one block with itself each pair once."""
    ours, theirs, n = _columns(a.pairs(letters), b.pairs(letters))
    letter = _letters(a, b)
    bands = _bands(b.size[: b.short])
    for x, (a0, a1) in enumerate(_bands(a.size[: a.short])):
        for y in range(x if same else 0, len(bands)):
            b0, b1 = bands[y]
            lengths, others = np.unique(a.size[a0:a1])[:, None], np.unique(b.size[b0:b1])[None, :]
            need = _needs(lengths, others, ratio)
            can = need <= np.minimum(lengths, others)
            if not can.any():
                continue
            up, down = int((lengths - need)[can].max()), int((others - need)[can].max())
            table = _table(theirs[:, b0:b1], n, int(max(lengths.max(), others.max())) - 1, up, down)
            filled = np.full(table.shape[2] * 64, -1)
            filled[: b1 - b0] = b.size[b0:b1]
            asked = max(32, _SUMMED // table.shape[2])
            for start in range(a0, a1, asked):
                stop = min(start + asked, a1)
                skip = (start - b0) // 64 if same and x == y else 0  # titles before are done
                size, other = a.size[start:stop], filled[skip * 64 :]
                sums = _added(table[p, :, skip:][ours[p, start:stop]] if skip else table[p].take(ours[p, start:stop], axis=0) for p in range(size[-1] - 1))
                every = np.unique(size)[:, None]
                need = _needs(every, other[None, :], ratio)
                least = np.where(need <= np.minimum(every, other), np.maximum(3 * need - every - other - 1, 0), (1 << _BITS) - 1).min(axis=0)
                met = np.flatnonzero(np.unpackbits(_at_least(sums, least).view(np.uint8).reshape(-1), bitorder="little").view(bool))
                masks = np.zeros((len(size), letters + 1), np.uint64)
                place, title = np.nonzero(a.codes[:, start:stop] < letters)
                np.add.at(masks, (title, a.codes[place, start + title]), np.uint64(1) << place.astype(np.uint64))
                for k in range(0, len(met), _PAIRS):
                    i = met[k : k + _PAIRS] // len(other)
                    j = met[k : k + _PAIRS] - i * len(other)
                    need = _needs(size[i], other[j], ratio)
                    good = need <= np.minimum(size[i], other[j])
                    if same:
                        good &= j + skip * 64 + b0 > i + start
                    i, j, need = i[good], j[good], need[good]
                    good = _share_letters(letter[0], letter[1], i + start, j + (skip * 64 + b0), need)
                    i, j, need = i[good], j[good], need[good]
                    found = _common_within(masks.reshape(-1), i * (letters + 1), size[i], b.codes[:, b0 + skip * 64 : b1], j, other[j], need, up, down)
                    yield from zip((i[found] + start).tolist(), (j[found] + skip * 64 + b0).tolist(), strict=True)


def _long_pairs(a: _Side, b: _Side, ratio: float, same: bool) -> Iterator[tuple[int, int]]:
    """Titles, one of them of more than 64 characters, that share the pairs of characters, by number; of one block with itself each pair once."""
    for start in range(0, len(a.texts), _CHUNK):
        size = a.size[start : start + _CHUNK]
        lo = np.searchsorted(b.size, size[0] * ratio / (2 - ratio) - 1e-6)
        hi = np.searchsorted(b.size, size[-1] * (2 - ratio) / ratio + 1e-6, side="right")
        if size[-1] <= _WORD:
            lo = max(lo, b.short)
        if lo >= hi:
            continue
        both = size[:, None] + b.size[None, lo:hi]
        need = _needs(size[:, None], b.size[None, lo:hi], ratio)
        met = (a.grams[start : start + _CHUNK] @ b.grams[lo:hi].T >= 3 * need - both - 1) & (need <= np.minimum(size[:, None], b.size[None, lo:hi]))
        met &= (size[:, None] > _WORD) | (b.size[None, lo:hi] > _WORD)
        for i, j in zip(*np.nonzero(met), strict=True):
            if not same or j + lo > i + start:
                yield i + start, j + lo


def _links(a: _Side, b: _Side, letters: int, ratio: float, same: bool) -> Iterator[tuple[str, str]]:
    """Titles of two blocks that are alike; of one block with itself each pair once."""
    for pairs in (_short_pairs(a, b, letters, ratio, same), _long_pairs(a, b, ratio, same)):
        for i, j in pairs:
            x, y = sorted((a.texts[i], b.texts[j]))
            if SequenceMatcher(None, x, y).quick_ratio() > ratio and alike(x, y, ratio):
                yield x, y


def _met(ratio: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        own = pdf["own"].to_numpy()
        alphabet = np.unique(_points(pdf["title"].tolist())[1])
        a = _Side(pdf["title"][own == i].tolist(), alphabet)
        b = a if i == j else _Side(pdf["title"][own == j].tolist(), alphabet)
        return pd.DataFrame(list(_links(a, b, len(alphabet), ratio, i == j)), columns=["a", "b"], dtype=object)

    return run


def like_titles(df: DataFrame, ratio: float = 0.80, rows: int = ROWS) -> DataFrame:
    """(a, b) for all pairs of unlike titles of ``df.title`` whose matching-blocks ratio is over ``ratio``, which is over 2/3.

    Titles of one character or none are like themselves only.  The pairs that meet grow
    with the square of the titles; what is shipped is each title once for each block of
    about ``rows``, or of fewer as long as there are tasks for all cores.
    """
    if ratio <= 2 / 3:
        raise ValueError("ratio has to be over 2/3 for titles to share pairs of characters")
    titles = durable(df.select("title").filter("char_length(title) > 1").distinct())
    count, tasks = titles.count(), 4 * df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-count // rows), min(-(-count // _FEWEST), math.ceil(tasks**0.5)))
    k = F.sequence(F.lit(0), F.lit(blocks - 1))
    own = titles.select("title", F.pmod(F.xxhash64("title"), F.lit(blocks)).cast("int").alias("own"), F.explode(k).alias("k"))
    met = own.select("title", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
    tasks = min(blocks * (blocks + 1), 2000)  # by number, as small partitions that are merged would be one task
    return met.repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(_met(ratio), "a string, b string")
