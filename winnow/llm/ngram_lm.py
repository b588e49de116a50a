"""Language-model scores by a weighted backoff automaton that every block of texts gets its part of.

The model holds the counts of all n-grams up to ``order`` in the training texts.
Its states are the n-grams that occur, its arcs lead from a context by a token to
the longer n-gram, and a state without an arc for a token passes on over its
failure arc, to its longest proper suffix.  Smoothing is a Dirichlet prior:

    p(w | context) = (c(context w) + strength * p(w | shorter)) / (c(context) + strength)

so a failure arc weighs strength / (c(context) + strength), and the shortest
distribution is (c(w) + 1) / (N + V + 1).  It needs nothing but counts.  Contexts of
one word and of more have strengths of their own.

No machine holds the model.  Texts are dealt to blocks of bounded size by a hash of
their key.  Each block sends its distinct n-grams, as sorted 56-bit hashes with its
own training counts, to the partitions of the hash range; these add up the counts of
all blocks and answer each block for just what it asked.  A block then has all
states and arcs that its texts can reach, builds that part of the automaton as
arrays, and traverses its texts from left to right.  Only ranges in which a block has
n-grams get a row of it, so there are never more rows than n-grams; with larger blocks
(``block_bytes``) each row carries more of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, key_type, keyed, mix, slices

_START = np.uint64(0x5DEECE66D1234567)
_END = np.uint64(0x2545F4914F6CDD1D)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LANE = 512
#: Bits of a hash by which n-grams are told apart: of 10^11 different n-grams, some two in a million share another's.
_BITS = 56


def _grown(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * _STEP + right)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row between a start and an end; where each row begins, and the end."""
    parts, sizes = [], []
    for batch in table.combine_chunks().to_batches():
        for part in slices(batch):
            words = Words(part.column("_text"), LOWER)
            n = np.diff(words.bounds)
            out = np.full(len(words) + 2 * len(n), _END, np.uint64)
            first = words.bounds[:-1] + 2 * np.arange(len(n))
            out[first] = _START
            if len(words):
                out[np.arange(len(words)) + 2 * words.rows + 1] = words.hashes()
            parts.append(out)
            sizes.append(n + 2)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _grams(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the k tokens that end at each position, for k from 1; 0 where the row has fewer before it."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    grams = [_grown(np.ones_like(tokens), tokens)]
    for k in range(2, order + 1):
        g = np.zeros_like(tokens)
        g[1:] = _grown(grams[-1][:-1], tokens[1:])
        g[place < k - 1] = 0
        grams.append(g)
    return grams


def _keys(grams: list[np.ndarray]) -> np.ndarray:
    """All n-grams, one order after the other, by ``_BITS`` bits of their hashes."""
    return np.concatenate(grams) >> np.uint64(64 - _BITS)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each of ``parts`` equal hash ranges within sorted keys."""
    edges = [_low(i, parts) for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def _low(part: int, parts: int) -> int:
    """Where a hash range begins."""
    return (int(part) << _BITS) // parts


def _packed(keys: np.ndarray, low: int) -> bytes:
    """Ascending keys as differences, the first from ``low``: bytes of one place after the other, compressed."""
    steps = np.diff(keys, prepend=np.uint64(low))
    wide = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return _small(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())


def _unpacked(data: bytes, n: int, low: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if n:
        places = np.frombuffer(_large(data), np.uint8).reshape(-1, n)
        wide[:, : len(places)] = places.T
    return np.cumsum(wide.reshape(-1).view(np.uint64), dtype=np.uint64) + np.uint64(low)


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _large(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in a byte each, and those of 255 or more in eight after them, compressed."""
    return _small(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes())


def _counts(data: bytes, n: int) -> np.ndarray:
    data = _large(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, n)
    return out


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way to their blocks."""
    for batch in batches:
        at = batch.schema.names.index("_text")
        texts = pa.array([_small(x) for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
        yield batch.set_column(at, pa.field("_text", pa.binary()), texts)


def _opened(table: pa.Table) -> pa.Table:
    at = table.schema.names.index("_text")
    return table.set_column(at, "_text", pa.array([_large(x) for x in table.column(at).to_pylist()], pa.binary()).cast(pa.string()))


def _ask(order: int, parts: int):
    """A block's distinct n-grams and training counts, a row for each hash range."""

    def ask(table: pa.Table) -> pa.Table:
        table = _opened(table)
        tokens, bounds = _tokens(table)
        learned = np.repeat(table.column("learn").to_numpy(), np.diff(bounds))
        grams = _grams(tokens, bounds, order)
        keys, at = np.unique(_keys(grams), return_inverse=True)
        counts = np.bincount(at, np.concatenate([learned] * order), len(keys)).astype(np.int64)
        cuts = _part(keys, parts)
        some = np.flatnonzero(np.diff(cuts))
        blk = table.column("blk")[0].as_py() if table.num_rows else 0
        return pa.table(
            {
                "part": pa.array(some, pa.int32()),
                "blk": pa.array([blk] * len(some), pa.int64()),
                "n": pa.array(np.diff(cuts)[some], pa.int32()),
                "keys": pa.array([_packed(keys[cuts[p] : cuts[p + 1]], _low(p, parts)) for p in some], pa.binary()),
                "counts": pa.array([_narrow(counts[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()),
            }
        )

    return ask


def _answer(parts: int):
    """Adds up the counts of a hash range over all blocks; each block's row comes back with the sums."""

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        low = _low(table.column("part")[0].as_py(), parts)
        keys = np.concatenate([_unpacked(x, n, low) for x, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([_counts(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        _, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(sums, at, counts)
        back, ends = sums[at], np.cumsum([0, *sizes])
        return pa.table({"part": table.column("part"), "blk": table.column("blk"), "n": table.column("n"), "sums": pa.array([_narrow(back[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    return answer


def _traverse(inverse: list[np.ndarray], counts: np.ndarray, arc: np.ndarray, fail: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 of each row's probability; all lanes take one step to the right at a time.

    A lane is a row or a piece of a long one.  What it carries is its state: the
    length of the longest context that the model has.  A piece starts from the
    state that the tokens before it lead to.
    """
    order = len(inverse)
    first, last, owner = [], [], []
    for r, (a, b) in enumerate(zip(bounds[:-1] + 1, bounds[1:], strict=True)):
        cut = np.arange(a, b, _LANE)
        first.append(cut)
        last.append(np.append(cut[1:], b))
        owner.append(np.full(len(cut), r))
    first, last, owner = map(np.concatenate, (first, last, owner))
    by = np.argsort(first - last, kind="stable")
    first, last, owner = first[by], last[by], owner[by]
    size = last - first
    state = np.zeros(len(first), np.int64)
    place = first - bounds[owner]
    for k in range(1, order):
        known = place >= k
        known[known] = counts[inverse[k - 1][first[known] - 1]] > 0
        state[known] = k
    table = np.stack(inverse)
    total = np.zeros(len(first))
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))
        at, s = first[:live] + step, state[:live]
        to = table[s, at]
        lost = np.flatnonzero((s > 0) & (counts[to] == 0))
        while len(lost):  # over failure arcs to shorter contexts
            total[lost] += fail[table[s[lost] - 1, at[lost] - 1]]
            s[lost] -= 1
            to[lost] = table[s[lost], at[lost]]
            lost = lost[(s[lost] > 0) & (counts[to[lost]] == 0)]
        total[:live] += arc[to]
        state[:live] = np.where(counts[to] > 0, np.minimum(s + 1, order - 1), 0)
    return np.bincount(owner, total, len(bounds) - 1)


def _score(order: int, n: int, v: int, strengths: np.ndarray):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _opened(texts)
        tokens, bounds = _tokens(texts)
        grams = _grams(tokens, bounds, order)
        keys, first, at = np.unique(_keys(grams), return_index=True, return_inverse=True)
        inverse = list(at.reshape(order, -1))
        answers = answers.sort_by("part")
        counts = np.concatenate([_counts(x, n) for x, n in zip(answers.column("sums").to_pylist(), answers.column("n").to_pylist(), strict=True)] or [np.zeros(0, np.int64)])
        size = len(tokens)
        prob = np.zeros(len(keys))
        for k in range(1, order + 1):  # from short n-grams to long: each arc's weight has its suffix's in it
            own = np.flatnonzero((first // max(1, size) == k - 1) & (keys != 0))
            end = first[own] % max(1, size)
            if k == 1:
                prob[own] = (counts[own] + 1) / (n + v + 1)
            else:
                prob[own] = (counts[own] + strengths[k - 2] * prob[inverse[k - 2][end]]) / (counts[inverse[k - 2][end - 1]] + strengths[k - 2])
        arc = np.log10(np.where(prob > 0, prob, 1))
        strength = strengths[first // max(1, size)]
        fail = np.log10(strength / (counts + strength))
        total = _traverse(inverse, counts, arc, fail, bounds)
        inner = np.ones(size, bool)
        inner[bounds[:-1]] = False
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[inner]
        single = inverse[0][inner]
        rows = len(bounds) - 1
        base = np.bincount(row, np.log10((counts[single] + 1) / (n + v + 1)), rows)
        known = np.bincount(row, counts[single] > 0, rows).astype(np.int64)
        return pa.table({"id": texts.column("_key").combine_chunks().field("id"), "learn": texts.column("learn"), "n_tokens": pa.array(np.diff(bounds) - 1), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(total)})

    return score


def _totals(parts: int):
    """Distinct training tokens in one task, a row for each hash range; the task's number of tokens is in the first."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], 0, 0
        for batch in batches:
            for part in slices(batch):
                tokens, bounds = _tokens(pa.Table.from_batches([part]))
                tokens = np.delete(tokens, bounds[:-1])
                size += len(tokens)
                keys.append(np.unique(_keys([_grown(np.ones_like(tokens), tokens)])))
                held += len(keys[-1])
                if held > 4_000_000:
                    keys = [np.unique(np.concatenate(keys))]
                    held = len(keys[0])
        if keys:
            k = np.unique(np.concatenate(keys))
            cuts = _part(k, parts)
            some = np.flatnonzero(np.diff(cuts))
            sizes = np.zeros(len(some), np.int64)
            sizes[:1] = size
            packs = [_packed(k[cuts[p] : cuts[p + 1]], _low(p, parts)) for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(cuts)[some], pa.int32()), pa.array(packs, pa.binary()), pa.array(sizes)], ["part", "n", "keys", "tokens"])

    return totals


def _distinct(parts: int):
    def distinct(table: pa.Table) -> pa.Table:
        low = _low(table.column("part")[0].as_py(), parts)
        keys = np.unique(np.concatenate([_unpacked(x, n, low) for x, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)]))
        return pa.table({"n": pa.array([sum(table.column("tokens").to_pylist())]), "v": pa.array([len(keys)])})

    return distinct


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, strengths: tuple[float, ...] = (500.0, 20.0), parts: int = 7, hold: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """log10 probability of each whole text under an n-gram model of the texts that aren't held out.

    Result: (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row
    for each row in.  Tokens are the words, A-Z lower-cased, and one end for each
    text.  A row is held out if crc32 of its id as text leaves ``hold`` modulo
    ``parts``.  ``base_score`` uses single tokens only, with one added to each count.
    Tokens and n-grams are told apart by 56-bit hashes.  ``strengths`` are those of
    contexts of one word, two words and so on; the last also holds for longer ones.

    Defined cases: a null or empty text is the end alone; repeated rows each count
    and each come out; a row with a null id is learned from; without any training
    text all counts are 0; other columns aren't read.
    """
    texts = keyed(docs, id_col, text_col).withColumn("learn", F.coalesce(F.crc32(F.col("_key.id").cast("string").cast("binary")) % parts != hold, F.lit(True)))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = ranges = max(1, math.ceil(size / block_bytes))
    sums = texts.filter("learn").mapInArrow(_totals(ranges), "part int, n int, keys binary, tokens bigint").groupBy("part").applyInArrow(_distinct(ranges), "n bigint, v bigint")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    dealt = texts.withColumn("blk", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    dealt = dealt.mapInArrow(_closed, f"_key {key_type(docs, id_col)}, _text binary, learn boolean, blk bigint")
    asked = dealt.groupBy("blk").applyInArrow(_ask(order, ranges), "part int, blk bigint, n int, keys binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(_answer(ranges), "part int, blk bigint, n int, sums binary")
    out = f"id {docs.schema[id_col].dataType.simpleString()}, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = dealt.groupBy("blk").cogroup(answered.groupBy("blk")).applyInArrow(_score(order, int(total[0]), int(total[1]), np.array([*strengths[:order], *strengths[-1:] * (order - len(strengths))])), out)
    return scored.select(F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(int(total[0])).cast("long").alias("train_tokens"), "base_score", "score")
