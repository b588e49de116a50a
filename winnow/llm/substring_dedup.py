"""Removal of word windows that occur more than once, by super-k-mer partitioning.

Each window of ``window`` words has a minimiser: the smallest hash among its
sequences of ``grain`` words.  Consecutive windows with the same minimiser form
a super-k-mer.  Equal windows have equal minimisers, so

1. a light pass counts minimisers (8 bytes for some 13 words); a super-k-mer whose
   minimiser occurs nowhere else can't hold a repeated window and goes no further;
2. each of the others is cut from its text as one packed string that travels to
   its minimiser's bucket, where sorting the windows counts them exactly;
3. a minimiser that occurs ``bucket`` times or more is dealt to as many buckets as
   keep each at about that size.  Each of these sorts and counts as any other, and
   hands on one of each window that it has seen, under the window's 128-bit digest,
   to find those that are single in their bucket but not over all buckets.

Only intervals of words return to the documents.  No step needs more rows of a
key together than a bucket holds, or than there are buckets of one minimiser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hashes, key_type, keyed, shared, slices


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest among each ``width`` consecutive values."""

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    at, have = np.arange(len(values)), 1
    while 2 * have <= width:
        at, have = better(at[:-have], at[have:]), 2 * have
    rest = width - have
    return better(at[: len(at) - rest], at[rest:]) if rest else at


def _runs(words: Words, window: int, grain: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of many rows: row, first window, number of windows, minimiser."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(words) < window:
        return empty
    grams = gram_hashes(words.hashes(), grain)
    at = _smallest(grams, window - grain + 1)
    row = words.rows[: len(at)]
    first = np.flatnonzero(np.arange(len(at)) + window <= words.bounds[row + 1])
    if not len(first):
        return empty
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) != 1) | (at[first[1:]] != at[first[:-1]])
    begin = np.flatnonzero(new)
    start = first[begin]
    return row[start], start - words.bounds[row[start]], np.diff(np.append(begin, len(first))), grams[at[start]]


def _find(window: int, grain: int):
    """Minimisers and places (first window, number of windows) of each text's super-k-mers."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, start, n, mini = _runs(Words(part.column("_text")), window, grain)
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (mini.view(np.int64), start << 32 | n)]
                yield pa.RecordBatch.from_arrays([part.column("_key"), *lists], ["_key", "minis", "places"])

    return find


def _listed(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's items begin and end, and all items."""
    return np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64), lists.flatten()


def _cut(window: int):
    """Packed strings of the candidate super-k-mers of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                bounds, runs = _listed(part.column("runs"))
                place = runs.field("place").to_numpy()
                start, last = place >> 32, (place >> 32) + (place & 0xFFFFFFFF) + window - 1
                packs = []
                for r, text in enumerate(part.column("_text").to_pylist()):
                    words = text.encode().split()
                    joined = b" ".join(words)
                    at = np.zeros(len(words) + 1, np.int64)
                    np.cumsum([len(w) + 1 for w in words], out=at[1:])
                    own = slice(bounds[r], bounds[r + 1])
                    packs += [joined[a:b] for a, b in zip(at[start[own]].tolist(), (at[last[own]] - 1).tolist(), strict=True)]
                keys = part.column("_key").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), runs.field("mini"), runs.field("deal"), runs.field("deals"), pa.array(packs, pa.binary())], ["_key", "start", "mini", "deal", "deals", "pack"])

    return cut


def _windows(pack: bytes, window: int) -> list[bytes]:
    words = pack.split(b" ")
    at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    return [pack[at[j] : at[j + window] - 1] for j in range(len(words) - window + 1)]


def _repeated(packs: dict[bytes, list[int]], window: int, every: bool) -> tuple[dict[bytes, list[int]], list[tuple[bytes, int, int, bool]]]:
    """Repeated windows of a bucket, by pack; with ``every``, also one of each window: itself, row, place, whether repeated.

    A pack that occurs twice has nothing but repeated windows; the others' are sorted.
    """
    if not every and all(len(rows) > 1 for rows in packs.values()):
        return {p: list(range(p.count(b" ") + 2 - window)) for p in packs}, []
    windows = sorted((w, p, j) for p in packs for j, w in enumerate(_windows(p, window)))
    found: dict[bytes, list[int]] = {}
    one = []
    a = 0
    while a < len(windows):
        w, b = windows[a][0], a + 1
        while b < len(windows) and windows[b][0] == w:
            b += 1
        twice = b - a > 1 or len(packs[windows[a][1]]) > 1
        if twice:
            for _, p, j in windows[a:b]:
                found.setdefault(p, []).append(j)
        if every:
            one.append((w, packs[windows[a][1]][0], windows[a][2], twice))
        a = b
    return {p: sorted(js) for p, js in found.items()}, one


def _spans(js: list[int], window: int) -> list[tuple[int, int]]:
    """Word intervals that the windows at these ascending places cover."""
    out = [[js[0], js[0] + window]]
    for j in js[1:]:
        if j <= out[-1][1]:
            out[-1][1] = j + window
        else:
            out.append([j, j + window])
    return [(a, b) for a, b in out]


def _count(window: int):
    """Counts the windows of each bucket, whose rows come one after the other.

    Rows out: a span of words to remove (``wid`` null), or one window of a bucket that
    isn't its minimiser's only one.
    """

    def results(table: pa.Table) -> pa.Table:
        minis, deals, parts = (table.column(c).to_numpy() for c in ("mini", "deal", "deals"))
        starts, packs = table.column("start").to_pylist(), table.column("pack").to_pylist()
        edges = (np.flatnonzero((np.diff(minis) != 0) | (np.diff(deals) != 0)) + 1).tolist()
        rows, spans, wids, twice = [], [], [], []
        for a, b in zip([0, *edges], [*edges, len(packs)], strict=True):
            every = bool(parts[a] > 1)
            if b - a == 1 and not every:
                continue
            held: dict[bytes, list[int]] = {}
            for r in range(a, b):
                held.setdefault(packs[r], []).append(r)
            found, one = _repeated(held, window, every)
            for p, js in found.items():
                for x, y in _spans(js, window):
                    for r in held[p]:
                        rows.append(r)
                        spans.append(starts[r] + x << 32 | starts[r] + y)
                        wids.append(None)
                        twice.append(True)
            for w, r, j, again in one:
                rows.append(r)
                spans.append(starts[r] + j << 32 | starts[r] + j + window)
                wids.append(xxhash.xxh3_128_digest(w))
                twice.append(again)
        keys = table.column("_key").combine_chunks().take(pa.array(rows, pa.int64()))
        return pa.Table.from_arrays([keys, pa.array(spans, pa.int64()), pa.array(wids, pa.binary()), pa.array(twice, pa.bool_())], ["_key", "span", "wid", "twice"])

    return _by_edge(results, ("mini", "deal"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they are, and those of windows that are single in their bucket but not the only one of their digest."""

    def results(table: pa.Table) -> pa.Table:
        ready = pc.is_null(table.column("wid"))
        table, done = table.filter(pc.invert(ready)), _joined(table.filter(ready).select(["_key", "span"]))
        wids, twice = table.column("wid").to_pylist(), table.column("twice").to_pylist()
        keep = [not again and w in (*wids[max(0, r - 1) : r], *wids[r + 1 : r + 2]) for r, (w, again) in enumerate(zip(wids, twice, strict=True))]
        return pa.concat_tables([done, table.filter(pa.array(keep, pa.bool_())).select(["_key", "span"])])

    return _by_edge(results, ("wid",))(batches)


def _joined(table: pa.Table) -> pa.Table:
    """Spans that touch, of rows sorted by key and span, as one."""
    if not table.num_rows:
        return table
    key, span = table.column("_key").combine_chunks(), table.column("span").to_numpy()
    ids, h = key.field("id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), key.field("h").to_numpy()
    own = np.append(0, np.cumsum((np.diff(ids) != 0) | (np.diff(h) != 0))) << 32  # keys one after the other on one line
    lo, hi = (span >> 32) + own, np.maximum.accumulate((span & 0xFFFFFFFF) + own)
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    last = np.append(first[1:], len(lo)) - 1
    return pa.table({"_key": key.take(pa.array(first)), "span": pa.array(lo[first] - own[first] << 32 | hi[last] - own[last])})


def _by_edge(results, columns: tuple[str, ...]):
    """Feeds rows that are sorted by ``columns`` so that no group is parted; rows with nulls there aren't a group."""

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = pa.array([True] * batch.num_rows)
            for c in columns:
                last = pc.and_(last, pc.fill_null(pc.equal(batch.column(c), batch.column(c)[batch.num_rows - 1]), False))
            whole = batch.num_rows - last.true_count  # the last group may go on in the next batch
            if whole:
                yield from results(pa.Table.from_batches([*held, batch.slice(0, whole)])).to_batches()
                held = []
            held += [batch.slice(whole)] if whole < batch.num_rows else []
        if held:
            yield from results(pa.Table.from_batches(held)).to_batches()

    return feed


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=4 << 20):
            bounds, spans = _listed(part.column("spans"))
            spans = spans.to_numpy(zero_copy_only=False)
            n_words, n_removed, kept = [], [], []
            for r, text in enumerate(part.column("_text").to_pylist()):
                words = text.encode().split()
                left = words
                if bounds[r] < bounds[r + 1]:
                    left, at = [], 0
                    for span in np.sort(spans[bounds[r] : bounds[r + 1]]).tolist():
                        left += words[at : span >> 32]
                        at = max(at, span & 0xFFFFFFFF)
                    left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["_key", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, grain: int = 7, bucket: int = 2000) -> DataFrame:
    """Removes every word that a repeated window covers; (id, n_words, n_removed, kept_text).

    A window is ``window`` consecutive words of one text; it is repeated if its
    words start anywhere else, in the same text or in another.  Windows are
    judged on the input.  One row comes out for each row in.

    Defined cases: a null text has no words; a text shorter than a window keeps
    all its words; words that are kept are joined by one space; repeated rows
    count as further occurrences, so they lose all their windows; a null id is an
    id like any other; columns other than the two named aren't read.
    """
    texts = keyed(docs, id_col, text_col)
    key = key_type(docs, id_col)
    long = texts.filter(F.octet_length("_text") >= 2 * window - 1)
    found = shared(long.mapInArrow(_find(window, grain), f"_key {key}, minis array<bigint>, places array<bigint>"))
    runs = found.select("_key", F.inline(F.arrays_zip(F.col("minis").alias("mini"), F.col("places").alias("place"))))
    often = runs.groupBy("mini").agg(F.count("*").alias("times")).filter("times > 1")
    # Joined on another name than grouped by: both sides are dealt anew, and adaptive execution can split a hot minimiser.
    other = F.bitwise_not("mini").alias("other")
    again = runs.select("_key", "place", other).join(often.select(other, F.ceil(F.col("times") / bucket).cast("int").alias("deals")), "other")
    deal = F.pmod(F.xxhash64("_key", "place"), F.col("deals")).cast("int")
    wanted = again.groupBy("_key").agg(F.collect_set(F.struct("place", F.bitwise_not("other").alias("mini"), deal.alias("deal"), "deals")).alias("runs"))
    packs = texts.join(wanted, "_key").mapInArrow(_cut(window), f"_key {key}, start bigint, mini bigint, deal int, deals int, pack binary")
    counted = packs.repartition("mini", "deal").sortWithinPartitions("mini", "deal").mapInArrow(_count(window), f"_key {key}, span bigint, wid binary, twice boolean")
    merged = counted.repartition("wid", F.expr("CASE WHEN wid IS NULL THEN _key END")).sortWithinPartitions("wid", "_key", "span").mapInArrow(_merge, f"_key {key}, span bigint")
    removed = merged.groupBy("_key").agg(F.collect_set("span").alias("spans"))
    out = texts.join(removed, "_key", "left").mapInArrow(_remove, f"_key {key}, n_words bigint, n_removed bigint, kept_text string")
    return out.select(F.col("_key.id").alias(id_col), "n_words", "n_removed", "kept_text")
