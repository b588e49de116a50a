"""Near copies by the exact Jaccard similarity of word shingles.

Candidates meet in buckets: 24 bands of 5 MinHash values, and the groups that SimHash
links make.  A pair at a similarity of 0.8 shares no band with a probability of
(1 - 0.8^5)^24, some 7 in 100,000, and less if it is more alike.  Every link is
verified on the whole shingle sets.

Equal sets are one node.  A small bucket compares all its pairs.  In a large one the
node that shares most with others first meets all others, which costs one comparison
for each; where they aren't one component by then, those outside the largest meet all
others in blocks of bounded size, sets and all (of such buckets with the same nodes,
one does).  So no pair of a bucket that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, gram_hashes, key_type, keyed, shared, slices, split_join
from .components import components
from .simhash import near_prints

BANDS, ROWS = 24, 5
#: Buckets of at most so many nodes compare all pairs.
SMALL = 8
#: Bytes of sets in a block of the nodes that meet all others, and of these others.
HELD, MET = 4 << 20, 16 << 20

_RANDOM = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
_XOR, _FACTOR = _RANDOM[0], _RANDOM[1] | np.uint32(1)


def _shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words, A-Z lower-cased, and the bounds of rows; fewer words are one shingle."""
    words = Words(texts, LOWER)
    hashes, size = words.hashes(), np.diff(words.bounds)
    counts = np.where(size, np.maximum(size - n + 1, 1), 0)
    bounds = np.append(0, np.cumsum(counts))
    row = np.repeat(np.arange(len(size)), counts)
    at = np.arange(len(row)) - bounds[row] + words.bounds[row]
    out = np.zeros(len(row), np.uint64)
    for k in range(1, n + 1):
        own = np.flatnonzero(size[row] == k if k < n else size[row] >= n)
        if len(own):
            out[own] = gram_hashes(hashes, k)[at[own]]
    return out, bounds


def _sets(shingles: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _sketch(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                shingles, bounds = _shingles(part.column("_text"), n)
                sets = _sets(shingles, bounds)
                names = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64)
                prints = np.zeros(len(sets), np.uint64)
                some = np.flatnonzero(np.diff(bounds))
                keys = np.zeros((len(some), BANDS), np.int64)
                if len(some):
                    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    sums = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int64)
                    prints[some] = np.packbits(2 * sums > np.diff(bounds)[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
                    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
                    least = np.stack([np.minimum.reduceat((narrow ^ x) * f, bounds[some]) for x, f in zip(_XOR, _FACTOR, strict=True)], axis=1)
                    for b in range(BANDS):
                        own = np.ascontiguousarray(least[:, b * ROWS : (b + 1) * ROWS])
                        keys[:, b] = np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for x in own], np.uint64).view(np.int64)
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[some + 1] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(keys.ravel()))
                sizes = pa.array([len(x) for x in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(names.view(np.int64)), pa.array(prints.view(np.int64)), sizes, bands], ["_key", "node", "print", "size", "bands"])

    return sketch


def _whole(n: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                sets = [x.tobytes() for x in _sets(*_shingles(part.column("_text"), n))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return whole


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            alike = []
            for a, b in zip(*sets, strict=True):
                same = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(same > 0 and 100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    return verify


def _meet(percent: int):
    """Links between the nodes that a block holds, which come first, and those that it meets; one for each two roots."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            us, vs = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "met", "node", "root", "shingles")), strict=True)
            for bucket, i, j, met, node, root, shingles in rows:
                if now != (bucket, i, j):
                    now, held, index = (bucket, i, j), [], None
                own = np.frombuffer(shingles, np.uint64)
                if not met:
                    held.append((node, root, own))
                    continue
                if index is None and held:
                    sizes = np.array([len(x) for _, _, x in held])
                    every = np.concatenate([x for _, _, x in held])
                    order = np.argsort(every, kind="stable")
                    index, of = every[order], np.repeat(np.arange(len(held)), sizes)[order]
                    names, roots = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
                if not held:
                    continue
                lo, hi = np.searchsorted(index, own, "left"), np.searchsorted(index, own, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                same = np.bincount(of[at], minlength=len(held))
                alike = np.flatnonzero((same > 0) & (100 * same >= percent * (sizes + len(own) - same)) & (roots != root))
                for k in alike[np.unique(roots[alike], return_index=True)[1]].tolist():
                    us.append(min(node, int(names[k])))
                    vs.append(max(node, int(names[k])))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return meet


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, n, node, size): rows of those buckets that hold several nodes."""
    groups = components(near_prints(nodes)).withColumnRenamed("node", "print")
    rows = nodes.select("node", "size", F.explode("bands").alias("bucket")).unionByName(nodes.filter("size > 0").join(groups, "print").select("node", "size", F.xxhash64("root").alias("bucket")))
    several = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return split_join(rows, several, "bucket").select("bucket", "n", "node", "size")


def _size_fits(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b).cast("long")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, least): each distinct shingle set and the smallest key of its rows; links (u, v): enough to join all nodes ``percent`` alike."""
    texts = keyed(docs, id_col, text_col)
    own = texts.mapInArrow(_sketch(shingle), f"_key {key_type(docs, id_col)}, node bigint, print bigint, size int, bands array<bigint>")
    nodes = shared(own.groupBy("node").agg(F.min("_key").alias("least"), F.first("print").alias("print"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    rows = shared(_buckets(nodes))
    large = rows.filter(F.col("n") > SMALL)

    few = rows.filter(F.col("n") <= SMALL)
    small = few.join(few.select("bucket", F.col("node").alias("v"), F.col("size").alias("_s")), "bucket").filter("node < v").filter(_size_fits("size", "_s", percent)).select(F.col("node").alias("u"), "v")
    weight = large.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = large.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "size")).alias("hub"))
    first = split_join(large, hubs, "bucket").filter("node <> hub.node").filter(_size_fits("size", "hub.size", percent)).select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v"))
    pairs = shared(small.unionByName(first).distinct())

    needed = rows.select("node").distinct().join(nodes, "node").select("node", F.col("least").alias("_key"))
    once = texts.groupBy("_key").agg(F.first("_text").alias("_text"))  # dealt by key, as the join wants it
    sets = shared(once.join(needed, "_key").select("node", "_text").mapInArrow(_whole(shingle), "node bigint, shingles binary"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    links = shared(both.select("u", "v", "a", "b").mapInArrow(_verify(percent), "u bigint, v bigint"))

    members = large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = members.groupBy("bucket", "root").agg(F.count("*").alias("share"), F.sum("size").alias("words"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    rank = F.struct("share", "root")
    open_ = shares.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", rank).alias("main"), F.max_by("words", rank).alias("mains"), F.sum("words").alias("words"), F.min("least").alias("least"), F.sum("mark").alias("mark")).filter("roots > 1")
    open_ = open_.groupBy("roots", "words", "least", "mark").agg(F.min_by(F.struct("bucket", "main", "mains"), "bucket").alias("b")).select("b.*", "words")
    blocks = [F.ceil(8 * w / m).cast("int") for w, m in ((F.col("words") - F.col("mains"), HELD), (F.col("words"), MET))]
    members = shared(split_join(members, open_.select("bucket", "main", blocks[0].alias("held"), blocks[1].alias("meet")), "bucket"))
    own_block, other = F.pmod(F.xxhash64("node"), F.col("held")).cast("int"), F.pmod(F.xxhash64("node"), F.col("meet")).cast("int")
    held = members.filter("root <> main").select("bucket", own_block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("meet") - 1)).alias("j"), F.lit(False).alias("met"), "node", "root")
    met = members.select("bucket", F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("i"), other.alias("j"), F.lit(True).alias("met"), "node", "root")
    grid = held.unionByName(met).join(sets, "node").select("bucket", "i", "j", "met", "node", "root", "shingles")
    more = grid.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "met").mapInArrow(_meet(percent), "u bigint, v bigint")
    return nodes.select("node", "least"), shared(links.unionByName(more))


def first_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Keys (``common.row_key``) of the first row, by id, of each group that links of near copies make.

    Words are separated by ASCII white space, and A-Z are lower-cased; shingles are told
    apart by 64-bit hashes.  Texts without words are near copies of each other only.
    """
    nodes, links = near_links(docs, id_col, text_col, shingle, percent)
    named = nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.groupBy("root").agg(F.min("least").alias("_key")).select("_key")
