"""Helpers shared by the text operators: row keys, checkpoints and vectorised word splitting."""

from __future__ import annotations

import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; the only characters that separate words.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_name(id_col: str, taken: tuple[str, ...]) -> None:
    """Raises where the id column is named as another column of a result."""
    if id_col in taken:
        raise ValueError(f"the id column may not be named {id_col}, as a column of the result is")


def text_of(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """(id, hash of the text): tells apart rows that share an id, and joins null ids like any other."""
    return F.struct(col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``_key``, ``_text``: all that an operator on texts has to carry."""
    return docs.select(row_key(id_col, text_col).alias("_key"), text_of(text_col).alias("_text"))


def key_type(docs: DataFrame, id_col: str) -> str:
    """DDL of ``_key``."""
    return f"struct<id:{docs.schema[id_col].dataType.simpleString()},h:bigint>"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; the fast built-in serves texts without other letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one serves a local session (tests); a cluster has
    to name one that all machines share.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context._jsc.sc().getCheckpointDir()
    return named or folder.get()


def shared(df: DataFrame) -> DataFrame:
    """The rows of ``df`` cut from their lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written to the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def split_join(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with what was aggregated by one of their columns, a long.

    It is joined under another name than it was grouped by, for which both sides are
    dealt anew, so that adaptive execution can split a common key's rows.
    """
    other = f"_{key}_"
    return rows.withColumn(other, F.bitwise_not(key)).join(sums.withColumn(other, F.bitwise_not(key)).drop(key), other).drop(other)


#: Byte tables for Words: A-Z lower-cased; the same with ASCII punctuation as space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = LOWER.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and each row's offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str | int = "_text", most: int = 2 << 20):
    """Cuts a batch between rows into slices of about ``most`` bytes of text, one row at least."""
    _, offsets = buffers(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = min(end, n)


class Words:
    """The words of many texts at once: byte ranges, the row of each, and 64-bit hashes.

    With ``apart``, each letter from U+3000 on, where scripts without spaces are, is a word.
    """

    def __init__(self, texts: pa.Array, fold: np.ndarray | None = None, apart: bool = False):
        data, self.offsets = buffers(texts)
        data = data if fold is None else fold[data]
        self.data = data
        solid = ~_IS_SPACE[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        if apart:
            lead = np.flatnonzero(data >= 0xE3)
            after = lead + np.where(data[lead] < 0xF0, 3, 4)
            first[lead] = True
            last[after - 1] = True
            last[lead[lead > 0] - 1] = solid[lead[lead > 0] - 1]
            after = after[after < len(data)]
            first[after] = solid[after]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: bounds[r]: index of the first word of row r; one more at the end.
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A polynomial of each word's bytes (of the first ``most``) modulo 2^64, mixed."""
        if not len(self):
            return np.zeros(0, np.uint64)
        powers, inverse = _powers(1 << int(len(self.data)).bit_length())
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.data) + 1, np.uint64)
                part = self.data.astype(np.uint64)
                part += np.uint64(1)
                part *= powers[: len(part)]
                np.cumsum(part, out=self._sums[1:])
            ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
            return mix((self._sums[ends] - self._sums[self.starts]) * inverse[self.starts])


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base, from the first, and of its inverse modulo 2^64, from the zeroth."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(size, _PRIME, np.uint64))
        inverse = np.full(size, pow(int(_PRIME), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        return powers, np.cumprod(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (a public finalising permutation)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of all but its last item and that item's."""
    with np.errstate(over="ignore"):
        return mix(left * _STEP + right)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive items (runs across rows included; callers leave these out)."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _STEP + words[k : k + size]
    return mix(out)
