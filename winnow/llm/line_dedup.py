"""Removal of lines that several documents share.

Lines are exploded to (hash of the normalised line, position); text stays
behind.  Distinct documents are counted for each hash, and only the positions to
drop travel back to the documents, which are then put together by position.
All of it is DataFrame operations: the count is pre-aggregated before its
shuffle, and the join with the repeated hashes deals both sides anew, so that
adaptive execution can split it where a line is very common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, col, keyed, row_key, split_join, text_of


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines that aren't at the positions ``dropped`` (ascending), in time linear in both."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drops lines found in ``min_docs`` documents or more, but for the smallest id that holds them.

    Result: (id, n_lines, n_dropped, kept_text) and the columns ``carry``, one row for
    each row in.  Lines
    are split at ``\\n``; those whose key (see ``line_key``) has fewer than
    ``min_chars`` code points always stay.  Within the document of the smallest
    id every copy of the line stays.

    Defined cases: a null or empty text is one empty line; repeated rows are one
    document for the count and each lose or keep the same lines; ids that are
    null come after all others and count as one document; columns other than the
    two named aren't read.
    """
    texts = keyed(docs, id_col, text_col)
    lines = texts.select("_key", F.posexplode(F.split("_text", "\n", -1)).alias("at", "line"))
    keys = lines.select("_key", "at", line_key(F.col("line")).alias("line")).filter(F.char_length("line") >= min_chars)
    hashed = keys.select("_key", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))

    held = hashed.select("a", "b", F.struct(F.col("_key.id").isNull().alias("none"), F.col("_key.id").alias("id")).alias("doc"))
    if min_docs == 2:  # two documents: the smallest id isn't the largest
        found = held.groupBy("a", "b").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner <> last")
    else:
        found = held.distinct().groupBy("a", "b").agg(F.min("doc").alias("owner"), F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    shared = found.select("a", F.col("b").alias("_b"), "owner")

    drop = split_join(hashed, shared, "a").filter("b = _b").filter(~F.col("_key.id").eqNullSafe(F.col("owner.id")))
    places = drop.groupBy("_key").agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    extra = [c for c in carry if c not in (id_col, text_col)]
    whole = docs.select(row_key(id_col, text_col).alias("_key"), text_of(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *[col(c) for c in extra]).alias("_carry"))
    split = whole.join(places, "_key", "left").select(F.col("_key.id").alias("id"), F.split("_text", "\n", -1).alias("lines"), "dropped", "_carry")
    size = F.size("lines").cast("long")
    gone = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(_kept(F.col("lines"), F.col("dropped")))
    return split.select(F.col("id").alias(id_col), size.alias("n_lines"), gone.alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"), *[F.col("_carry").getField(c).alias(c) for c in extra])
