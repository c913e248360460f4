"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.llm.frames import fresh, listed, text_of
from blendspark.operators.lineage import cut

PREFIX_CHARS = 256
#: The filter of surviving prefixes has this many buckets, whatever the input: its
#: broadcast is at most that many longs.
BUCKETS = 1 << 18


def duplicate_groups(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """The group of equal texts of every row.

    docs: doc_id, text, anything else.  Returns one row per row of docs: row_id (a
    number of the row), doc_id, the ``carry`` columns, keep_id, keep_row, group_size,
    kept.  Null text counts as empty.  Of a group the row with the largest doc_id
    stays (null is the smallest; among rows that repeat a doc_id, the last read), so
    exactly one stays.  Empty input gives an empty result; other columns are ignored.

    Rows are grouped by length, those that share one by the hash of their prefix,
    and only those that share both have their whole text hashed.  That hash is taken
    where the text is read: texts are never shuffled.  Which rows need it is asked of
    a filter of fixed size; a false hit costs one hash and changes no result.  Groups
    are aggregated before the shuffle and joined back, so a crowd of copies meets in
    no task; AQE splits its key in the join.
    """
    text = text_of(docs)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("text"),
        F.octet_length(text).alias("bytes"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"),
        *[c.alias(n) for n, c in (carry or {}).items()],
    )
    lengths = rows.groupBy("bytes").count().where("count > 1").select("bytes")
    prefixes = (
        rows.select("bytes", "prefix").groupBy("bytes", "prefix").count().where("count > 1")
        .join(lengths, "bytes", "left_semi")
    )
    bucket = F.pmod(F.xxhash64("bytes", "prefix"), F.lit(BUCKETS))
    filled = prefixes.select(bucket.alias("bucket"), F.lit(True).alias("_shared")).distinct()
    hashed = cut(
        rows.withColumn("bucket", bucket)
        .join(F.broadcast(filled), "bucket", "left")
        .withColumn("full", F.when(F.col("_shared"), F.sha2("text", 256)))
        .drop("text", "bucket", "_shared", "prefix", "bytes")
    )
    groups = cut(  # written, so that AQE may split a crowd's key in the join below
        hashed.where("full is not null")
        .groupBy("full")
        .agg(F.count("*").alias("_size"), F.max(F.struct("doc_id", "row_id")).alias("_keep"))
        .where("_size > 1")
    )
    size = F.coalesce("_size", F.lit(1).cast("long"))
    # Rows that need no full hash meet nothing; their own number spreads them.
    keyed = hashed.withColumn("full", F.coalesce("full", F.col("row_id").cast("string")))
    return keyed.join(groups, "full", "left").select(
        "row_id", "doc_id", *(carry or {}),
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("_keep.row_id", "row_id").alias("keep_row"),
        size.alias("group_size"),
        F.coalesce(F.col("_keep.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose text another row has; columns stay.

    The decisions are keyed by row number, so docs must read in the same order each
    time (files do).
    """
    gone = listed(duplicate_groups(docs).where("not kept").select(F.col("row_id").alias("_gone")))
    row = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(gone, numbered[row] == gone["_gone"], "left_anti").drop(row)
