"""Threshold-scaled sketches: every shingle hash below a fixed fraction is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.llm.frames import range_bounds, range_of, ranges_for, text_of

WORDS = 5
#: One of so many hashes is kept.
SCALE = 4


def sketch(text: Column, scale: int = SCALE, words: int = WORDS) -> Column:
    """struct(tag, hashes) of a text.

    hashes: the distinct hashes of all its word shingles that lie in the lowest
    1/scale of the hash range, ascending.  Words are lower-cased runs without white
    space; a text with fewer words has one shingle of them all, one without words
    none.  tag: a hash of the whole text, so that texts too short to keep any hash
    still compare.  Sketches of parts merge into that of the whole by union.
    """
    # The text becomes an array of word hashes once; the lambdas below read it by name.
    parts = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - words, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))

    limit = min((1 << 64) // scale, (1 << 64) - 1) - (1 << 63)
    kept = F.flatten(F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, F.filter(shingles(h), lambda x: x < F.lit(limit))).otherwise(F.array().cast("array<bigint>"))))
    return F.struct(F.xxhash64(text).alias("tag"), F.array_sort(F.array_distinct(kept)).alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketched texts, 0 to 1.  Equal texts have 1;
    two different texts of which neither keeps a hash have 0."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    either = F.size(a["hashes"]) + F.size(b["hashes"]) - both
    return F.when(a["tag"] == b["tag"], 1.0).when(either == 0, 0.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a that b has too; null where a keeps none.
    Sizes of a and b may differ by any factor, as both are thinned alike."""
    return F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.nullif(F.size(a["hashes"]), F.lit(0))


def merge(sketches: Column) -> Column:
    """Aggregate: the hashes of all the sketches of a group together."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches["hashes"]))))


def as_text(s: Column) -> Column:
    """tag:hash,hash,... in hexadecimal."""
    return F.concat(F.hex(s["tag"]), F.lit(":"), F.array_join(F.transform(s["hashes"], lambda x: F.lower(F.hex(x))), ","))


def with_next(rows: DataFrame, **more: Callable[[Column], Column]) -> DataFrame:
    """rows (doc_id, text) with columns made of the text, and the struct ``next``: doc_id,
    text and these columns of the next row by doc_id (after the last: the first).

    Rows are dealt to ranges of doc_id and led inside each; the first row of each
    range goes to the range before it.  Rows move once, and only ids are looked through for
    the first ones.  Null ids come first, rows that repeat an id follow each other by text;
    a single row is its own next.
    """
    ids = rows.select("doc_id")
    bounds = range_bounds(ids, "doc_id", ranges_for(rows) * 4, ids.count())
    ranged = rows.select("doc_id", "text", range_of(F.col("doc_id"), bounds).alias("part"))
    whole = F.struct("doc_id", "text", *[make(F.col("text")).alias(name) for name, make in more.items()])
    led = ranged.select(whole.alias("row"), "part").selectExpr("*", "lead(row) over (partition by part order by row.doc_id nulls first, row.text) as led")
    # One row a range: the number of ranges is fixed by the shuffle setting.
    lowest = ranged.groupBy("part").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    least = F.when(F.col("nulls") == 0, F.col("least")).alias("least")
    first = ranged.join(F.broadcast(lowest.select("part", least)), "part").where(F.col("doc_id").eqNullSafe(F.col("least")))
    heads = (
        first.groupBy("part", "doc_id").agg(F.min("text").alias("text"))
        .selectExpr("doc_id", "text", "lag(part) over (order by part) as before", "max(part) over () as last")
        .select(F.expr("coalesce(before, last)").alias("part"), whole.alias("own"))
    )
    return led.join(heads, "part").select("row.*", F.coalesce("led", "own").alias("next"))


def edited(text: Column, donor: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many
    (or all) of the donor."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(donor, F.lit(1), half))


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_text, sketch, edited_sketch, near_edited, near_next.

    Each whole text (null: empty) and its edited text are sketched once; the sketch of
    the next document comes with its row.  Extra columns are ignored.
    """
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    both = (
        with_next(rows, sketch=lambda text: sketch(text, scale))
        .withColumn("edited_text", edited(F.col("text"), F.col("next.text")))
        .withColumn("edited_sketch", sketch(F.col("edited_text"), scale))
    )
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited_text", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )
