"""Benchmark passages in documents: winnowed fingerprints meet, hits are extended to whole windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.llm.frames import let, listed, text_of
from blendspark.llm.manifest import small_letters
from blendspark.operators.lineage import cut

#: Words of a window, and of the grams whose least hash stands for it.
SPAN, GRAM = 10, 5
#: Texts are handled in runs of so many window starts, which bounds every array below.
SEGMENT = 2048
# What is no word, and words before small letters are made.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(small_letters(text), NO_WORD), "")


def segments(words: Column, span: int) -> Column:
    """array<struct<at, n, w>>: runs of ``SEGMENT`` words with the span - 1 words behind
    them; at is the place of the first one, n the number of words of the whole text."""
    return let(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(SEGMENT)),
        lambda s: F.struct((s - 1).alias("at"), F.size(w).alias("n"), F.slice(w, s, SEGMENT + span - 1).alias("w")),
    ))


def over_runs(values: Column, k: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each place join over the k values from there on, by doubling; the last k - 1
    places have values without meaning."""
    def grown(x: Column, done: int) -> Column:
        if done == k:
            return x
        step = min(done, k - done)
        ahead = F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0)))
        return let(F.zip_with(x, ahead, join), lambda y: grown(y, done + step))

    return let(values, lambda x: grown(x, 1))


def starts(words: Column, length: int) -> Column:
    """Number of windows of a length that start in a segment."""
    return F.greatest(F.least(F.size(words) - length + 1, F.lit(SEGMENT)), F.lit(0))


def fingerprints(words: Column, lengths: Sequence[int], span: int = SPAN, gram: int = GRAM) -> Column:
    """The distinct fingerprints of a segment.

    For the full span: the least hash of each run of ``span - gram + 1`` grams.  Equal
    windows have equal least hashes, so every shared span is found.  Windows of shorter
    items stand for themselves.
    """
    def prints(h: Column) -> Column:
        found = []
        for m in lengths:
            if m == span:
                each = over_runs(over_runs(h, gram, lambda a, b: F.xxhash64(a, b)), span - gram + 1, lambda a, b: F.least(a, b))
            else:
                each = over_runs(h, m, lambda a, b: F.xxhash64(a, b))
            found.append(F.slice(each, 1, starts(h, m)))
        return F.array_distinct(F.concat(*found))

    return let(F.transform(words, lambda w: F.xxhash64(w)), prints)


def windows(at: Column, words: Column, lengths: Sequence[int]) -> Column:
    """array<struct<start, length, window>>: every window of a segment as text."""
    def of(m: int) -> Column:
        count = starts(words, m)
        each = F.transform(F.sequence(F.lit(1), count), lambda j: F.struct(
            (at + j - 1).alias("start"), F.lit(m).alias("length"), F.array_join(F.slice(words, j, m), " ").alias("window")
        ))
        return F.when(count > 0, each).otherwise(F.array().cast("array<struct<start: int, length: int, window: string>>"))

    return F.concat(*[of(m) for m in lengths])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Which words of which documents stand in the benchmark.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.  A window is
    ``span`` consecutive words of an item; an item with fewer words, but not none, is one
    window.  Returns one row per row of docs: doc_id, n_words, n_hit (words inside any
    occurrence of a window), items (ids, as strings in ascending order, of items with
    occurring windows).

    Null and empty texts have no words.  Rows that repeat a doc_id, or lack one, are
    documents of their own.  Items that share an id count once; an item without id marks
    words but is not listed.  Empty tables: no rows, or no hits.

    Texts are read where they lie: once for the fingerprints, and those that met one again
    for their windows, which are compared as text.  Each is cut to segments first, so a
    very long one is many short rows.  Windows that many items have are joined once; items
    come in at the end, by the distinct windows of a document.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of(benchmark).alias("text"))
    pieces = cut(items.select("item_id", F.explode(segments(words_of(F.col("text")), span)).alias("s")).where("s.n > 0").select(
        "item_id", F.least("s.n", F.lit(span)).alias("m"), F.col("s.at").alias("at"), F.col("s.w").alias("w")
    ))
    lengths = sorted(r.m for r in pieces.select("m").distinct().collect())  # at most ``span`` numbers
    # Rows are known by id and text, whatever the order in which they are read; those that
    # are equal in both have the same result.
    keys = {f"k{seed}": F.xxhash64(F.lit(seed), docs["doc_id"].isNull(), docs["doc_id"], text_of(docs)) for seed in (1, 2)}
    rows = docs.select(*[k.alias(c) for c, k in keys.items()], "doc_id", text_of(docs).alias("text"))
    key = list(keys)
    counted = rows.select(*key, "doc_id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"))
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}
    if not lengths:
        return counted.withColumns(none).drop(*key)

    def by_length(of: Callable[[list[int]], Column], kind: str) -> Column:
        """Items have windows of their own length only."""
        return F.coalesce(*[F.when(F.col("m") == m, of([m])) for m in lengths], F.array().cast(kind))

    item_prints = pieces.select(F.explode(by_length(lambda m: fingerprints(F.col("w"), m, span, gram), "array<bigint>")).alias("print")).distinct()
    item_windows = pieces.select("item_id", F.explode(by_length(
        lambda m: windows(F.col("at"), F.col("w"), m), "array<struct<start: int, length: int, window: string>>"
    )).alias("x")).select("item_id", "x.window").distinct()

    segmented = segments(words_of(F.col("text")), span)
    prints = (
        rows.select(*key, F.explode(segmented).alias("s"))
        .select(*key, "s.at", F.explode(fingerprints(F.col("s.w"), lengths, span, gram)).alias("print"))
    )
    met = prints.join(listed(item_prints), "print", "left_semi").select(*key, "at").distinct()
    met = listed(met.groupBy(*key).agg(F.collect_list("at").alias("places")))
    again = F.filter(segmented, lambda s: F.array_contains("places", s["at"]))
    found = cut(
        rows.join(met, key).select(*key, F.explode(again).alias("s"))
        .select(*key, F.explode(windows(F.col("s.at"), F.col("s.w"), lengths)).alias("x")).select(*key, "x.*")
        .join(listed(item_windows.select("window").distinct()), "window", "left_semi").distinct()
    )
    before = Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hit = found.select(*key, new.alias("new")).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    named = (
        found.select(*key, "window").distinct().join(listed(item_windows), "window")
        .groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    result = listed(hit.join(named, key))
    return counted.join(result, key, "left").drop(*key).withColumns({c: F.coalesce(c, v) for c, v in none.items()})
