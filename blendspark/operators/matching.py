"""Matching item names to a taxonomy and to a catalogue."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from blendspark.functions import text as T
from blendspark.operators.lineage import cut
from blendspark.operators.lines import extract_brand

MATCH_FIELDS = ("brand", "specific_type", "category", "confidence", "source")


#: Ends of whole words.
WORD_END = r"(?U)\b"
BEGINS_WITH_WORD, ENDS_WITH_WORD = r"(?U)^\w", r"(?U)\w\z"


def _tokens(text: Column) -> Column:
    """A text cut at every end of a word: words and what is between them."""
    return F.array_remove(F.split(text, WORD_END), "")


def spans(text: Column, most: int | Column) -> Column:
    """All parts of a text, of up to ``most`` tokens, that begin and end where a word
    begins or ends.  ``\\bterm\\b`` finds a term just where it equals one of them."""
    def of(t: Column) -> Column:
        n = F.size(t)
        first = F.when(F.rlike(text, F.lit(BEGINS_WITH_WORD)), 1).otherwise(2)
        last = F.when(F.rlike(text, F.lit(ENDS_WITH_WORD)), n).otherwise(n - 1)
        up_to = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(up_to(first, last), lambda i: F.transform(
            up_to(i, F.least(i + most - 1, last)), lambda j: F.array_join(F.slice(t, i, j - i + 1), "")
        )))

    return F.array_distinct(F.get(F.transform(F.array(_tokens(text)), of), F.lit(0)))


def match_taxonomy(names: DataFrame, taxonomy: DataFrame, brands: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row per distinct text that has a match, with ``MATCH_FIELDS``.

    An exact term wins over a contained one, then the longest term, then file
    order.  Terms are matched as whole words, in either case: each text gives out its
    parts between word ends, as long as the longest term has tokens, and one equality
    join finds all terms at once.
    """
    wanted = names.select(text).distinct().withColumn("_norm", T.normalize_text(F.col(text)))
    wanted = cut(extract_brand(wanted, brands, "_norm").select(text, "brand", "cleaned"))

    terms = taxonomy.select("ord", "category", "specific_type", "term")
    most = terms.agg(F.max(F.size(_tokens(F.col("term"))))).first()[0] or 1
    parts = wanted.select("*", F.explode(spans(F.lower("cleaned"), most)).alias("_part"))
    inside = parts.join(terms.withColumn("_part", F.lower("term")), "_part").drop("_part")
    whole = wanted.join(terms, F.col("cleaned") == F.col("term")).select(*inside.columns)
    exact = F.col("cleaned") == F.col("term")
    ranked = (
        inside.unionByName(whole)
        .withColumn("confidence", F.when(exact, F.lit(1.0)).otherwise(F.lit(0.9)))
        .groupBy(text, "brand", "cleaned")
        .agg(
            F.max_by(
                F.struct("specific_type", "category", "confidence"),
                F.struct("confidence", F.length("term"), -F.col("ord")),
            ).alias("m")
        )
        .select(text, "brand", "m.specific_type", "m.category", "m.confidence")
    )
    categories = taxonomy.select(F.col("category").alias("cleaned")).distinct()
    by_category = (
        wanted.join(ranked.select(text), text, "left_anti")
        .join(categories, "cleaned")
        .select(
            text, "brand", F.lit(None).cast("string").alias("specific_type"),
            F.col("cleaned").alias("category"), F.lit(1.0).alias("confidence"),
        )
    )
    return ranked.unionByName(by_category).withColumn("source", F.lit("dictionary"))


def match_cascade(
    names: DataFrame, matched: DataFrame, cache: DataFrame, external: DataFrame, text: str = "text"
) -> DataFrame:
    """Every distinct text with its match and ``stage``: dictionary, else cache, else
    external table, else none.  Of several rows of a text in one table the surest counts,
    then the least by source, category, type and brand."""
    out = names.select(text).distinct()
    for stage, rows in (("dictionary", matched), ("cache", cache), ("external", external)):
        order = F.struct((-F.col("confidence")).alias("c"), "source", "category", "specific_type", "brand")
        one = rows.groupBy(text).agg(F.min_by(F.struct(*MATCH_FIELDS), order).alias(f"_{stage}"))
        out = out.join(one, text, "left")
    stages = ("dictionary", "cache", "external")
    best = F.coalesce(*(F.col(f"_{s}") for s in stages))
    stage = F.coalesce(*(F.when(F.col(f"_{s}").isNotNull(), F.lit(s)) for s in stages), F.lit("none"))
    return out.select(text, best.alias("_m"), stage.alias("stage")).select(
        text, *(F.col(f"_m.{f}").alias(f) for f in MATCH_FIELDS), "stage"
    )


def updated_cache(cascade: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Cache plus what the external table has added."""
    new = cascade.where("stage = 'external'").select(text, *MATCH_FIELDS)
    return cache.select(text, *MATCH_FIELDS).join(new.select(text), text, "left_anti").unionByName(new)


def apply_matches(facts: DataFrame, matches: DataFrame, text: str = "text") -> DataFrame:
    """Uses of the recipes whose every ingredient has a match, with category,
    specific type and brand; a missing volume counts 0."""
    keys = matches.select(
        F.col(text).alias("ingredient_name"),
        T.normalize_value(F.col("category")).alias("category"),
        T.normalize_value(F.col("specific_type"), "generic").alias("specific_type"),
        T.normalize_value(F.col("brand"), "generic").alias("brand"),
    )
    joined = facts.join(keys, "ingredient_name", "left")
    open_recipes = joined.where(F.col("category").isNull()).select("recipe_id").distinct()
    return joined.join(open_recipes, "recipe_id", "left_anti").withColumn(
        "amount_ml", F.coalesce("amount_ml", F.lit(0.0))
    )


def keyed_catalogue(catalogue: DataFrame) -> DataFrame:
    """One entry per match key; on equal keys the last one (by id) stays."""
    return (
        catalogue.withColumn("_key", T.match_key(F.col("name")))
        .groupBy("_key")
        .agg(F.max_by(F.struct("id", "name", "path"), "id").alias("_c"))
        .select("_key", "_c.*")
    )


def auto_match_exact(names: DataFrame, mapping: DataFrame, catalogue: DataFrame) -> DataFrame:
    """New mapping rows for unmapped names that equal a catalogue name by key."""
    entries = keyed_catalogue(catalogue).select(
        "_key", F.col("id").alias("mapped_id"), F.col("name").alias("mapped_name")
    )
    return (
        names.select(F.trim("name").alias("name"))
        .where("name <> ''")
        .distinct()
        .join(mapping.select("name"), "name", "left_anti")
        .withColumn("_key", T.match_key(F.col("name")))
        .join(entries, "_key")
        .select("name", "mapped_id", "mapped_name", F.current_timestamp().alias("mapped_at"), F.lit(True).alias("auto"))
    )


@F.pandas_udf(DoubleType())
def sequence_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings."""
    return pd.Series(
        [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second)], dtype="float64"
    )


def edit_similarity(first: Column, second: Column) -> Column:
    longest = F.greatest(F.length(first), F.length(second))
    return 1 - F.levenshtein(first, second) / F.nullif(longest, F.lit(0))


def _letters(table: DataFrame, key: str) -> DataFrame:
    """(key, letter, occurrence): the letters of a string as a set."""
    return (
        table.select(key, F.explode(F.split(key, "")).alias("_letter"))
        .where("_letter <> ''")
        .groupBy(key, "_letter")
        .agg(F.count("*").alias("_n"))
        .select(key, F.explode(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.concat_ws("#", "_letter", i))).alias("_token"))
    )


def matching_block_keys(names: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(name_key, entry_key) pairs that can reach a ratio of matching blocks.

    Such strings have most letters in common: with L1 and L2 letters at least
    ``threshold * (L1 + L2) / 2``.  So a shared letter occurs among the rarest of
    both, and the tables meet there.
    """
    share = threshold / 2
    rank_of = _letters(names.unionByName(entries.select(F.col("entry_key").alias("name_key"))).distinct(), "name_key") \
        .groupBy("_token").agg(F.count("*").alias("_f"))

    def rare(table: DataFrame, key: str) -> DataFrame:
        cells = _letters(table, key).join(rank_of, "_token")
        # A string has few hundred letters at most; its ranking stays in one row group.
        rarest = Window.partitionBy(key).orderBy("_f", "_token")
        length = F.length(key)
        # Partners have at least share/(1-share) times the letters.
        least = F.ceil(share * (length + length * (share / (1 - share))) - 1e-9)
        return (
            cells.withColumn("_r", F.row_number().over(rarest))
            .where(F.col("_r") <= length - F.greatest(least, F.lit(1)) + 1)
            .select(key, "_token")
        )

    similar = rare(names, "name_key").join(rare(entries, "entry_key"), "_token")
    l1, l2 = F.length("name_key"), F.length("entry_key")
    return similar.where(F.least(l1, l2) >= share * (l1 + l2) - 1e-9).select("name_key", "entry_key").distinct()


def _edits(length: Column, threshold: float) -> Column:
    """Edits that two strings may be apart of which the longer has this length."""
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def _cut_at(length: Column, parts: Column, i: Column) -> Column:
    """Where part i (from 0) of a string begins; the parts differ by one letter at most."""
    return F.floor(i * length / parts).cast("int")


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def segments(table: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, long, at, piece): a string cut into two segments more than the edits that
    its length allows.  Of a shorter string within these edits, two segments at least
    are found unchanged."""
    long, parts = F.length(key), _edits(F.length(key), threshold) + 2
    rows = table.where(long > 1).select(key, long.alias("long"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("at"), parts.alias("parts"))
    begin, end = _cut_at(F.col("long"), F.col("parts"), F.col("at")), _cut_at(F.col("long"), F.col("parts"), F.col("at") + 1)
    return rows.select(key, "long", "at", F.substring(F.col(key), begin + 1, end - begin).alias("piece"))


def probes(table: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, long, at, piece): what a string has where a segment of a string of length
    ``long``, its own or more, may lie.  A shift by s costs s edits before the segment and
    as many as make up the lengths behind it."""
    own = F.length(key)
    rows = table.where(own > 0).select(key, own.alias("own"), F.explode(F.sequence(own, F.floor(own / threshold + 1e-9).cast("int"))).alias("long"))
    rows = rows.withColumns({"edits": _edits(F.col("long"), threshold), "more": F.col("long") - F.col("own")}).where("long > 1 and more <= edits")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("edits") + 1)))
    begin = _cut_at(F.col("long"), F.col("edits") + 2, F.col("at"))
    rows = rows.withColumns({"begin": begin, "size": _cut_at(F.col("long"), F.col("edits") + 2, F.col("at") + 1) - begin})
    low = F.greatest(F.col("begin") - F.floor((F.col("edits") + F.col("more")) / 2).cast("int"), F.lit(0))
    high = F.least(F.col("begin") + F.floor((F.col("edits") - F.col("more")) / 2).cast("int"), F.col("own") - F.col("size"))
    pieces = F.array_distinct(F.transform(_range(low, high), lambda p: F.substring(F.col(key), p + 1, F.col("size"))))
    return rows.select(key, "long", "at", F.explode(pieces).alias("piece"))


def edit_keys(names: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(name_key, entry_key): pairs of unequal strings that share two segments in place,
    which all pairs within the edits of the threshold do.  The longer one is cut, the
    shorter one probes; of two equally long ones the name is cut."""
    meet = ["long", "at", "piece"]
    name_longer = segments(names, "name_key", threshold).join(probes(entries, "entry_key", threshold), meet)
    entry_longer = segments(entries, "entry_key", threshold).join(
        probes(names, "name_key", threshold).where(F.col("long") > F.length("name_key")), meet
    )
    both = ["name_key", "entry_key"]
    met = name_longer.select(*both).unionByName(entry_longer.select(*both)).groupBy(*both).agg(F.count("*").alias("_n"))
    return met.where("_n > 1 and name_key <> entry_key").select(*both)


def _grams(key: str, size: int) -> Column:
    places = _range(F.lit(1), F.length(key) - size + 1)
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(key), i, F.lit(size))))


def held_keys(inner: DataFrame, inner_key: str, outer: DataFrame, outer_key: str, size: int = 3) -> DataFrame:
    """(inner_key, outer_key): pairs of which the second contains the first.

    They meet on the piece of ``size`` letters of the inner string that fewest outer
    strings have.  Strings shorter than that meet on themselves.
    """
    grams = outer.select(outer_key, F.explode(_grams(outer_key, size)).alias("_piece"))
    uses = grams.groupBy("_piece").agg(F.count("*").alias("_n"))
    asked = inner.where(F.length(inner_key) >= size).select(inner_key, F.explode(_grams(inner_key, size)).alias("_piece"))
    rarest = (  # a piece that no outer string has rules all out
        asked.join(uses, "_piece", "left").groupBy(inner_key)
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_piece")).alias("_r")).select(inner_key, "_r._piece")
    )
    found = rarest.join(grams, "_piece").where(F.contains(outer_key, inner_key)).select(inner_key, outer_key)
    for short in range(1, size):
        whole = inner.where(F.length(inner_key) == short).select(inner_key, F.col(inner_key).alias("_piece"))
        # Seldom any: then the outer strings are not cut at all, as the join is empty.
        cuts = outer.select(outer_key, F.explode(_grams(outer_key, short)).alias("_piece"))
        found = found.unionByName(whole.join(cuts, "_piece").select(inner_key, outer_key))
    return found


def similar_keys(names: DataFrame, entries: DataFrame, threshold: float, measure: str = "levenshtein") -> DataFrame:
    """(name_key, entry_key): distinct pairs that can be similar, or contain one another."""
    near = (edit_keys if measure == "levenshtein" else matching_block_keys)(names, entries, threshold)
    inside = held_keys(names, "name_key", entries, "entry_key")
    around = held_keys(entries, "entry_key", names, "name_key").select("name_key", "entry_key")
    return near.unionByName(inside).unionByName(around).distinct()


def suggest_matches(
    names: DataFrame, catalogue: DataFrame, threshold: float = 0.6, top: int = 10, measure: str = "levenshtein"
) -> DataFrame:
    """(name, id, suggestion, path, similarity, exact, rank): per distinct name the
    exact entry, then what is similar enough or contains the other, best first.

    ``measure`` is ``levenshtein`` (inside the JVM) or ``ratio`` (matching blocks, Python
    in Arrow batches).  Spelling keys are compared once, however many names have them.
    """
    wanted = names.select("name").distinct().withColumn("name_key", T.match_key(F.col("name")))
    entries = catalogue.withColumn("entry_key", T.match_key(F.col("name")))
    pairs = similar_keys(
        wanted.select("name_key").distinct(), entries.select("entry_key").distinct(), threshold, measure
    ).where("name_key <> entry_key")
    score = sequence_ratio if measure == "ratio" else edit_similarity
    pairs = pairs.withColumn("similarity", score(F.col("name_key"), F.col("entry_key")))
    holds = F.contains("entry_key", "name_key") | F.contains("name_key", "entry_key")
    near = (
        pairs.where((F.col("similarity") >= threshold) | holds)
        .join(entries.select("entry_key", "id", F.col("name").alias("suggestion"), "path"), "entry_key")
        .select("name_key", "id", "suggestion", "path", "similarity", F.lit(False).alias("exact"))
    )
    same = keyed_catalogue(catalogue).select(
        F.col("_key").alias("name_key"), "id", F.col("name").alias("suggestion"), "path",
        F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"),
    ).join(wanted.select("name_key").distinct(), "name_key", "left_semi")
    best = Window.partitionBy("name_key").orderBy(F.desc("exact"), F.desc("similarity"), "id")
    ranked = near.unionByName(same).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return wanted.join(ranked, "name_key").select(
        "name", "id", "suggestion", "path", "similarity", "exact", "rank"
    )


def search_catalogue(catalogue: DataFrame, words: str, limit: int = 20) -> DataFrame:
    """The first entries, by id, whose key contains the key of the words."""
    return (
        catalogue.where(F.contains(T.match_key(F.col("name")), T.match_key(F.lit(words))))
        .orderBy("id")
        .limit(limit)
    )
