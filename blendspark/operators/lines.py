"""Jobs over tables of item lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendspark.functions import text as T
from blendspark.functions.lines import with_parsed_line


def parse_lines(lines: DataFrame, text: str = "text", keep_parentheses: bool = False) -> DataFrame:
    """Lines with ``amount``, ``unit`` and ``ingredient``."""
    return with_parsed_line(lines, text, keep_parentheses)


def normalize_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines with the name for vocabulary look-ups and the key for matching."""
    return lines.withColumn("normalized", T.normalize_text(F.col(text))).withColumn(
        "match_key", T.match_key(F.col(text))
    )


def extract_brand(names: DataFrame, brands: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Names with ``brand`` and ``cleaned``.

    A name that is itself a key of the brand table becomes the brand, and what
    the brand stands for becomes the text; otherwise the patterns decide.
    """
    candidates = [f"_brand{i}" for i in range(len(T.BRAND_PATTERNS))]
    found = names.select("*", *(c.alias(n) for c, n in zip(T.brand_candidates(F.col(text)), candidates)))
    # The first usable capture also says which pattern is cut out of the text.
    usable = [T.is_brand(F.col(c)) for c in candidates]
    brand = F.coalesce(*(F.when(ok, F.col(c)) for ok, c in zip(usable, candidates)))
    cleaned = F.coalesce(
        *(F.when(ok, T.without_brand(F.col(text), p)) for ok, p in zip(usable, T.BRAND_PATTERNS)), F.col(text)
    )
    if brands is None:
        return found.withColumn("brand", brand).withColumn("cleaned", cleaned).drop(*candidates)
    keyed = brands.groupBy(F.lower("brand").alias("_key")).agg(F.min_by("generic", F.struct("brand", "generic")).alias("_generic"))
    keyed_in = F.col("_generic").isNotNull()
    return (
        found.join(keyed, F.col(text) == F.col("_key"), "left")
        .withColumn("brand", F.when(keyed_in, F.col(text)).otherwise(brand))
        .withColumn("cleaned", F.when(keyed_in, F.col("_generic")).otherwise(cleaned))
        .drop("_key", "_generic", *candidates)
    )


def drop_optional(lines: DataFrame, name: str = "ingredient_name") -> DataFrame:
    return lines.where(~T.is_optional(F.col(name)))
