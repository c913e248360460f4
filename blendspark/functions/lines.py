"""Item lines such as ``1 1/2 oz lime juice`` taken apart by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blendspark.functions.text import clean_name, drop_notes, squeeze, strip
from blendspark.functions.units import unit_alias

# Written-out fractions and the words in front of an amount that
# say nothing about it.
FRACTION_SIGNS = {"¼": ".25", "½": ".5", "¾": ".75", "⅓": ".333", "⅔": ".667"}
QUALIFIERS = ("generous", "small", "heaping", "short", "shy", "heavy", "scant", "about")
OPEN_AMOUNTS = ("to top", "as needed")

NUMBER = r"(?:\d+\.?\d*|\.\d+)"
BELOW_ONE = r"0*\.\d*[1-9]\d*"
# In this order: a range, a whole number with a fraction or a decimal part, a
# fraction, a plain number.
AMOUNT = rf"^(?:{NUMBER}(?: to |-){NUMBER}|\d+ \d+/\d+|\d+ {BELOW_ONE}|\d+/\d+|{NUMBER})(?: |$)"


def without_first_note(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)^\([^)]*\)\s*", "")
    return F.when(text.startswith("("), bare).otherwise(text)


def without_qualifier(text: Column) -> Column:
    """Without one qualifier word in front of something else."""
    word = F.substring_index(text, " ", 1)
    behind = F.substring(text, F.length(word) + 2, F.length(text))
    return F.when(word.isin(*QUALIFIERS) & (behind != ""), behind).otherwise(text)


def plain_fractions(text: Column) -> Column:
    """Fraction signs as decimals."""
    plain = text
    for sign, decimal in FRACTION_SIGNS.items():
        plain = F.replace(plain, F.lit(sign), F.lit(decimal))
    return F.when(F.length(text) != F.octet_length(text), plain).otherwise(text)


def leading_amount(text: Column) -> Column:
    """The amount as written, with the space after it; empty where there is none."""
    return F.regexp_extract(text, AMOUNT, 0)


def amount_parts(written: Column) -> Column:
    """The numbers of a written amount."""
    return F.split(F.trim(written), " to |[ /-]")


def amount_value(written: Column, first: Column, second: Column, third: Column) -> Column:
    """Value of a written amount with its numbers: the middle of a range, NULL for a
    zero denominator."""
    return (
        F.when(written.contains(" to ") | written.contains("-"), (first + second) / 2)
        .when(third.isNotNull(), first + F.try_divide(second, third))
        .when(written.contains("/"), F.try_divide(first, second))
        .otherwise(first + F.coalesce(second, F.lit(0.0)))
    )


def with_parsed_line(lines, text: str = "text", keep_parentheses: bool = False):
    """Add ``amount``, ``unit`` and ``ingredient`` to a table of lines.

    Every step that is looked at more than once is a column of its own, so that it is
    worked out once for each line."""
    own = set(lines.columns)
    staged = lines.withColumn("_line", strip(F.col(text)))
    staged = staged.withColumn("_lower", F.lower("_line"))
    staged = staged.withColumn("_head", without_first_note(F.col("_lower")))
    staged = staged.withColumn("_flat", squeeze(F.col("_head")))
    staged = staged.withColumn("_bare", without_qualifier(F.col("_flat")))
    staged = staged.withColumn("_plain", plain_fractions(F.col("_bare")))
    staged = staged.withColumn("_written", leading_amount(F.col("_plain")))
    staged = staged.withColumn("_parts", amount_parts(F.col("_written")))
    numbers = ["_first", "_second", "_third"]
    staged = staged.withColumns({n: F.get("_parts", F.lit(k)).try_cast("double") for k, n in enumerate(numbers)})
    staged = staged.withColumn("_amount", amount_value(F.col("_written"), *map(F.col, numbers)))
    after = F.substring(F.col("_plain"), F.length("_written") + 1, F.length("_plain"))
    staged = staged.withColumn("_rest", F.when(F.col("_amount").isNull(), F.col("_plain")).otherwise(after))
    staged = staged.withColumn("_word", F.substring_index("_rest", " ", 1))
    staged = staged.withColumn("_unit", unit_alias(F.col("_word")))
    behind = F.substring(F.col("_rest"), F.length("_word") + 2, F.length("_rest"))
    named = F.when(F.col("_unit").isNull(), F.col("_rest")).otherwise(behind)
    open_unit = F.coalesce(
        *(F.when(F.col("_head").contains(phrase), F.lit(phrase)) for phrase in OPEN_AMOUNTS)
    )
    staged = staged.withColumn("_open", open_unit)
    before = F.regexp_replace(F.col("_line"), r"(?is),? to top.*$", "")
    before_needed = F.regexp_replace(F.col("_line"), r"(?is),? as needed.*$", "")
    staged = staged.withColumn(
        "_name", F.when(F.col("_open") == "to top", before).when(F.col("_open") == "as needed", before_needed).otherwise(named)
    )
    staged = staged.withColumn("_noted", F.col("_name") if keep_parentheses else drop_notes(F.col("_name")))
    staged = staged.withColumn("_clean", clean_name(F.col("_noted"), keep_parentheses=True))
    # A line that leaves no name is kept as it was written.
    name = F.when((F.col("_clean") == "") & F.col("_open").isNull(), F.col("_line")).otherwise(F.col("_clean"))
    staged = (
        staged.withColumn("amount", F.when(F.col("_open").isNull(), F.col("_amount")))
        .withColumn("unit", F.coalesce(F.col("_open"), F.col("_unit")))
        .withColumn("ingredient", name)
    )
    return staged.drop(*(c for c in staged.columns if c.startswith("_") and c not in own))
