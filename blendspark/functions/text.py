"""Text clean-up as column expressions.  ``(?U)`` gives Java the Unicode
classes that the recipe texts need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a brand pattern may capture but that tell how to use
# the item.
USAGE_PHRASES = (
    "to rinse", "to rinse the glass", "to float", "to top", "for spritzing",
    "in atomizer", "for rinse", "as needed", "rinse", "for garnish", "to taste",
    "to coat", "to mist", "to spray", "for washing", "to rim", "to rim the glass",
)

# What introduces a brand, and what a brand name may look like.
BRAND_CUES = ("preferably", "such as", "like")
BRAND_NAME = r"([A-Za-z\x{C0}-\x{24F}][\w\s&'\-\d\.]+)"
BRAND_PATTERNS = (
    *(rf"\s*\({cue}\s+{BRAND_NAME}\)" for cue in BRAND_CUES),
    *(rf",?\s*{cue}\s+{BRAND_NAME}" for cue in BRAND_CUES),
    rf",\s+{BRAND_NAME}$",
)

# A quantity in front of a name, and the words dropped after it.
LEADING_QUANTITY = r"^\d+[\s\d/]*\s*(ounces?|oz|cups?|tsp|tbsp|ml|cl|dashes?|drops?)\s+"
LEADING_PRAISE = r"^(fresh|freshly|good|quality|premium|good\s+quality)\s+"


# White space other than the plain blank.
ODD_SPACE = "\t\n\u000B\f\r\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def squeeze(text: Column) -> Column:
    """One blank between words, none at the ends.  Most texts are tidy already, so
    they are looked at before they are rewritten."""
    untidy = F.rlike(text, F.lit(f"[{ODD_SPACE}]|  "))
    return F.trim(F.when(untidy, F.regexp_replace(text, f"[ {ODD_SPACE}]+", " ")).otherwise(text))


def strip(text: Column) -> Column:
    """No white space at the ends."""
    edges = F.rlike(text, F.lit(f"^[ {ODD_SPACE}]|[ {ODD_SPACE}]$"))
    return F.when(edges, F.regexp_replace(text, f"^[ {ODD_SPACE}]+|[ {ODD_SPACE}]+$", "")).otherwise(text)


def drop_notes(text: Column) -> Column:
    """Without anything in parentheses."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)^\([^)]*\)\s*", ""), r"(?U)\s*\([^)]*\)", "")
    return F.when(text.contains("("), bare).otherwise(text)


def ascii_quotes(text: Column) -> Column:
    plain = F.translate(text, "’‘“”", "''\"\"")
    return F.when(F.length(text) != F.octet_length(text), plain).otherwise(text)


def clean_name(name: Column, keep_parentheses: bool = False) -> Column:
    """Drop notes in parentheses, squeeze, drop outer commas."""
    if not keep_parentheses:
        name = drop_notes(name)
    return F.btrim(squeeze(name), F.lit(","))


def normalize_text(text: Column) -> Column:
    """Name used for vocabulary look-ups: no quantity, no praise, lower case."""
    text = ascii_quotes(squeeze(text))
    text = F.regexp_replace(text, "(?i)" + LEADING_QUANTITY, "")
    text = F.regexp_replace(text, "(?i)" + LEADING_PRAISE, "")
    return F.trim(F.lower(text))


def normalize_for_match(text: Column) -> Column:
    """Key under which spelling variants of one name meet (case is kept)."""
    text = ascii_quotes(text)
    text = F.translate(text, "ʼ`„", "''\"")
    for fresh in (", fresh", " (fresh)", "(fresh)"):
        text = F.replace(text, F.lit(fresh), F.lit(""))
    return squeeze(F.regexp_replace(text, "^fresh ", ""))


def match_key(name: Column) -> Column:
    return normalize_for_match(F.lower(F.trim(name)))


def normalize_value(value: Column, default: str = "unknown") -> Column:
    """NULL or blank becomes the default."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def first_value(values: Column, default: str = "unknown") -> Column:
    """The same for a list: its first item counts."""
    return normalize_value(F.get(values, F.lit(0)), default)


def is_optional(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("optional") | low.contains("omit if")


def brand_candidates(text: Column) -> list[Column]:
    """What each pattern captures, in the order of the patterns; NULL for nothing
    and for words that are no brand."""
    out = []
    for pattern in BRAND_PATTERNS:
        brand = F.lower(F.trim(F.regexp_extract(text, "(?iU)" + pattern, 1)))
        out.append(F.nullif(brand, F.lit("")))
    return out


def is_brand(candidate: Column) -> Column:
    return candidate.isNotNull() & ~candidate.isin(*USAGE_PHRASES)


def without_brand(text: Column, pattern: str) -> Column:
    rest = F.rtrim(F.trim(F.regexp_replace(text, "(?iU)" + pattern, "")), F.lit(","))
    return F.trim(F.regexp_replace(rest, r"(?U)\s*\(\s*\)", ""))


def source_url(name: Column, prefix: str, suffix: str = "", ampersand: bool = False) -> Column:
    """Page address guessed from a recipe name."""
    text = F.replace(ascii_quotes(F.lower(name)), F.lit("\u00A0"), F.lit(" "))
    allowed = r"[^\p{L}\p{N} \-&]" if ampersand else r"[^\p{L}\p{N} \-]"
    text = F.regexp_replace(text, allowed, "")
    text = F.replace(F.replace(text, F.lit(" "), F.lit("-")), F.lit("&"), F.lit("and"))
    text = F.btrim(F.regexp_replace(text, "-+", "-"), F.lit("-"))
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def db_path(path: Column, root: str = "raw_recipes") -> Column:
    """Last two parts of a file path below ``root``; a bare name stays as it is."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) >= 2, F.concat_ws("/", F.lit(root), F.slice(parts, -2, 2))
    ).otherwise(path)


def url_to_filename(url: Column) -> Column:
    """Last segment of an address as a safe ``.html`` file name."""
    path = F.rtrim(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""), F.lit("/"))
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.regexp_replace(last, r"[^\w\-]", "_"), F.lit(".html"))


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}_ ])", r"\\$1")
