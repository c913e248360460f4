"""Recipes from a table of pages (source, path, html).

Each page is read on its own inside ``mapInArrow``; a layout turns it into raw
strings.  Amounts, units and names come out of those by column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.functions import text as T
from blendspark.functions.lines import with_parsed_line
from blendspark.functions.markup import Node, first, parse
from blendspark.operators.facts import assign_ingredient_ids
from blendspark.operators.lineage import cut, dense_index, prefix_sum
from blendspark.operators.mapping import STANDARD_INSTRUCTIONS

RAW = (
    "source string, path string, name string, lines array<string>, directions array<string>, "
    "description string, garnish string, editors_note string, source_label string, source_url string"
)
RAW_ARROW = pa.schema(
    [(n, pa.list_(pa.string()) if n in ("lines", "directions") else pa.string()) for n in (x.split()[0] for x in RAW.split(", "))]
)

# What is looked for on a page of each layout.
UNNAMED = "Unnamed Recipe"
NOTE_HEADING = "Editor's Note"
HOW, REVIEW, HISTORY = "How to make:", "Review:", "History:"
MAIN_CLASSES = ("recipe-content", "entry-content", "post-content")
UNWANTED_TAGS = ("nav", "header", "footer", "script", "style", "form", "img", "picture", "figure")
UNWANTED_CLASSES = (
    "navigation", "nav", "sidebar", "ads", "advertisement", "social", "comments", "comment", "related",
    "newsletter", "cookie", "gdpr", "share", "sharing", "social-share", "share-buttons", "form", "email-form",
    "subscription", "share-story", "tweet", "email-page", "image", "photo", "ico",
)
HIDDEN_STYLES = ("display:none", "display: none")
SHARE_TEXTS = ("Share story:", "Share", "Tweet", "Email This Page", "Email", "Facebook", "Twitter", "Pinterest")


def recipe_box(page: Node) -> dict | None:
    """Layout with a box: heading, visible list items, numbered directions."""
    box = page.find("div", class_="recipe-box")
    if box is None:
        return None
    heading, listing = box.find("h1"), box.find("ul", class_="ingredients-list")
    steps = box.find("ol", itemprop="recipeInstructions")
    items = listing.find_all("li") if listing else []
    lines = [li.text(" ") for li in items if li.attrs.get("style") != "display:none"]
    note = next((h.next_sibling("p") for h in box.find_all("h5") if h.text() == NOTE_HEADING), None)
    description, garnish = page.find("div", class_="entry-content"), box.find("p", class_="garn-glass")
    return {
        "name": heading.text() if heading else UNNAMED,
        "lines": [x for x in lines if x],
        "directions": [li.text() for li in steps.find_all("li")] if steps else [],
        "description": description.text() if description else None,
        "garnish": garnish.text() if garnish else None,
        "editors_note": note.text() if note else None,
    }


def _section(page: Node, heading: str) -> tuple[Node | None, Node | None]:
    head = next((h for h in page.find_all("h2") if h.text() == heading), None)
    return head, head.next_sibling() if head else None


def _table_and_heading(page: Node) -> tuple[Node | None, Node | None]:
    """The ingredient table and the nearest heading before it, else the last one."""
    table, heading = None, None
    for node in page.walk():
        if node.tag == "h1":
            heading = node
        elif node.tag == "table" and "legacy-ingredients-table" in node.classes:
            table = node
            break
    return table, heading


def ingredient_table(page: Node) -> dict | None:
    """Layout with a table of amounts and names; the cells of a row are joined by a
    tab until their amount has been tidied."""
    table, heading = _table_and_heading(page)
    if table is None or heading is None:
        return None
    rows = []
    for tr in table.find_all("tr"):
        cells = [c for c in tr.walk() if c.tag in ("td", "th")]
        if len(cells) >= 2 and any(c.tag == "td" for c in cells) and cells[1].text():
            rows.append(cells[0].text() + "\t" + cells[1].text())
    if not rows:
        return None
    texts = [block.text() if block else "" for _, block in (_section(page, h) for h in (HOW, REVIEW, HISTORY))]
    link = page.find("link", rel="canonical")
    return {
        "name": heading.text(),
        "lines": rows,
        "directions": [texts[0]] if texts[0] else [],
        "description": " ".join(t for t in texts[1:] if t),
        "source_label": "table",
        "source_url": link.attrs.get("href") if link else None,
    }


Layout = Callable[[Node], dict | None]
LAYOUTS: dict[str, Layout] = {"recipe_box": recipe_box, "ingredient_table": ingredient_table}


def tidy_item(text: Column) -> Column:
    """Doubled units and ``of`` in a list item."""
    for old, new in (("ounces  ounces", "ounces"), ("ounce ounce", "ounce"), (" of ", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def tidy_amount_cell(text: Column) -> Column:
    """Fraction slash, ``21/2`` as ``2 1/2``, a space before the unit."""
    text = F.replace(text, F.lit("⁄"), F.lit("/"))
    text = F.regexp_replace(text, r"(\d)(\d/\d)", "$1 $2")
    return F.regexp_replace(text, r"(\d)(oz|ml|cl|dash|drop|tsp|tbsp|cup)", "$1 $2")


def recipe_lines(raw: DataFrame) -> DataFrame:
    """(source, path, line, text, ingredient_name, amount, unit_name) per item line."""
    rows = raw.select("source", "path", F.posexplode("lines").alias("line", "_raw"))
    cells = F.split("_raw", "\t")
    is_cell = F.contains("_raw", F.lit("\t"))
    joined = F.concat_ws(" ", tidy_amount_cell(F.get(cells, F.lit(0))), F.get(cells, F.lit(1)))
    rows = rows.withColumn("text", F.when(is_cell, joined).otherwise(tidy_item(F.col("_raw"))))
    # Names in table cells keep their notes in parentheses.
    listed = with_parsed_line(rows.where(~is_cell))
    tabled = with_parsed_line(rows.where(is_cell), keep_parentheses=True)
    return listed.unionByName(tabled).select(
        "source", "path", "line", "text", F.col("ingredient").alias("ingredient_name"), "amount", F.col("unit").alias("unit_name")
    )


def extract_raw(pages: DataFrame, layout_of: dict[str, str], layouts: dict[str, Layout] | None = None) -> DataFrame:
    """Raw recipes of all sources; ``layout_of`` maps a source (any case) to the name
    of its layout.  A page of any other source is an error."""
    known = {**LAYOUTS, **(layouts or {})}
    by_source = {source.lower(): layout for source, layout in layout_of.items()}
    missing = set(by_source.values()) - set(known)
    if missing:
        raise ValueError(f"unknown layout: {sorted(missing)}")
    source = F.lower("source")
    checked = pages.withColumn(
        "source",
        F.when(source.isin(*by_source), F.col("source")).otherwise(
            F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("NULL"))))
        ),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                layout = known[by_source[row["source"].lower()]]
                found = layout(parse(row["html"])) if row["html"] else None
                if found is not None:
                    rows.append({"source": row["source"], "path": row["path"], **found})
            yield pa.RecordBatch.from_pylist(rows, schema=RAW_ARROW)

    return checked.select("source", "path", "html").mapInArrow(read, RAW)


def extract_recipes(pages: DataFrame, layout_of: dict[str, str], layouts: dict[str, Layout] | None = None) -> DataFrame:
    """One row per recipe page with its parsed ingredients; a page bounds the list."""
    raw = cut(extract_raw(pages, layout_of, layouts))
    item = F.struct("line", "ingredient_name", "amount", "unit_name")
    lists = recipe_lines(raw).groupBy("source", "path").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("line")).alias("ingredients")
    )
    instructions = F.concat_ws(" ", "directions")
    fallback = F.when(F.col("source_label").isNotNull(), F.lit(STANDARD_INSTRUCTIONS)).otherwise(F.lit(""))
    return raw.join(lists, ["source", "path"], "left").select(
        "source", "path", "name",
        F.coalesce("ingredients", F.array()).cast("array<struct<ingredient_name:string,amount:double,unit_name:string>>").alias("ingredients"),
        F.coalesce(F.nullif(instructions, F.lit("")), fallback).alias("instructions"),
        F.coalesce("description", F.lit("")).alias("description"),
        "garnish", "editors_note", "source_label", "source_url",
    )


def pages_to_tables(pages: DataFrame, layout_of: dict[str, str], layouts: dict[str, Layout] | None = None) -> dict[str, DataFrame]:
    """Whole corpus as the tables ``recipe``, ``ingredient`` and ``recipe_ingredient``.
    Recipes are numbered by source and path, ingredients by name."""
    raw = cut(extract_raw(pages, layout_of, layouts))
    numbered = dense_index(raw, "source", "path").withColumn("id", F.col("idx") + 1)
    recipes = numbered.select(
        "id", "name", "source_url", F.col("path").alias("source_file"), "description", "garnish",
        F.concat_ws("\n", "directions").alias("directions"), "editors_note", "source",
    )
    lines = cut(recipe_lines(raw))
    nobody = lines.sparkSession.createDataFrame([], "id long, name string")
    ingredients = cut(assign_ingredient_ids(lines.select(F.col("ingredient_name").alias("name")), nobody))
    uses = (
        lines.join(recipes.select("source", F.col("source_file").alias("path"), F.col("id").alias("recipe_id")), ["source", "path"])
        .join(ingredients.select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient_name")), "ingredient_name")
        .select("recipe_id", "ingredient_id", "amount", F.col("unit_name").alias("unit"), F.col("text").alias("note"), "line")
    )
    return {"recipe": recipes.drop("source"), "ingredient": ingredients, "recipe_ingredient": uses}


# --- clean pages ----------------------------------------------------------------


def _is_unwanted(node: Node) -> bool:
    return (
        node.tag in UNWANTED_TAGS
        or any(c in UNWANTED_CLASSES for c in node.classes)
        or any(style in node.attrs.get("style", "") for style in HIDDEN_STYLES)
    )


def main_content(page: Node) -> str:
    """The main part of a page without navigation, hidden items and share texts."""
    choices = [lambda n: n.tag == "article"]
    choices += [lambda n, c=c: c in n.classes for c in MAIN_CLASSES]
    choices += [lambda n: "Recipe" in n.attrs.get("itemtype", ""), lambda n: n.tag == "main", lambda n: n.tag == "body"]
    content = first(page, choices) or page
    for node in [n for n in content.walk() if _is_unwanted(n)]:
        node.remove()
    for node in list(content.walk()):
        kept = []
        for child in node.children:
            if isinstance(child, str) and any(p in child.strip() for p in SHARE_TEXTS):
                continue
            kept.append(child)
        if len(kept) != len(node.children):
            if "".join(node.strings()).strip() in SHARE_TEXTS:
                node.remove()
            node.children = kept
    return content.html()


def table_content(page: Node) -> str | None:
    """Heading, ingredient table and the three sections; None without a table."""
    table, heading = _table_and_heading(page)
    if table is None:
        return None
    parts = [heading, table]
    for title in (HOW, REVIEW, HISTORY):
        parts.extend(_section(page, title))
    return "".join(p.html() for p in parts if p is not None)


CLEANERS = {"recipe_box": main_content, "ingredient_table": table_content}


def clean_pages(pages: DataFrame, layout: str = "recipe_box") -> DataFrame:
    """Pages with ``cleaned``; a page that cannot be cleaned stays as it is."""
    cleaner = CLEANERS[layout]

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cleaned = []
            for html in batch["html"]:
                out = None
                try:
                    out = cleaner(parse(html)) if html else html
                except (ValueError, AssertionError):
                    pass  # broken markup: keep the page
                cleaned.append(html if out is None else out)
            yield batch.assign(cleaned=cleaned)

    return pages.select("source", "path", "html").mapInPandas(
        clean, "source string, path string, html string, cleaned string"
    )


# --- fetching -------------------------------------------------------------------


def plan_fetch(candidates: DataFrame, stored: DataFrame, key: str = "id", batch: int = 100) -> DataFrame:
    """(key, batch): distinct candidates that are not stored yet, in id batches."""
    return (
        candidates.select(key).distinct().join(stored.select(key), key, "left_anti")
        .withColumn("batch", F.floor(F.col(key) / batch).cast("long"))
    )


def fold_fetch_log(log: DataFrame) -> DataFrame:
    """One state per source: last id looked at, highest id found, pages found and
    not found.  The ids that were not found are the rows of ``missed_ids``."""
    found = F.col("found")
    return log.groupBy("source").agg(
        F.max("id").alias("last_checked_id"),
        F.coalesce(F.max(F.when(found, F.col("id"))), F.lit(0)).alias("max_id_found"),
        F.count_if(found).alias("downloaded_count"),
        F.count_if(~found).alias("not_found_count"),
    )


def missed_ids(log: DataFrame) -> DataFrame:
    """(source, id): ids that were looked at and never found."""
    hit = log.where("found").select("source", "id")
    return log.where("not found").select("source", "id").distinct().join(hit, ["source", "id"], "left_anti")


def find_miss_runs(log: DataFrame, length: int = 50) -> DataFrame:
    """(source, first_id, last_id, n): runs of at least ``length`` misses in a row, in
    id order; the first one of a source is where a crawl stops.

    A run lies between two found ids.  Each log row is numbered once by a
    distributed sort, so no source is ordered in one task: a miss belongs to the run
    that starts after as many finds as were counted before it.
    """
    placed = dense_index(log.select("source", "id", "found"), "source", "id", name="_place")
    finds = placed.withColumn("_hit", F.col("found").cast("long"))
    counted = prefix_sum(finds, "_place", "_hit", "_run")
    return (
        counted.where("not found")
        .groupBy("source", "_run")
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))
        .where(F.col("n") >= length)
        .select("source", "first_id", "last_id", "n")
    )
