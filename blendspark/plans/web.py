"""Queries over pages and fetch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendspark.functions import text as T
from blendspark.functions.markup import Node
from blendspark.operators import pages as P
from blendspark.operators.lineage import spread
from blendspark.plans import standins as S
from blendspark.plans.registry import query
from blendspark.plans.texts import PARSED


def article(page: Node) -> dict | None:
    """Layout of the given pages: links of the menu as lines, paragraphs as steps."""
    heading, menu, body = page.find("h1"), page.find("nav"), page.find("article")
    if heading is None or menu is None:
        return None
    return {
        "name": heading.text(),
        "lines": [li.text(" ") for li in menu.find_all("li") if li.text()],
        "directions": [p.text() for p in body.find_all("p")] if body else [],
    }


SITES = {"com": "article", "ORG": "article", "net": "article"}
LAYOUTS = {"article": article}


def page_table(spark, sf):
    host = F.regexp_extract("url", r"^[a-z]+://[^/]*example\.([a-z]+)", 1)
    return spread(S.table(spark, sf, "pages")).select(
        host.alias("source"), F.concat(F.lit("/data/html/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html"
    )


_TEXT = r"trim(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'))"
PAGES = {
    "sites": r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*example\.([a-z]+)', 1) AS source, '/data/html/' || page_id || '.html' AS path, url, html FROM pages",
    "menu": rf"""SELECT source, path, item.i - 1 AS line, {_TEXT.format('item.x')} AS text FROM (
        SELECT source, path, unnest(list_transform(regexp_extract_all(html, '<li>.*?</li>', 0, 's'), lambda x, i: {{'x': x, 'i': i}})) AS item FROM sites)""",
    "items": "SELECT * FROM menu WHERE text <> ''",
    **PARSED,
    "line_texts": "SELECT path AS recipe_id, line, text FROM items",
}


@query(
    "extract_recipes",
    S.sql(
        rf"""SELECT source, s.path, {_TEXT.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS name, coalesce(n, 0) AS n_ingredients
        FROM sites s LEFT JOIN (SELECT path, count(*) AS n FROM items GROUP BY path) m ON m.path = s.path""",
        **PAGES,
    ),
)
def extract_recipes(spark, sf):
    out = P.extract_recipes(page_table(spark, sf), SITES, LAYOUTS)
    return out.select("source", "path", "name", F.size("ingredients").cast("long").alias("n_ingredients"))


@query(
    "recipe_lines",
    S.sql("SELECT recipe_id AS path, line, text, ingredient AS ingredient_name, amount, unit AS unit_name FROM parsed", **PAGES),
)
def recipe_lines(spark, sf):
    raw = P.extract_raw(page_table(spark, sf), SITES, LAYOUTS)
    return P.recipe_lines(raw).select("path", F.col("line").cast("long").alias("line"), "text", "ingredient_name", "amount", "unit_name")


@query(
    "pages_to_tables",
    S.sql(
        """SELECT r.id AS recipe_id, g.id AS ingredient_id, line, amount, unit FROM parsed p
        JOIN (SELECT path, row_number() OVER (ORDER BY source, path) AS id FROM sites) r ON r.path = p.recipe_id
        JOIN (SELECT ingredient, row_number() OVER (ORDER BY ingredient) AS id FROM (SELECT DISTINCT ingredient FROM parsed)) g USING (ingredient)""",
        **PAGES,
    ),
)
def pages_to_tables(spark, sf):
    uses = P.pages_to_tables(page_table(spark, sf), SITES, LAYOUTS)["recipe_ingredient"]
    return uses.select("recipe_id", "ingredient_id", F.col("line").cast("long").alias("line"), "amount", "unit")


@query(
    "clean_pages",
    S.sql(
        """SELECT path, contains(html, '<h1>') AS has_heading, FALSE AS has_menu, FALSE AS has_footer,
        length(regexp_replace(html, '[^s-u]', '', 'g')) > 0 AS had_text FROM sites""",
        **PAGES,
    ),
)
def clean_pages(spark, sf):
    out = P.clean_pages(page_table(spark, sf))
    has = lambda mark: F.contains("cleaned", F.lit(mark))
    return out.select(
        "path", has("<h1>").alias("has_heading"), has("<nav").alias("has_menu"), has("<footer").alias("has_footer"),
        (F.length("cleaned") > 0).alias("had_text"),
    )


@query(
    "derive_source_url",
    S.sql(r"""SELECT s_suppkey, 'https://example.org/recipes/' || trim(regexp_replace(replace(replace(regexp_replace(lower(s_name) || ' & co. no ' || s_suppkey, '[^a-z0-9 \-&]', '', 'g'), ' ', '-'), '&', 'and'), '-+', '-', 'g'), '-') || '/' AS source_url FROM supplier"""),
)
def derive_source_url(spark, sf):
    name = F.concat_ws(" ", "s_name", F.lit("& Co. No"), F.col("s_suppkey").cast("string"))
    return S.table(spark, sf, "supplier").select(
        "s_suppkey", T.source_url(name, "https://example.org/recipes/", "/", ampersand=True).alias("source_url")
    )


@query(
    "page_paths",
    S.sql(
        r"""SELECT page_id, 'raw_recipes/html/' || page_id || '.html' AS db_path,
            regexp_replace(string_split(trim(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), '/')[-1], '[^a-zA-Z0-9_-]', '_', 'g') || '.html' AS file_name
        FROM pages"""
    ),
)
def page_paths(spark, sf):
    path = F.concat(F.lit("/data/html/"), F.col("page_id").cast("string"), F.lit(".html"))
    return S.table(spark, sf, "pages").select(
        "page_id", T.db_path(path).alias("db_path"), T.url_to_filename(F.col("url")).alias("file_name")
    )


@query(
    "tidy_cells",
    S.sql(
        """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) || ' 1/2 oz' AS amount_cell,
        '2 ounce ' || p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey"""
    ),
)
def tidy_cells(spark, sf):
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    cell = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("1⁄2oz"))
    item = F.concat(F.lit("2 ounce ounce of "), "p_name")
    return S.table(spark, sf, "lineitem").join(parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", P.tidy_amount_cell(cell).alias("amount_cell"), P.tidy_item(item).alias("item")
    )


# --- fetch logs: events by user, an error is a miss -----------------------------

LOG = {
    "log": "SELECT CAST(user_id AS VARCHAR) AS source, event_id AS id, event_type <> 'error' AS found FROM events",
}


def fetch_log(spark, sf):
    return S.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("found")
    )


@query("plan_fetch", "SELECT DISTINCT o_orderkey AS id, o_orderkey // 100 AS batch FROM orders WHERE o_orderkey NOT IN (SELECT l_partkey FROM lineitem)")
def plan_fetch(spark, sf):
    candidates = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return P.plan_fetch(candidates, S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")))


@query(
    "fold_fetch_log",
    S.sql("""SELECT source, max(id) AS last_checked_id, coalesce(max(id) FILTER (found), 0) AS max_id_found,
        count(*) FILTER (found) AS downloaded_count, count(*) FILTER (NOT found) AS not_found_count FROM log GROUP BY source""", **LOG),
)
def fold_fetch_log(spark, sf):
    return P.fold_fetch_log(fetch_log(spark, sf))


@query("missed_ids", S.sql("SELECT DISTINCT source, id FROM log WHERE NOT found", **LOG))
def missed_ids(spark, sf):
    return P.missed_ids(fetch_log(spark, sf))


@query(
    "find_miss_runs",
    S.sql(
        """SELECT source, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM (
            SELECT *, sum(found::INT) OVER (PARTITION BY source ORDER BY id) AS run FROM log) WHERE NOT found
        GROUP BY source, run HAVING count(*) >= 3""",
        **LOG,
    ),
)
def find_miss_runs(spark, sf):
    return P.find_miss_runs(fetch_log(spark, sf), 3)
