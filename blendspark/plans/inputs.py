"""Queries through the readers: documents of each kind are written to the shared folder,
many small ones as a crawl or an export would leave them, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.functions import text as T
from blendspark.operators import bags as B
from blendspark.operators import lines as L
from blendspark.operators import pages as P
from blendspark.operators.lineage import cut, shared_folder
from blendspark.plans import standins as S
from blendspark.plans.registry import query
from blendspark.plans.standins import r6 as sql6
from blendspark.plans.tables import bags_of, manhattan_pairs
from blendspark.plans.texts import MATCHING, USES, brand_table, name_mapping, status_log
from blendspark.plans.web import PAGES, page_table
from blendspark.sources import readers, writers


def place(spark) -> str:
    return f"{shared_folder(spark.sparkContext)}/{uuid.uuid4().hex}"


def written(rows: DataFrame, name: Column, value: Column) -> str:
    """One text file (in a folder of its own) for each row; its name says which."""
    folder = place(rows.sparkSession)
    rows.select(name.alias("file"), value.alias("value")).write.partitionBy("file").text(folder)
    return folder


def as_map(entries: Column) -> Column:
    """An object with the pairs of an array of structs (key, value), in that order."""
    return F.map_from_entries(entries)


# --- pages ----------------------------------------------------------------------


@query("page_corpus", S.sql("SELECT source, 'p' || page_id || '.html' AS file, html FROM sites WHERE source = 'com' AND page_id % 4 = 0", **PAGES))
def page_corpus(spark, sf):
    """A quarter of one source as files (a file a page is what a crawl leaves), and a
    state file that is no page."""
    name = F.concat(F.lit("p"), F.regexp_extract("path", r"(\d+)\.html", 1), F.lit(".html"))
    pages = page_table(spark, sf).where("source = 'com'").where(F.regexp_extract("path", r"(\d+)\.html", 1).cast("long") % 4 == 0)
    state = pages.limit(1).select(F.lit("download_state.html").alias("name"), F.lit("{}").alias("html"))
    folder = written(pages.select(name.alias("name"), "html").unionByName(state), F.col("name"), F.col("html"))
    found = readers.read_page_corpus(spark, folder, "com")
    return found.select("source", F.regexp_extract("path", r"file=([^/]*)/", 1).alias("file"), F.regexp_replace("html", r"\n\z", "").alias("html"))


@query("skip_listed_pages", S.sql("SELECT source, path FROM sites WHERE page_id % 3 <> 0", **PAGES))
def skip_listed_pages(spark, sf):
    pages = page_table(spark, sf)
    number = F.regexp_extract("path", r"(\d+)\.html", 1)
    listed = pages.select(F.when(number.cast("long") % 3 == 0, F.concat(F.lit(" /old/place/"), number, F.lit(".html "))).otherwise(F.concat(F.lit("# "), number, F.lit(".html"))))
    folder = place(spark)
    listed.write.text(folder)
    return readers.skip_listed_pages(pages, folder).select("source", "path")


def order_lines(spark, sf) -> DataFrame:
    """(key, n, whole, item, status, priority): item lines of orders."""
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item"))
    orders = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    lines = S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), "l_partkey", F.col("l_quantity").cast("int").cast("string").alias("whole")
    )
    return lines.join(parts, "l_partkey").join(orders, "key")


ORDER_LINES = {
    "order_lines": """SELECT l_orderkey AS key, l_linenumber AS n, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS whole, p_name AS item,
        o_orderstatus AS status, o_orderpriority AS priority FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "order_heads": "SELECT DISTINCT key, status, priority, 'Order ' || key AS name, '/pages/' || key || '.html' AS path FROM order_lines",
}


def _markup(lines: DataFrame, row: Column) -> DataFrame:
    """(key, status, priority, rows): the markup of all lines of an order, in their order."""
    cells = F.array_sort(F.collect_list(F.struct("n", "item", "whole", row.alias("row"))))
    return lines.groupBy("key", "status", "priority").agg(F.array_join(F.transform(cells, lambda x: x["row"]), "").alias("rows"))


def _tag(name: str, inner, more: str = "") -> list:
    return [F.lit(f"<{name}{more}>"), F.lit(inner) if isinstance(inner, str) else inner, F.lit(f"</{name}>")]


def _pages(lines: DataFrame, parts: list) -> DataFrame:
    return lines.select(F.lit("Shop").alias("source"), F.concat(F.lit("/pages/"), "key", F.lit(".html")).alias("path"), F.concat(*parts).alias("html"))


def boxed_pages(spark, sf) -> DataFrame:
    style = F.when(F.col("n") == 3, F.lit(' style="display:none"')).otherwise(F.lit(""))
    row = F.concat(F.lit("<li"), style, F.lit("><b>"), F.col("whole"), F.lit(" oz</b> <span>"), F.col("item"), F.lit("</span></li>"))
    orders = _markup(order_lines(spark, sf), row)
    name, note = F.concat(F.lit("Order "), "key"), F.concat(*_tag("h5", "Editor's Note"), *_tag("p", F.concat(F.lit("Now "), "status")))
    return _pages(orders, [
        F.lit('<html><body><div class="entry-content">For '), F.col("priority"), F.lit('</div><div class="x recipe-box">'), *_tag("h1", name),
        *_tag("ul", F.col("rows"), ' class="ingredients-list"'),
        *_tag("ol", F.concat(*_tag("li", "Shake."), *_tag("li", F.concat(F.lit("Strain for "), "priority"))), ' itemprop="recipeInstructions"'),
        *_tag("p", F.concat(F.lit("Glass "), "status"), ' class="garn-glass"'), F.when(F.col("status") == "F", note).otherwise(F.lit("")), F.lit("</div></body></html>"),
    ])


@query(
    "recipe_box_pages",
    S.sql("""SELECT path, name, lines, 'Shake.|Strain for ' || priority AS directions, 'For ' || priority AS description, 'Glass ' || status AS garnish,
            CASE WHEN status = 'F' THEN 'Now F' END AS editors_note
        FROM order_heads LEFT JOIN (SELECT key, string_agg(whole || ' oz ' || item, '|' ORDER BY n, item, whole) AS lines FROM order_lines WHERE n <> 3 GROUP BY key) USING (key)""", **ORDER_LINES),
)
def recipe_box_pages(spark, sf):
    """Layout with a box, through its own reader: every order is a page."""
    raw = P.extract_raw(boxed_pages(spark, sf), {"shop": "recipe_box"})
    return raw.select(
        "path", "name", F.nullif(F.concat_ws("|", "lines"), F.lit("")).alias("lines"), F.concat_ws("|", "directions").alias("directions"),
        "description", "garnish", "editors_note",
    )


def tabled_pages(spark, sf) -> DataFrame:
    """Pages with an ingredient table; those of every eleventh order have none."""
    cells = F.concat(*_tag("td", F.concat("whole", F.lit("1⁄2oz"))), *_tag("td", F.concat("item", F.lit(" (cold)"))))
    orders = _markup(order_lines(spark, sf), F.concat(*_tag("tr", cells)))
    kind = F.when(F.col("key") % 11 == 0, F.lit("other")).otherwise(F.lit("legacy-ingredients-table"))
    return _pages(orders, [
        F.lit('<html><head><link rel="canonical" href="https://example.org/'), F.col("key"), F.lit('"></head><body><nav>Menu</nav>'),
        *_tag("h1", F.concat(F.lit("Order "), "key")), F.lit('<table class="'), kind, F.lit('"><tr><th>Amount</th><th>Item</th></tr>'), F.col("rows"), F.lit("</table>"),
        *_tag("h2", P.HOW), *_tag("p", F.concat(F.lit("Stir for "), "priority")), *_tag("h2", P.REVIEW), *_tag("div", F.concat(F.lit("Good &amp; "), "status")),
        *_tag("footer", "End"), F.lit("</body></html>"),
    ])


@query(
    "ingredient_table_pages",
    S.sql("""SELECT path, name, 'https://example.org/' || key AS source_url, 'Stir for ' || priority AS directions, 'Good & ' || status AS description,
            (SELECT count(*) FROM order_lines l WHERE l.key = h.key) AS n_lines FROM order_heads h WHERE key % 11 <> 0""", **ORDER_LINES),
)
def ingredient_table_pages(spark, sf):
    """Layout with a table, through its own reader; pages without one give no row."""
    raw = P.extract_raw(tabled_pages(spark, sf), {"SHOP": "ingredient_table"})
    return raw.select("path", "name", "source_url", F.concat_ws("|", "directions").alias("directions"), "description", F.size("lines").cast("long").alias("n_lines"))


@query(
    "ingredient_table_lines",
    S.sql("""SELECT '/pages/' || key || '.html' AS path, row_number() OVER (PARTITION BY key ORDER BY n, item, whole) - 1 AS line, whole || ' 1/2 oz ' || item || ' (cold)' AS text,
            item || ' (cold)' AS ingredient_name, CAST(whole AS DOUBLE) + 0.5 AS amount, 'ounce' AS unit_name FROM order_lines WHERE key % 11 <> 0""", **ORDER_LINES),
)
def ingredient_table_lines(spark, sf):
    raw = P.extract_raw(tabled_pages(spark, sf), {"shop": "ingredient_table"})
    return P.recipe_lines(raw).select("path", F.col("line").cast("long").alias("line"), "text", "ingredient_name", "amount", "unit_name")


@query(
    "clean_table_pages",
    S.sql(f"""SELECT path, CASE WHEN h.key % 11 = 0 THEN NULL ELSE md5('<h1>' || name || '</h1><table class="legacy-ingredients-table"><tr><th>Amount</th><th>Item</th></tr>' || rows
            || '</table><h2>{P.HOW}</h2><p>Stir for ' || priority || '</p><h2>{P.REVIEW}</h2><div>Good &amp; ' || status || '</div>') END AS digest
        FROM order_heads h JOIN (SELECT key, string_agg('<tr><td>' || whole || '1⁄2oz</td><td>' || item || ' (cold)</td></tr>', '' ORDER BY n, item, whole) AS rows FROM order_lines GROUP BY key) USING (key)""", **ORDER_LINES),
)
def clean_table_pages(spark, sf):
    """Heading, table and sections only; a page without a table stays (no digest)."""
    out = P.clean_pages(tabled_pages(spark, sf), "ingredient_table")
    return out.select("path", F.when(F.col("cleaned") != F.col("html"), F.md5("cleaned")).alias("digest"))


@query(
    "clean_box_pages",
    S.sql("""SELECT path, md5('<div class="entry-content">For ' || priority || '</div>') AS digest FROM order_heads""", **ORDER_LINES),
)
def clean_box_pages(spark, sf):
    """What is left of a page with a content part: that part alone."""
    return P.clean_pages(boxed_pages(spark, sf)).select("path", F.md5("cleaned").alias("digest"))


# --- lines and values -----------------------------------------------------------

_SIGNS = {0: ("¼", 0.25), 1: ("½", 0.5), 2: ("¾", 0.75), 3: ("⅓", 0.333), 4: ("⅔", 0.667)}
_SIGN = "CASE n % 5 " + " ".join(f"WHEN {k} THEN '{s}'" for k, (s, _) in _SIGNS.items()) + " END"
_PART = "CASE n % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, (_, v) in _SIGNS.items()) + " END"


@query(
    "fraction_signs",
    S.sql(f"""SELECT key, n, {sql6(f"CASE length(whole) % 2 WHEN 0 THEN CAST(whole AS DOUBLE) ELSE 0 END + {_PART}")} AS amount, 'ounce' AS unit, item AS ingredient FROM order_lines""", **ORDER_LINES),
)
def fraction_signs(spark, sf):
    """Fraction signs alone, behind a number, and behind a number and a blank."""
    sign = F.expr(_SIGN)
    number = F.when(F.length("whole") % 2 == 1, F.lit("")).otherwise(F.concat("whole", F.when(F.col("n") % 2 == 0, F.lit(" ")).otherwise(F.lit(""))))
    lines = order_lines(spark, sf).select("key", "n", F.concat(number, sign, F.lit(" oz "), "item").alias("text"))
    out = L.parse_lines(lines)
    return out.select("key", "n", F.round("amount", 6).alias("amount"), "unit", "ingredient")


@query("first_values", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'unknown' WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 1) ELSE 'unknown' END AS value FROM part")
def first_values(spark, sf):
    """Of a list its first item; of an empty list or a blank item the default."""
    size, words = F.col("p_size") % 3, F.split("p_name", " ")
    values = F.when(size == 0, F.array().cast("array<string>")).when(size == 1, words).otherwise(F.concat(F.array(F.lit(" ")), words))
    return S.table(spark, sf, "part").select("p_partkey", T.first_value(values).alias("value"))


# --- documents ------------------------------------------------------------------


@query(
    "recipe_files",
    S.sql("""SELECT 'Order ' || key AS name, row_number() OVER (PARTITION BY key ORDER BY n, item, whole) - 1 AS line, item AS ingredient_name,
            CASE WHEN n <> 7 THEN CAST(whole AS DOUBLE) END AS amount, CASE WHEN n <> 6 THEN 'oz' END AS unit_name FROM order_lines""", **ORDER_LINES),
)
def recipe_files(spark, sf):
    """Recipe documents of up to a thousand orders each."""
    use = F.struct(
        "n", F.col("item").alias("ingredient_name"), F.when(F.col("n") == 7, " ").otherwise(F.col("whole")).alias("amount"),
        F.when(F.col("n") == 6, "").otherwise("oz").alias("unit_name"),
    )
    recipes = order_lines(spark, sf).groupBy("key").agg(F.array_sort(F.collect_list(use)).alias("ingredients"))
    recipe = F.struct(F.concat(F.lit("Order "), "key").alias("name"), F.transform("ingredients", lambda x: x.dropFields("n")).alias("ingredients"))
    documents = recipes.groupBy(F.expr("key div 1000").alias("no")).agg(F.collect_list(recipe).alias("recipes"))
    folder = written(documents, F.col("no"), F.to_json(F.struct("recipes")))
    uses = readers.document_uses(readers.read_recipe_documents(spark, folder).withColumn("file", F.col("name")))
    return uses.select(F.col("file").alias("name"), F.col("line").cast("long").alias("line"), "ingredient_name", "amount", "unit_name")


@query("mapping_file", S.sql("SELECT name, mapped_id, mapped_name, mapped_id % 2 = 0 AS auto FROM name_map", **USES))
def mapping_file(spark, sf):
    """Mapping dictionaries, one for each target; the mark of an automatic match is left
    out where it is not set."""
    auto = F.when(F.col("mapped_id") % 2 == 0, F.lit(True))
    entry = F.struct(F.col("mapped_id").alias("id"), F.col("mapped_name").alias("name"), F.lit("2024-05-06T07:08:09").alias("mapped_at"), auto.alias("auto_matched"))
    one = name_mapping(spark, sf).groupBy("mapped_name").agg(F.to_json(as_map(F.collect_list(F.struct("name", entry)))).alias("json"))
    found = readers.read_mapping(spark, written(one, F.xxhash64("mapped_name"), F.col("json")))
    return found.where("mapped_at = timestamp'2024-05-06 07:08:09'").select("name", "mapped_id", "mapped_name", "auto")


@query(
    "taxonomy_file",
    S.sql("""SELECT c * 1099511627776 + t * 1048576 + v AS ord, category, specific_type, CASE v WHEN 0 THEN specific_type ELSE 'big ' || specific_type END AS term
        FROM (SELECT *, dense_rank() OVER (ORDER BY category) - 1 AS c, dense_rank() OVER (PARTITION BY category ORDER BY specific_type) - 1 AS t FROM words)
        JOIN (SELECT unnest([0, 1]) AS v) ON v = 0 OR category = 'gear'""", **MATCHING),
)
def taxonomy_file(spark, sf):
    words = S.table(spark, sf, "part").select(F.substring_index("p_name", " ", -1).alias("category"), F.col("p_name").alias("type")).distinct()
    terms = F.when(F.col("category") == "gear", F.array(F.concat(F.lit("big "), "type"))).otherwise(F.array().cast("array<string>"))
    types = words.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("type", terms.alias("terms")))).alias("types"))
    whole = types.agg(F.array_sort(F.collect_list(F.struct("category", "types"))).alias("all"))  # as long as the vocabulary
    json = F.to_json(as_map(F.transform("all", lambda x: F.struct(x["category"], as_map(x["types"])))))
    folder = place(spark)
    whole.select(json.alias("value")).write.text(folder)
    return readers.read_taxonomy(spark, folder)


@query("brand_file", S.sql("SELECT brand, generic FROM brands", **MATCHING))
def brand_file(spark, sf):
    folder = place(spark)
    whole = brand_table(spark, sf).agg(F.to_json(as_map(F.collect_list(F.struct("brand", "generic")))).alias("value"))
    whole.write.text(folder)
    return readers.read_brand_dictionary(spark, folder)


@query("latest_snapshot", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 2")
def latest_snapshot(spark, sf):
    """Three snapshots, a file each; only the last is read."""
    folder, customers = place(spark), S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    for k in range(3):
        customers.where(F.col("c_custkey") % 3 == k).coalesce(1).write.csv(f"{folder}/{k}", header=True)
    return readers.read_latest_snapshot(spark, f"{folder}/*/*.csv", "c_custkey long, c_name string, c_acctbal double")


def _log_lists(rows: DataFrame) -> Column:
    names = lambda s: F.collect_list(F.when(F.col("status") == s, F.col("recipe_name")))
    review = F.transform(names("needs_review"), lambda x: F.struct(x.alias("recipe_name"), F.array(F.lit("x")).alias("unmapped_ingredients")))
    return F.struct(names("accepted").alias("accepted"), names("rejected").alias("rejected"), names("auto_ingested").alias("auto_ingested"), review.alias("needs_review"))


def _logs(spark, sf) -> DataFrame:
    """(no, source, lists): logs of up to some hundred recipes."""
    rows = status_log(spark, sf).withColumn("no", F.expr("cast(substring_index(recipe_name, ' ', -1) as bigint) div 1000"))
    return rows.groupBy("no", "source").agg(_log_lists(rows).alias("lists"))


@query("status_file", S.sql("SELECT source, recipe_name, status FROM log", **USES))
def status_file(spark, sf):
    keyed = _logs(spark, sf).groupBy("no").agg(F.to_json(as_map(F.collect_list(F.struct("source", "lists")))).alias("json"))
    return readers.read_status_log(spark, written(keyed, F.col("no"), F.col("json")))


@query("any_status_file", S.sql("SELECT source, recipe_name, status FROM log", **USES))
def any_status_file(spark, sf):
    """Flat logs of one source beside keyed ones of the other."""
    logs = _logs(spark, sf)
    flat = logs.where("source = 'O'").select("no", F.to_json("lists").alias("json"))
    keyed = logs.where("source = 'F'").groupBy((-1 - F.col("no")).alias("no")).agg(F.to_json(as_map(F.collect_list(F.struct("source", "lists")))).alias("json"))
    return readers.read_any_status_log(spark, written(flat.unionByName(keyed), F.col("no"), F.col("json")), "O")


@query("progress_file", S.sql("SELECT recipe_name AS name, CASE status WHEN 'accepted' THEN 'processed' ELSE 'skipped' END AS status FROM log WHERE status <> 'needs_review'", **USES))
def progress_file(spark, sf):
    logs = _logs(spark, sf).select("no", "source", F.to_json(F.struct(F.col("lists.accepted").alias("processed"), F.col("lists.rejected").alias("skipped"))).alias("json"))
    return readers.read_progress(spark, written(logs, F.concat_ws("-", "no", "source"), F.col("json")))


@query(
    "class_file",
    "SELECT dense_rank() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderpriority) - 1 AS ord, o_orderpriority AS class, 'Order ' || o_orderkey AS recipe_name FROM orders",
)
def class_file(spark, sf):
    """Recipes by class, in documents of up to a thousand orders; a broken one has no rows."""
    orders = S.table(spark, sf, "orders").select(F.expr("o_orderkey div 1000").alias("no"), F.col("o_orderpriority").alias("class"), F.concat(F.lit("Order "), "o_orderkey").alias("name"))
    lists = orders.groupBy("no", "class").agg(F.collect_list("name").alias("names"))
    files = lists.groupBy("no").agg(F.to_json(as_map(F.array_sort(F.collect_list(F.struct("class", "names"))))).alias("json"))
    broken = files.limit(1).select(F.lit(-1).cast("long").alias("no"), F.lit("{not json").alias("json"))
    found = readers.read_recipe_classes(spark, written(files.unionByName(broken), F.col("no"), F.col("json")))
    return found.select(F.col("ord").cast("long").alias("ord"), "class", "recipe_name")


@query("new_name_file", "SELECT DISTINCT p_name AS name, p_brand AS parent_name FROM part")
def new_name_file(spark, sf):
    names = S.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("parent_name")).distinct()
    files = names.groupBy("parent_name").agg(F.to_json(F.struct(F.collect_list(F.struct("name", "parent_name")).alias("ingredients"))).alias("json"))
    return readers.read_new_names(spark, written(files, F.xxhash64("parent_name"), F.col("json")))


@query("new_name_lines", "SELECT DISTINCT p_name AS name, '' AS parent_name FROM part")
def new_name_lines(spark, sf):
    folder = place(spark)
    writers.write_new_names(S.table(spark, sf, "part").select(F.col("p_name").alias("name")), folder)
    return spark.read.schema("name string, parent_name string").json(folder)


# --- distances and edges --------------------------------------------------------


@query("distance_table", S.sql(f"SELECT id1, id2, {sql6('d')} AS d FROM manhattan"))
def distance_table(spark, sf):
    folder = place(spark)
    writers.write_distance_table(manhattan_pairs(spark, sf), folder)
    return spark.read.schema("id1 long, id2 long, d double").csv(folder, header=True)


@query(
    "edge_tables",
    S.sql("""SELECT 'edge' AS kind, id1, id2, (SELECT string_agg(CAST(x.ingredient_id AS VARCHAR), '|' ORDER BY x.ingredient_id) FROM bags x WHERE x.recipe_id = id1 AND x.ingredient_id NOT IN
                (SELECT y.ingredient_id FROM bags y WHERE y.recipe_id = id2)) AS only1 FROM set_pairs WHERE d = 2
        UNION ALL SELECT 'node', recipe_id, NULL, NULL FROM (SELECT id1 AS recipe_id FROM set_pairs WHERE d = 2 UNION SELECT id2 FROM set_pairs WHERE d = 2)"""),
)
def edge_tables(spark, sf):
    folder = place(spark)
    edges = cut(B.one_swap_edges(bags_of(spark, sf)[0]))  # read for both tables
    nodes = edges.select(F.explode(F.array("id1", "id2")).alias("recipe_id")).distinct()
    writers.write_edge_tables(nodes, edges, folder)
    read = spark.read.schema("id1 long, id2 long, only1 string, only2 string").csv(f"{folder}/edges", header=True)
    back = spark.read.schema("id1 long").csv(f"{folder}/nodes", header=True)
    return read.select(F.lit("edge").alias("kind"), "id1", "id2", F.nullif("only1", F.lit("")).alias("only1")).unionByName(
        back.select(F.lit("node").alias("kind"), "id1", F.lit(None).cast("long").alias("id2"), F.lit(None).cast("string").alias("only1"))
    )
