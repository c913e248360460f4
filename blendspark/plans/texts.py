"""Queries over item lines, names, mappings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendspark.functions import text as T
from blendspark.functions.numeric import r6
from blendspark.functions.units import UNIT_ALIASES
from blendspark.operators import lines as L
from blendspark.operators import mapping as MP
from blendspark.operators import matching as MT
from blendspark.operators import reports as R
from blendspark.operators.lineage import dense_index, spread
from blendspark.plans import standins as S
from blendspark.plans.registry import query
from blendspark.plans.standins import r6 as sql6

def brand_text():
    return F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))


# --- item lines -----------------------------------------------------------------


def line_table(spark, sf):
    n = F.col("l_linenumber")
    amount = (
        F.when(n == 1, "2").when(n == 2, "1/2").when(n == 3, "1 1/2").when(n == 4, "2-3")
        .when(n == 5, "0.75").when(n == 6, "").otherwise("(about 1) scant 3")
    )
    flag = F.col("l_returnflag")
    unit = F.when(flag == "R", "oz").when(flag == "A", "Dashes").otherwise("tsp.")
    tail = (
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit(", preferably "), brand_text()))
        .when(flag == "N", F.concat(F.lit(" (such as "), brand_text(), F.lit(")")))
        .when(n == 6, ", to top")
        .otherwise("")
    )
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return (
        spread(S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))
        .join(parts, "l_partkey")
        .select(
            F.col("l_orderkey").alias("recipe_id"), n.alias("line"),
            F.concat(F.trim(F.concat_ws(" ", amount, unit, "p_name")), tail).alias("text"),
        )
    )


LINES = """
    SELECT l_orderkey AS recipe_id, l_linenumber AS line,
        trim(CASE l_linenumber WHEN 1 THEN '2' WHEN 2 THEN '1/2' WHEN 3 THEN '1 1/2' WHEN 4 THEN '2-3' WHEN 5 THEN '0.75'
            WHEN 6 THEN '' ELSE '(about 1) scant 3' END || ' ' || CASE l_returnflag WHEN 'R' THEN 'oz' WHEN 'A' THEN 'Dashes' ELSE 'tsp.' END
            || ' ' || p_name)
        || CASE WHEN l_linestatus = 'O' THEN ', preferably ' || replace(p_brand, '#', ' ')
            WHEN l_returnflag = 'N' THEN ' (such as ' || replace(p_brand, '#', ' ') || ')'
            WHEN l_linenumber = 6 THEN ', to top' ELSE '' END AS text
    FROM lineitem JOIN part ON l_partkey = p_partkey"""

_ALIASES = ", ".join(f"('{a}', '{u}')" for u, names in UNIT_ALIASES.items() for a in names)
_NOTES = r"trim(trim(regexp_replace(regexp_replace(regexp_replace({0}, '^\([^)]*\)\s*', ''), '\s*\([^)]*\)', '', 'g'), '\s+', ' ', 'g')), ',')"
PARSED = {
    "line_texts": LINES,
    "heads": r"""SELECT *, regexp_replace(regexp_replace(lower(text), '^\([^)]*\)\s*', ''),
        '^(generous|small|heaping|short|shy|heavy|scant|about)\b\s+', '') AS head FROM line_texts""",
    "amounts": r"""SELECT *, CASE
            WHEN regexp_matches(head, '^\d+-\d+ ') THEN (CAST(regexp_extract(head, '^(\d+)-(\d+)', 1) AS DOUBLE) + CAST(regexp_extract(head, '^(\d+)-(\d+)', 2) AS DOUBLE)) / 2
            WHEN regexp_matches(head, '^\d+ \d+/\d+ ') THEN CAST(regexp_extract(head, '^(\d+)', 1) AS DOUBLE)
                + CAST(regexp_extract(head, '^\d+ (\d+)/', 1) AS DOUBLE) / CAST(regexp_extract(head, '/(\d+) ', 1) AS DOUBLE)
            WHEN regexp_matches(head, '^\d+/\d+ ') THEN CAST(regexp_extract(head, '^(\d+)/', 1) AS DOUBLE) / CAST(regexp_extract(head, '/(\d+) ', 1) AS DOUBLE)
            WHEN regexp_matches(head, '^[\d.]+ ') THEN CAST(regexp_extract(head, '^([\d.]+) ', 1) AS DOUBLE) END AS number,
        regexp_replace(head, '^(\d+-\d+|\d+ \d+/\d+|\d+/\d+|[\d.]+) ', '') AS rest FROM heads""",
    "aliases": f"SELECT * FROM (VALUES {_ALIASES}) v(alias, unit)",
    "parsed": f"""SELECT recipe_id, line, text,
            CASE WHEN contains(head, 'to top') THEN NULL ELSE number END AS amount,
            CASE WHEN contains(head, 'to top') THEN 'to top' ELSE unit END AS unit,
            CASE WHEN contains(head, 'to top') THEN {_NOTES.format("regexp_replace(text, ',? to top.*$', '')")}
                 ELSE {_NOTES.format("CASE WHEN unit IS NULL THEN rest ELSE regexp_replace(rest, '^[^ ]+ ', '') END")} END AS ingredient
        FROM amounts LEFT JOIN aliases ON alias = trim(split_part(rest, ' ', 1), '.')""",
}


@query("parse_lines", S.sql("SELECT * FROM parsed", **PARSED))
def parse_lines(spark, sf):
    return L.parse_lines(line_table(spark, sf))


_PLAIN = "regexp_replace(regexp_replace(text, '{q}', '', 'i'), '{p}', '', 'i')".format(q=T.LEADING_QUANTITY, p=T.LEADING_PRAISE)


@query(
    "normalize_lines",
    S.sql(
        rf"""SELECT recipe_id, line, trim(regexp_replace(lower({_PLAIN}), '\s+', ' ', 'g')) AS normalized, lower(text) AS match_key FROM line_texts""",
        **PARSED,
    ),
)
def normalize_lines(spark, sf):
    return L.normalize_lines(line_table(spark, sf)).select("recipe_id", "line", "normalized", "match_key")


@query(
    "drop_optional",
    S.sql("""SELECT l_orderkey AS recipe_id, CASE l_linenumber WHEN 6 THEN 'Optional ' WHEN 7 THEN 'Omit if dry: ' ELSE '' END || p_name AS ingredient_name
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 6"""),
)
def drop_optional(spark, sf):
    return L.drop_optional(named_uses(spark, sf)).select("recipe_id", "ingredient_name")


# --- names, taxonomy, brands ----------------------------------------------------


def name_table(spark, sf):
    size = F.col("p_size")
    text = (
        F.when(size % 6 == 0, F.col("p_name"))
        .when(size % 6 == 1, F.concat(F.lit("2 oz fresh "), "p_name", F.lit(" (such as "), brand_text(), F.lit(")")))
        .when(size % 6 == 2, F.concat(F.lit("Big "), "p_name", F.lit(", preferably "), brand_text()))
        .when(size % 6 == 3, F.concat(F.substring_index("p_name", " ", -1), F.lit(", "), brand_text()))
        .when(size % 6 == 4, F.concat("p_name", F.lit(", to rinse")))
        .otherwise(brand_text())
    )
    return S.table(spark, sf, "part").select(text.alias("text"))


def taxonomy_table(spark, sf):
    words = S.table(spark, sf, "part").select(
        F.substring_index("p_name", " ", -1).alias("category"), F.col("p_name").alias("specific_type")
    ).distinct()
    # Small ones are listed under another spelling, so that some names find no term.
    terms = words.withColumn("term", F.regexp_replace("specific_type", "^small", "petite"))
    wide = words.where("category = 'gear'").withColumn("term", F.concat(F.lit("big "), "specific_type"))
    return dense_index(terms.unionByName(wide), "category", "specific_type", "term", name="ord")


def brand_table(spark, sf):
    # Higher numbers are listed under another spelling, so that some names are no key.
    key = F.when(F.col("brand_no") <= 12, brand_text()).otherwise(F.concat(F.lit("House "), brand_text()))
    return (
        S.parts(spark, sf)
        .groupBy(key.alias("brand"))
        .agg(F.min("p_name").alias("generic"))
    )


_C = T.BRAND_PATTERNS
_USAGE = ", ".join(f"'{u}'" for u in T.USAGE_PHRASES)


def _sql_brand() -> str:
    brand, rest = "CASE", "CASE"
    for p in _C:
        p = p.replace("'", "''")
        hit = f"lower(trim(regexp_extract(norm, '{p}', 1, 'i')))"
        cond = f"WHEN {hit} <> '' AND {hit} NOT IN ({_USAGE}) THEN"
        brand += f" {cond} {hit}"
        rest += rf" {cond} trim(regexp_replace(rtrim(trim(regexp_replace(norm, '{p}', '', 'gi')), ','), '\s*\(\s*\)', '', 'g'))"
    return f"coalesce(CASE WHEN generic IS NOT NULL THEN norm END, {brand} END) AS brand, coalesce(generic, {rest} ELSE norm END) AS cleaned"


MATCHING = {
    "names": r"""SELECT CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN '2 oz fresh ' || p_name || ' (such as ' || b || ')'
            WHEN 2 THEN 'Big ' || p_name || ', preferably ' || b WHEN 3 THEN split_part(p_name, ' ', 2) || ', ' || b
            WHEN 4 THEN p_name || ', to rinse' ELSE b END AS text FROM (SELECT *, replace(p_brand, '#', ' ') AS b FROM part)""",
    "words": "SELECT DISTINCT split_part(p_name, ' ', 2) AS category, p_name AS specific_type FROM part",
    "taxonomy": """SELECT *, row_number() OVER (ORDER BY category, specific_type, term) - 1 AS ord FROM (
            SELECT *, regexp_replace(specific_type, '^small', 'petite') AS term FROM words
            UNION ALL SELECT *, 'big ' || specific_type FROM words WHERE category = 'gear')""",
    "brands": "SELECT lower(CASE WHEN brand_no <= 12 THEN '' ELSE 'House ' END || replace(p_brand, '#', ' ')) AS brand, min(p_name) AS generic FROM parts GROUP BY 1",
    "normed": rf"SELECT text, trim(regexp_replace(lower({_PLAIN}), '\s+', ' ', 'g')) AS norm FROM (SELECT DISTINCT text FROM names)",
    "branded": f"SELECT text, {_sql_brand()} FROM normed LEFT JOIN brands ON norm = brands.brand",
    "matched": r"""SELECT text, brand, specific_type, category, confidence FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY confidence DESC, length(term) DESC, ord) AS r FROM (
                SELECT text, brand, specific_type, category, term, ord, CASE WHEN cleaned = term THEN 1.0 ELSE 0.9 END AS confidence
                FROM branded JOIN taxonomy ON cleaned = term OR regexp_matches(cleaned, '\b' || term || '\b'))) WHERE r = 1""",
    "matches": """SELECT *, 'dictionary' AS source FROM matched UNION ALL
            SELECT text, brand, NULL, cleaned, 1.0, 'dictionary' FROM branded
            WHERE cleaned IN (SELECT category FROM taxonomy) AND text NOT IN (SELECT text FROM matched)""",
}


@query("extract_brand", S.sql("SELECT text, brand, cleaned FROM branded", **MATCHING))
def extract_brand(spark, sf):
    names = name_table(spark, sf).distinct().withColumn("norm", T.normalize_text(F.col("text")))
    return L.extract_brand(names, brand_table(spark, sf), "norm").select("text", "brand", "cleaned")


def matches_of(spark, sf):
    return MT.match_taxonomy(name_table(spark, sf), taxonomy_table(spark, sf), brand_table(spark, sf))


@query("match_taxonomy", S.sql("SELECT * FROM matches", **MATCHING))
def match_taxonomy(spark, sf):
    return matches_of(spark, sf)


def _side_table(names, word, source):
    return names.where(F.contains("text", F.lit(word))).select(
        "text", F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("specific_type"),
        F.lit(word).alias("category"), F.lit(0.8).alias("confidence"), F.lit(source).alias("source"),
    ).distinct()


def cascade_of(spark, sf):
    names = name_table(spark, sf)
    return MT.match_cascade(names, matches_of(spark, sf), _side_table(names, "bolt", "cache"), _side_table(names, "r", "model"))


CASCADE = {
    **MATCHING,
    "cascade": """SELECT n.text, CASE WHEN m.text IS NOT NULL THEN m.brand END AS brand,
            CASE WHEN m.text IS NOT NULL THEN m.specific_type END AS specific_type,
            CASE WHEN m.text IS NOT NULL THEN m.category WHEN contains(n.text, 'bolt') THEN 'bolt' WHEN contains(n.text, 'r') THEN 'r' END AS category,
            CASE WHEN m.text IS NOT NULL THEN m.confidence WHEN contains(n.text, 'bolt') OR contains(n.text, 'r') THEN 0.8 END AS confidence,
            CASE WHEN m.text IS NOT NULL THEN 'dictionary' WHEN contains(n.text, 'bolt') THEN 'cache' WHEN contains(n.text, 'r') THEN 'model' END AS source,
            CASE WHEN m.text IS NOT NULL THEN 'dictionary' WHEN contains(n.text, 'bolt') THEN 'cache' WHEN contains(n.text, 'r') THEN 'external' ELSE 'none' END AS stage
        FROM (SELECT DISTINCT text FROM names) n LEFT JOIN matches m USING (text)""",
}


@query("match_cascade", S.sql("SELECT * FROM cascade", **CASCADE))
def match_cascade(spark, sf):
    return cascade_of(spark, sf)


@query(
    "updated_cache",
    S.sql("""SELECT text, 'bolt' AS category, 'cache' AS source FROM names WHERE contains(text, 'bolt') GROUP BY text
        UNION ALL SELECT text, category, source FROM cascade WHERE stage = 'external'""", **CASCADE),
)
def updated_cache(spark, sf):
    cache = _side_table(name_table(spark, sf), "bolt", "cache")
    return MT.updated_cache(cascade_of(spark, sf), cache).select("text", "category", "source")


@query(
    "match_report",
    S.sql(f"""SELECT count(*) AS names, count(*) FILTER (stage = 'dictionary') AS dictionary, count(*) FILTER (stage = 'cache') AS cache,
        count(*) FILTER (stage = 'external') AS external, count(*) FILTER (stage = 'none') AS unmatched,
        {sql6("count(*) FILTER (stage <> 'none') / count(*)")} AS rate FROM cascade""", **CASCADE),
)
def match_report(spark, sf):
    return R.match_report(cascade_of(spark, sf)).withColumn("rate", r6(F.col("rate")))


def named_texts(spark, sf):
    """Uses whose ingredient name is the free text of its part."""
    size = F.col("p_size")
    texts = S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(size % 6 < 2, F.col("p_name")).when(size % 6 < 5, F.substring_index("p_name", " ", -1))
        .otherwise(F.concat(F.lit("Odd "), brand_text())).alias("ingredient_name"),
    )
    return (
        S.table(spark, sf, "lineitem")
        .join(texts, "l_partkey")
        .select(F.col("l_orderkey").alias("recipe_id"), "ingredient_name", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("amount_ml"))
    )


@query(
    "apply_matches",
    S.sql(
        """SELECT recipe_id, ingredient_name, coalesce(amount_ml, 0) AS amount_ml,
            CASE WHEN contains(ingredient_name, ' ') THEN split_part(ingredient_name, ' ', 2) ELSE ingredient_name END AS category,
            CASE WHEN contains(ingredient_name, ' ') THEN ingredient_name ELSE 'generic' END AS specific_type, 'generic' AS brand
        FROM texts WHERE recipe_id NOT IN (SELECT recipe_id FROM texts WHERE ingredient_name LIKE 'Odd%' OR ingredient_name LIKE 'small%')""",
        texts="""SELECT l_orderkey AS recipe_id, CASE WHEN p_size % 6 < 2 THEN p_name WHEN p_size % 6 < 5 THEN split_part(p_name, ' ', 2)
            ELSE 'Odd ' || replace(p_brand, '#', ' ') END AS ingredient_name, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS amount_ml
            FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
)
def apply_matches(spark, sf):
    facts = named_texts(spark, sf)
    names = facts.select(F.col("ingredient_name").alias("text"))
    return MT.apply_matches(facts, MT.match_taxonomy(names, taxonomy_table(spark, sf)))


# --- catalogue and mapping ------------------------------------------------------


def spelled_names(spark, sf):
    size = F.col("p_size") % 3
    name = F.when(size == 0, F.col("p_name")).when(size == 1, F.concat(F.lit("Fresh "), "p_name")).otherwise(
        F.concat(F.upper("p_name"), F.lit(", fresh"))
    )
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), "p_name", "p_brand")


def catalogue(spark, sf):
    # Old ones are listed under another spelling, so that some names find no entry.
    name = F.regexp_replace("p_name", "^old", "ancient")
    return S.parts(spark, sf).select(F.col("item_id").alias("id"), F.initcap(name).alias("name"), F.col("item_path").alias("path"))


NAMES = {
    "spelled": """SELECT p_partkey AS id, p_name, p_brand, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Fresh ' || p_name ELSE upper(p_name) || ', fresh' END AS name FROM part""",
    "keyed": "SELECT *, regexp_replace(replace(lower(name), ', fresh', ''), '^fresh ', '') AS key FROM spelled",
    "catalogue": """SELECT item_id AS id, n AS key, item_path AS path, upper(n[1]) || split_part(n, ' ', 1)[2:] || ' ' || upper(split_part(n, ' ', 2)[1]) || split_part(n, ' ', 2)[2:] AS name
        FROM (SELECT *, regexp_replace(p_name, '^old', 'ancient') AS n FROM parts)""",
    "last_entries": "SELECT key, max(id) AS id, arg_max(name, id) AS name, arg_max(path, id) AS path FROM catalogue GROUP BY key",
    "mapping": "SELECT DISTINCT name, p_brand AS mapped_name FROM spelled WHERE p_brand = 'Brand#1' AND name = p_name",
}


def mapping_table(spark, sf):
    return (
        spelled_names(spark, sf)
        .where("p_brand = 'Brand#1' and name = p_name")
        .select("name", F.lit(1).cast("long").alias("mapped_id"), F.col("p_brand").alias("mapped_name"))
        .distinct()
    )


@query(
    "auto_match_exact",
    S.sql("""SELECT DISTINCT k.name, e.id AS mapped_id, e.name AS mapped_name, TRUE AS auto FROM keyed k JOIN last_entries e USING (key)
        WHERE k.name NOT IN (SELECT name FROM mapping)""", **NAMES),
)
def auto_match_exact(spark, sf):
    out = MT.auto_match_exact(spelled_names(spark, sf), mapping_table(spark, sf), catalogue(spark, sf))
    return out.drop("mapped_at")


@query(
    "suggest_matches",
    S.sql(
        f"""SELECT name, id, suggestion, path, similarity, exact, rank FROM (SELECT DISTINCT name, key FROM keyed) k JOIN (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY exact DESC, similarity DESC, id) AS rank FROM (
                SELECT key, id, name AS suggestion, path, 1.0 AS similarity, TRUE AS exact FROM last_entries
                UNION ALL SELECT k.key, c.id, c.name, c.path,
                    {sql6('1 - levenshtein(k.key, c.key) / greatest(length(k.key), length(c.key))')} AS similarity, FALSE
                FROM (SELECT DISTINCT key FROM keyed) k JOIN catalogue c ON k.key <> c.key
                WHERE 1 - levenshtein(k.key, c.key) / greatest(length(k.key), length(c.key)) >= 0.6 OR contains(k.key, c.key) OR contains(c.key, k.key))
        ) USING (key) WHERE rank <= 10""",
        **NAMES,
    ),
)
def suggest_matches(spark, sf):
    out = MT.suggest_matches(spelled_names(spark, sf), catalogue(spark, sf))
    return out.withColumn("similarity", r6(F.col("similarity")))


@query("suggest_matches_ratio")
def suggest_matches_ratio(spark, sf):
    return MT.suggest_matches(spelled_names(spark, sf), catalogue(spark, sf), measure="ratio")


@query(
    "search_catalogue",
    S.sql("SELECT id, name, path FROM catalogue WHERE contains(key, 'ring') ORDER BY id LIMIT 20", **NAMES),
)
def search_catalogue(spark, sf):
    return MT.search_catalogue(catalogue(spark, sf), "Fresh ring")


@query("variation_groups", S.sql("SELECT DISTINCT key, name FROM keyed", **NAMES))
def variation_groups(spark, sf):
    return MP.variation_groups(spelled_names(spark, sf))


@query(
    "variation_sets",
    S.sql("SELECT key, count(*) AS n, string_agg(name, '|' ORDER BY name) AS variations FROM (SELECT DISTINCT key, name FROM keyed) GROUP BY key", **NAMES),
)
def variation_sets(spark, sf):
    return MP.variation_sets(spelled_names(spark, sf)).withColumn("variations", F.concat_ws("|", "variations"))


_NEW = "SELECT DISTINCT name FROM keyed WHERE key LIKE 'hot%' AND name LIKE '%, fresh'"


@query(
    "unmapped_names",
    S.sql("""SELECT DISTINCT key, name FROM keyed WHERE key NOT IN (SELECT key FROM keyed WHERE name IN (SELECT name FROM mapping) OR name IN (SELECT name FROM new_names))""",
          new_names=_NEW, **NAMES),
)
def unmapped_names(spark, sf):
    names = spelled_names(spark, sf)
    new = names.where("lower(name) like 'hot%' and lower(name) like '%, fresh'").select("name").distinct()
    return MP.unmapped_names(names, mapping_table(spark, sf), new)


@query(
    "map_group",
    S.sql(
        """SELECT DISTINCT k.name, 'existing' AS type, d.ingredient_id AS mapped_id, c.name AS mapped_name
            FROM decisions d JOIN keyed k USING (key) JOIN catalogue c ON c.id = d.ingredient_id WHERE d.type = 'existing'
        UNION ALL SELECT DISTINCT k.name, 'new', NULL, NULL FROM decisions d JOIN keyed k USING (key) WHERE d.type = 'new'
        UNION ALL SELECT DISTINCT name, 'skip', NULL, NULL FROM decisions WHERE type = 'skip'""",
        decisions="""SELECT p_name AS name, p_name AS key, min(p_partkey) + 100000 AS ingredient_id,
            CASE WHEN p_name LIKE 'red%' THEN 'new' WHEN p_name LIKE 'hot%' THEN 'skip' ELSE 'existing' END AS type FROM part GROUP BY p_name""",
        **NAMES,
    ),
)
def map_group(spark, sf):
    kind = F.when(F.col("name").like("red%"), "new").when(F.col("name").like("hot%"), "skip").otherwise("existing")
    decisions = (
        S.table(spark, sf, "part")
        .groupBy(F.col("p_name").alias("name"))
        .agg((F.min("p_partkey") + 100000).alias("ingredient_id"))
        .withColumn("type", kind)
    )
    return MP.map_group(spelled_names(spark, sf), decisions, catalogue(spark, sf))


def named_uses(spark, sf):
    n = F.col("l_linenumber")
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    mark = F.when(n == 6, "Optional ").when(n == 7, "Omit if dry: ").otherwise("")
    return (
        S.table(spark, sf, "lineitem")
        .join(parts, "l_partkey")
        .select(
            F.col("l_orderkey").alias("recipe_id"), n.alias("line"), F.concat(mark, "p_name").alias("ingredient_name"),
            F.col("l_quantity").alias("amount"), F.lit("oz").alias("unit_name"),
        )
    )


def name_mapping(spark, sf):
    return (
        S.table(spark, sf, "part")
        .where("p_name not like '%bolt'")
        .groupBy(F.col("p_name").alias("name"))
        .agg(F.min("p_partkey").alias("mapped_id"), F.min("p_brand").alias("mapped_name"))
    )


USES = {
    "named": """SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_quantity AS amount,
        CASE l_linenumber WHEN 6 THEN 'Optional ' WHEN 7 THEN 'Omit if dry: ' ELSE '' END || p_name AS ingredient_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "name_map": "SELECT p_name AS name, min(p_partkey) AS mapped_id, min(p_brand) AS mapped_name FROM part WHERE p_name NOT LIKE '%bolt' GROUP BY p_name",
    "open_uses": "SELECT recipe_id, ingredient_name FROM named WHERE line < 6 AND ingredient_name NOT IN (SELECT name FROM name_map)",
    "docs": """SELECT o_orderkey AS recipe_id, o_orderstatus AS source,
        CASE WHEN o_orderpriority = '2-HIGH' THEN 'Shot ' ELSE 'Order ' END || (o_orderkey % 5000) AS recipe_name,
        'raw_recipes/html/' || o_orderkey || '.html' AS path,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'Serve in a shot glass' ELSE 'Shake' END AS instructions FROM orders""",
    "log": """SELECT CASE doc_id % 2 WHEN 0 THEN 'O' ELSE 'F' END AS source, 'Order ' || doc_id AS recipe_name,
        CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'needs_review' END AS status FROM labels""",
    "outcomes": """SELECT d.*, CASE WHEN EXISTS (SELECT 1 FROM log l WHERE l.source = d.source AND l.recipe_name = d.recipe_name AND l.status <> 'needs_review') THEN 'processed'
            WHEN instructions LIKE '%shot glass%' OR recipe_name LIKE '%Shot%' THEN 'shot'
            WHEN coalesce(n, 0) <= 2 THEN 'short' WHEN recipe_id IN (SELECT recipe_id FROM open_uses) THEN 'needs_review' ELSE 'auto_ingested' END AS o
        FROM docs d LEFT JOIN (SELECT recipe_id, count(*) AS n FROM named GROUP BY ALL) USING (recipe_id)""",
}


def recipe_docs(spark, sf):
    key = F.col("o_orderkey")
    name = F.concat(F.when(F.col("o_orderpriority") == "2-HIGH", "Shot ").otherwise("Order "), (key % 5000).cast("string"))
    return S.table(spark, sf, "orders").select(
        key.alias("recipe_id"), F.col("o_orderstatus").alias("source"), name.alias("recipe_name"),
        F.concat(F.lit("raw_recipes/html/"), key.cast("string"), F.lit(".html")).alias("path"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Serve in a shot glass").otherwise("Shake").alias("instructions"),
    )


def status_log(spark, sf):
    return S.table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, "O").otherwise("F").alias("source"),
        F.concat_ws(" ", F.lit("Order"), F.col("doc_id").cast("string")).alias("recipe_name"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("needs_review").alias("status"),
    )


@query(
    "apply_mapping",
    S.sql("""SELECT recipe_id, line, coalesce(mapped_name, ingredient_name) AS ingredient_name, amount
        FROM named LEFT JOIN name_map ON name = ingredient_name WHERE line < 6""", **USES),
)
def apply_mapping(spark, sf):
    return MP.apply_mapping(named_uses(spark, sf), name_mapping(spark, sf)).select("recipe_id", "line", "ingredient_name", "amount")


@query(
    "rebuild_recipes",
    S.sql(
        f"""SELECT recipe_id, recipe_name, '{MP.STANDARD_INSTRUCTIONS}' AS instructions, string_agg(e, '|' ORDER BY e) AS ingredients,
            'https://example.org/' || lower(replace(recipe_name, ' ', '-')) || '/' AS source_url
        FROM (SELECT recipe_id, coalesce(mapped_name, ingredient_name) || '=' || CAST(amount AS INTEGER) AS e
              FROM named LEFT JOIN name_map ON name = ingredient_name WHERE line < 6) JOIN docs USING (recipe_id) GROUP BY ALL""",
        **USES,
    ),
)
def rebuild_recipes(spark, sf):
    mapped = MP.apply_mapping(named_uses(spark, sf), name_mapping(spark, sf))
    out = MP.rebuild_recipes(mapped, recipe_docs(spark, sf), "https://example.org/", "/")
    entry = lambda x: F.concat_ws("=", x["ingredient_name"], x["amount"].cast("int").cast("string"))
    return out.select(
        "recipe_id", "recipe_name", "instructions", "source_url",
        F.concat_ws("|", F.array_sort(F.transform("ingredients", entry))).alias("ingredients"),
    )


@query("unmapped_uses", S.sql("SELECT * FROM open_uses", **USES))
def unmapped_uses(spark, sf):
    return MP.unmapped_uses(named_uses(spark, sf), name_mapping(spark, sf))


@query(
    "mappable_recipes",
    S.sql("""SELECT recipe_id, count(o) = 0 AS mappable, count(o) AS n_unmapped FROM (
        SELECT recipe_id, CASE WHEN line < 6 AND name IS NULL THEN 1 END AS o FROM named LEFT JOIN name_map ON name = ingredient_name) GROUP BY ALL""", **USES),
)
def mappable_recipes(spark, sf):
    return MP.mappable_recipes(named_uses(spark, sf), name_mapping(spark, sf))


@query(
    "unprocessed",
    S.sql("SELECT recipe_id, source, recipe_name FROM outcomes WHERE o <> 'processed'", **USES),
)
def unprocessed(spark, sf):
    return MP.unprocessed(recipe_docs(spark, sf), status_log(spark, sf)).select("recipe_id", "source", "recipe_name")


@query(
    "batch_gate",
    S.sql("""SELECT recipe_id, source, recipe_name, CASE WHEN o = 'auto_ingested' AND
        row_number() OVER (PARTITION BY source, recipe_name, o ORDER BY path, recipe_id) > 1 THEN 'repeated' ELSE o END AS outcome FROM outcomes""", **USES),
)
def batch_gate(spark, sf):
    return MP.batch_gate(recipe_docs(spark, sf), named_uses(spark, sf), name_mapping(spark, sf), status_log(spark, sf))


TWO_MAPPINGS = {
    "side_a": "SELECT p_name AS name, min(p_partkey) AS mapped_id, min(p_brand) AS mapped_name FROM part WHERE p_size < 26 GROUP BY 1",
    "side_b": "SELECT p_name AS name, min(p_partkey) AS mapped_id, min(p_brand) AS mapped_name FROM part WHERE p_type <> 'PROMO' GROUP BY 1",
    "merged": """SELECT name, coalesce(a.mapped_id, b.mapped_id) AS mapped_id, coalesce(a.mapped_name, b.mapped_name) AS mapped_name,
            CASE WHEN a.mapped_id IS NOT NULL AND b.mapped_id IS NOT NULL THEN 'both' WHEN a.mapped_id IS NOT NULL THEN 'primary' ELSE 'secondary' END AS origin,
            coalesce(a.mapped_id <> b.mapped_id OR a.mapped_name <> b.mapped_name, FALSE) AS conflict
        FROM side_a a FULL JOIN side_b b USING (name)""",
}


def merged_of(spark, sf):
    p = S.table(spark, sf, "part")
    agg = (F.min("p_partkey").alias("mapped_id"), F.min("p_brand").alias("mapped_name"))
    a = p.where("p_size < 26").groupBy(F.col("p_name").alias("name")).agg(*agg)
    b = p.where("p_type <> 'PROMO'").groupBy(F.col("p_name").alias("name")).agg(*agg)
    return MP.merge_mappings(a, b)


@query("merge_mappings", S.sql("SELECT * FROM merged", **TWO_MAPPINGS))
def merge_mappings(spark, sf):
    return merged_of(spark, sf)


@query(
    "merge_counts",
    S.sql("""SELECT count(*) FILTER (origin <> 'secondary') AS primary_keys, count(*) FILTER (origin <> 'primary') AS secondary_keys,
        count(*) AS merged_keys, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (origin = 'secondary') AS added_from_secondary FROM merged""", **TWO_MAPPINGS),
)
def merge_counts(spark, sf):
    return MP.merge_counts(merged_of(spark, sf))


_DECIDED = {
    **USES,
    "decided": """SELECT 'O' AS source, 'Order ' || user_id AS recipe_name, arg_max(CASE WHEN event_type = 'purchase' THEN 'accepted' ELSE 'rejected' END, event_id) AS status
        FROM events GROUP BY user_id""",
}


@query(
    "update_status",
    S.sql("""SELECT * FROM decided UNION ALL SELECT source, recipe_name, status FROM log
        WHERE (source, recipe_name) NOT IN (SELECT (source, recipe_name) FROM decided)""", **_DECIDED),
)
def update_status(spark, sf):
    decisions = S.table(spark, sf, "events").select(
        F.lit("O").alias("source"), F.concat_ws(" ", F.lit("Order"), F.col("user_id").cast("string")).alias("recipe_name"),
        F.when(F.col("event_type") == "purchase", "accepted").otherwise("rejected").alias("status"), F.col("event_id").alias("at"),
    )
    return MP.update_status(status_log(spark, sf), decisions)


@query("reset_status", S.sql("SELECT * FROM log WHERE source <> 'F'", **USES))
def reset_status(spark, sf):
    return MP.reset_status(status_log(spark, sf), "F")


@query(
    "recipes_using",
    S.sql("""SELECT ingredient_name, rank, recipe_id, recipe_name FROM (SELECT *, row_number() OVER (PARTITION BY ingredient_name ORDER BY recipe_id) AS rank
        FROM (SELECT DISTINCT ingredient_name, recipe_id FROM named)) JOIN docs USING (recipe_id) WHERE rank <= 5""", **USES),
)
def recipes_using(spark, sf):
    return MP.recipes_using(named_uses(spark, sf), recipe_docs(spark, sf))


@query(
    "lookup_recipe_id",
    S.sql("""SELECT page_id, 'raw_recipes/html/' || page_id || '.html' AS file, recipe_id, recipe_name
        FROM pages LEFT JOIN docs ON recipe_id = page_id""", **USES),
)
def lookup_recipe_id(spark, sf):
    pages = S.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/data/in/html/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path")
    )
    stored = recipe_docs(spark, sf).withColumnRenamed("path", "source_file")
    return MP.lookup_recipe_id(pages, stored).select("page_id", T.db_path(F.col("path")).alias("file"), "recipe_id", "recipe_name")


@query(
    "assign_class",
    S.sql("""SELECT recipe_id, recipe_name, coalesce(class, 'other') AS class FROM recipes
        LEFT JOIN (SELECT 'Order ' || (c_custkey % 1000) AS recipe_name, arg_max(c_mktsegment, c_custkey) AS class FROM customer GROUP BY 1) USING (recipe_name)"""),
)
def assign_class(spark, sf):
    classes = S.table(spark, sf, "customer").select(
        F.concat_ws(" ", F.lit("Order"), (F.col("c_custkey") % 1000).cast("string")).alias("recipe_name"),
        F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("ord"),
    )
    return MP.assign_class(S.recipes(spark, sf), classes)


# --- reports --------------------------------------------------------------------


def usage_of(spark, sf, minimum=1):
    return R.ingredient_usage(S.uses(spark, sf), S.ingredients(spark, sf), S.recipes(spark, sf), minimum)


@query(
    "ingredient_usage",
    S.sql("""SELECT ingredient_id, ingredient_name, recipe_count, array_to_string(list_sort(samples)[1:3], '|') AS sample_recipes FROM (
        SELECT u.ingredient_id, ingredient_name, count(DISTINCT recipe_id) AS recipe_count, list(DISTINCT recipe_name) AS samples
        FROM uses u JOIN ingredients i ON i.ingredient_id = u.ingredient_id JOIN recipes USING (recipe_id) GROUP BY ALL HAVING count(DISTINCT recipe_id) >= 25)"""),
)
def ingredient_usage(spark, sf):
    return usage_of(spark, sf, 25).withColumn("sample_recipes", F.concat_ws("|", "sample_recipes"))


@query(
    "unmapped_top",
    S.sql("SELECT ingredient_name, count(*) AS n FROM open_uses GROUP BY ALL ORDER BY n DESC, ingredient_name LIMIT 10", **USES),
)
def unmapped_top(spark, sf):
    return R.unmapped_top(unmapped_uses(spark, sf))


@query(
    "rationalization_stats",
    S.sql(
        """SELECT (SELECT count(DISTINCT recipe_id) FROM named) AS total_recipes, (SELECT count(DISTINCT ingredient_name) FROM named) AS total_unique_ingredients,
            (SELECT count(*) FROM name_map) AS mapped_ingredients, (SELECT count(*) FROM open_uses) AS unmapped_ingredients,
            (SELECT count(*) FROM labels WHERE quality = 1) AS processed, (SELECT count(*) FROM labels WHERE quality <> 1) AS skipped,
            (SELECT count(*) FROM supplier) AS new_ingredients, (SELECT count(*) FROM part) AS catalogue_entries""",
        **USES,
    ),
)
def rationalization_stats(spark, sf):
    processed = S.table(spark, sf, "labels").select(
        F.col("doc_id"), F.when(F.col("quality") == 1, "processed").otherwise("skipped").alias("status")
    )
    return R.rationalization_stats(
        named_uses(spark, sf), name_mapping(spark, sf), unmapped_uses(spark, sf), processed,
        S.table(spark, sf, "supplier"), S.table(spark, sf, "part"),
    )


@query(
    "status_counts",
    S.sql("""SELECT source, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected,
        count(*) FILTER (status IN ('accepted', 'rejected')) AS total FROM log GROUP BY source""", **USES),
)
def status_counts(spark, sf):
    return R.status_counts(status_log(spark, sf))


@query(
    "facet_values",
    S.sql("""SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL
        SELECT 'type', p_type, count(*) FROM part GROUP BY ALL UNION ALL
        SELECT 'word', w, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL"""),
)
def facet_values(spark, sf):
    listing = S.table(spark, sf, "part").withColumn("words", F.split("p_name", " "))
    return R.facet_values(listing, {"brand": "p_brand", "type": "p_type", "word": "words"})


def named_cells(spark, sf):
    return S.matrix(spark, sf).join(S.ingredients(spark, sf).select("ingredient_id", "ingredient_name"), "ingredient_id")


_NAMED_CELLS = "SELECT recipe_id, ingredient_name, w FROM matrix JOIN ingredients USING (ingredient_id)"


@query(
    "recipe_string",
    S.sql("""SELECT recipe_id, string_agg(ingredient_name || ': ' || CAST(CAST(round(CAST(w AS DECIMAL(10, 6)), 3) AS DECIMAL(10, 3)) AS VARCHAR), ' | ' ORDER BY w DESC, ingredient_name) AS description
        FROM (SELECT recipe_id, ingredient_name, round(w, 6) AS w FROM named_cells) GROUP BY recipe_id""", named_cells=_NAMED_CELLS),
)
def recipe_string(spark, sf):
    return R.recipe_string(named_cells(spark, sf).withColumn("w", F.round("w", 6)))


@query(
    "recipe_string_boolean",
    S.sql("SELECT recipe_id, string_agg(ingredient_name, ' | ' ORDER BY ingredient_name) AS description FROM named_cells GROUP BY recipe_id", named_cells=_NAMED_CELLS),
)
def recipe_string_boolean(spark, sf):
    return R.recipe_string(named_cells(spark, sf), boolean=True)


@query(
    "distance_summary",
    S.sql(
        f"""SELECT n * (n - 1) // 2 AS n_pairs, {sql6('CASE WHEN whole.n_sharing < n * (n - 1) // 2 THEN least(min_d, 2.0) ELSE min_d END')} AS min_d,
            {sql6('CASE WHEN whole.n_sharing < n * (n - 1) // 2 THEN 2.0 ELSE max_d END')} AS max_d, {sql6('2 - total / (n * (n - 1) // 2)')} AS mean_d
        FROM (SELECT count(*) AS n_sharing, min(d) AS min_d, max(d) AS max_d, sum(2 - d) AS total FROM sharing WHERE id < neighbour) whole,
            (SELECT count(DISTINCT recipe_id) AS n FROM matrix)""",
    ),
)
def distance_summary(spark, sf):
    """Over all pairs of recipes, copies and those that share nothing included."""
    from blendspark.plans.tables import bags_of

    out = R.all_pairs_summary(*bags_of(spark, sf))
    return out.select("n_pairs", *(r6(F.col(c)).alias(c) for c in ("min_d", "max_d", "mean_d")))


@query(
    "near_summary",
    S.sql(f"""SELECT count(*) AS n_pairs, {sql6('min(d)')} AS min_d, {sql6('max(d)')} AS max_d, {sql6('avg(d)')} AS mean_d FROM manhattan"""),
)
def near_summary(spark, sf):
    from blendspark.plans.tables import manhattan_pairs

    out = R.distance_summary(manhattan_pairs(spark, sf))
    return out.select("n_pairs", *(r6(F.col(c)).alias(c) for c in ("min_d", "max_d", "mean_d")))


@query(
    "column_summary",
    f"""SELECT position, {sql6('avg(x)')} AS mean, {sql6('stddev_pop(x)')} AS std, {sql6('min(x)')} AS min, {sql6('max(x)')} AS max FROM (
        SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY position""",
)
def column_summary(spark, sf):
    out = R.column_summary(S.table(spark, sf, "embeddings"))
    return out.select("position", *(r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")))


@query("flag_matches", S.sql("SELECT recipe_id, recipe_name, contains(lower(recipe_name), 'r 12') AS matches FROM recipes"))
def flag_matches(spark, sf):
    return R.flag_matches(S.recipes(spark, sf), "R 12")


@query("flag_count", S.sql("SELECT count(*) FILTER (contains(lower(recipe_name), 'r 12')) AS matching, count(*) AS total FROM recipes"))
def flag_count(spark, sf):
    return R.flag_count(flag_matches(spark, sf))


@query(
    "sample_lines",
    S.sql("SELECT * FROM parsed WHERE recipe_id IN (SELECT recipe_id FROM (SELECT DISTINCT recipe_id FROM line_texts) ORDER BY md5('42|' || recipe_id) LIMIT 20)", **PARSED),
)
def sample_lines(spark, sf):
    return R.sample_lines(line_table(spark, sf), 20)


@query(
    "match_split_report",
    S.sql(
        f"""SELECT confidence, count(*) AS names, sum(n) AS uses, {sql6('count(*) / sum(count(*)) OVER ()')} AS name_share,
            {sql6('sum(n) / sum(sum(n)) OVER ()')} AS use_share
        FROM (SELECT text, count(*) AS n FROM names GROUP BY text) LEFT JOIN matches USING (text) GROUP BY confidence""",
        **MATCHING,
    ),
)
def match_split_report(spark, sf):
    usage = name_table(spark, sf).groupBy(F.col("text").alias("ingredient_name")).agg(F.count("*").alias("recipe_count"))
    out = R.match_split_report(usage, matches_of(spark, sf))
    return out.withColumn("name_share", r6(F.col("name_share"))).withColumn("use_share", r6(F.col("use_share")))


@query(
    "compare_annotators",
    """SELECT doc_id AS item, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS quality, CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS toxic,
        (quality = 1) = (toxic = 0) AS agree FROM labels""",
)
def compare_annotators(spark, sf):
    labels = S.table(spark, sf, "labels")
    good = lambda hit: F.when(hit, "good").otherwise("bad").alias("label")
    rows = labels.select(F.col("doc_id").alias("item"), F.lit("quality").alias("annotator"), good(F.col("quality") == 1)).unionByName(
        labels.select(F.col("doc_id").alias("item"), F.lit("toxic").alias("annotator"), good(F.col("toxic") == 0))
    )
    return R.compare_annotators(rows, ["quality", "toxic"])
