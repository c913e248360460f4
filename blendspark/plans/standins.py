"""Recipe-like tables derived from the order tables, in Spark and in SQL.

An order is a recipe, a part is an ingredient below its brand and its type, and
a line item is one use of an ingredient.  Everything covers the whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendspark.functions.units import unit_rows, unit_table
from blendspark.operators import facts as facts_ops
from blendspark.operators import matrix as matrix_ops

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """part with its node ids and path."""
    type_id = F.array_position(F.array(*(F.lit(t) for t in TYPES)), F.col("p_type"))
    brand_no = F.substring("p_brand", 7, 10).cast("long")
    leaf = F.col("p_partkey") + 100000
    brand = F.col("type_id") * 1000 + F.col("brand_no")
    return (
        table(spark, folder, "part")
        .withColumn("type_id", type_id)
        .withColumn("brand_no", brand_no)
        .withColumn("brand_id", brand)
        .withColumn("item_id", leaf)
        .withColumn("brand_path", F.concat(F.lit("/"), F.col("type_id"), F.lit("/"), F.col("brand_id"), F.lit("/")))
        .withColumn("item_path", F.concat(F.col("brand_path"), F.col("item_id"), F.lit("/")))
    )


def ingredients(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder)
    leaves = p.select(
        F.col("item_id").alias("ingredient_id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("ingredient_name"),
        F.col("item_path").alias("path"),
        F.col("brand_id").alias("parent_id"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 2).cast("int").alias("substitution_level"),
    )
    brands = p.select(
        F.col("brand_id").alias("ingredient_id"),
        F.concat_ws(" ", "p_type", "p_brand").alias("ingredient_name"),
        F.col("brand_path").alias("path"),
        F.col("type_id").alias("parent_id"),
        (F.col("brand_no") % 2).cast("int").alias("substitution_level"),
    ).distinct()
    types = p.select(
        F.col("type_id").alias("ingredient_id"),
        F.col("p_type").alias("ingredient_name"),
        F.concat(F.lit("/"), F.col("type_id"), F.lit("/")).alias("path"),
        F.lit(None).cast("long").alias("parent_id"),
        F.lit(0).alias("substitution_level"),
    ).distinct()
    return leaves.unionByName(brands).unionByName(types)


def tree(spark: SparkSession, folder: str) -> DataFrame:
    return facts_ops.load_ingredient_tree(ingredients(spark, folder))


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("recipe_id"),
        F.concat_ws(" ", F.lit("Order"), (F.col("o_orderkey") % 5000).cast("string")).alias("recipe_name"),
    )


def _unit() -> Column:
    line = F.col("l_linenumber")
    return (
        F.when((F.col("l_linestatus") == "O") & (line == 7), F.lit(None))
        .when(F.col("l_returnflag") == "N", "to top")
        .when(line == 6, "slice")
        .when(line == 5, "smidgen")
        .when(F.col("l_returnflag") == "R", "oz")
        .otherwise("Dashes")
    )


def uses(spark: SparkSession, folder: str) -> DataFrame:
    no_amount = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("recipe_id"),
        (F.col("l_partkey") + 100000).alias("ingredient_id"),
        F.col("l_linenumber").alias("line"),
        F.when(~no_amount, F.col("l_quantity")).alias("amount"),
        _unit().alias("unit_name"),
    )


def units(spark: SparkSession) -> DataFrame:
    """Spelling and factor of each unit with a factor, as a unit table stores them."""
    return (
        unit_table(spark)
        .where("kind = 'factor'")
        .select(F.col("alias").alias("unit_name"), F.col("factor").alias("conversion_to_ml"))
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return facts_ops.load_recipe_facts(
        recipes(spark, folder), uses(spark, folder), ingredients(spark, folder), units(spark)
    )


def fractions(spark: SparkSession, folder: str) -> DataFrame:
    return facts_ops.volume_fraction(facts_ops.with_volume(facts(spark, folder)))


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    return matrix_ops.recipe_matrix(facts(spark, folder))


def item_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Given pairs of ingredients: the part of a line with the part whose key is
    that of the customer."""
    return (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .select((F.col("l_partkey") + 100000).alias("id1"), (F.col("o_custkey") + 100000).alias("id2"))
        .where("id1 <> id2")
        .distinct()
    )


def recipe_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Given pairs of recipes: the order of a line with the order whose key is that
    of the part."""
    return (
        table(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("id1"), F.col("l_partkey").alias("id2"))
        .where("id1 <> id2")
        .distinct()
    )


def r6(expr: str) -> str:
    return f"CASE WHEN abs({expr}) < 5e-7 THEN 0.0 ELSE CAST(round(CAST({expr} AS DECIMAL(28, 10)), 6) AS DOUBLE) END"


_TYPE_CASE = "CASE p_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " END"
_RULES = ", ".join(f"('{a}', '{u}', '{k}', CAST({f} AS DOUBLE))" for a, u, k, f in unit_rows())

CTES = {
    "parts": f"""
        SELECT *, CAST(type_id * 1000 + brand_no AS BIGINT) AS brand_id, p_partkey + 100000 AS item_id,
               '/' || type_id || '/' || (type_id * 1000 + brand_no) || '/' AS brand_path,
               '/' || type_id || '/' || (type_id * 1000 + brand_no) || '/' || (p_partkey + 100000) || '/' AS item_path
        FROM (SELECT *, CAST({_TYPE_CASE} AS BIGINT) AS type_id,
                     CAST(substr(p_brand, 7) AS BIGINT) AS brand_no FROM part)""",
    "ingredients": """
        SELECT item_id AS ingredient_id, p_name || ' ' || p_partkey AS ingredient_name, item_path AS path,
               brand_id AS parent_id, CASE WHEN p_size % 5 <> 0 THEN p_size % 2 END AS substitution_level
        FROM parts
        UNION ALL SELECT DISTINCT brand_id, p_type || ' ' || p_brand, brand_path, type_id, CAST(brand_no % 2 AS INTEGER) FROM parts
        UNION ALL SELECT DISTINCT type_id, p_type, '/' || type_id || '/', CAST(NULL AS BIGINT), 0 FROM parts""",
    "tree": """
        SELECT ingredient_id, ingredient_name, path, parent_id, coalesce(substitution_level, 0) AS substitution_level,
               list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS nodes,
               nullif(regexp_replace(path, '[^/]+/$', ''), '/') AS parent_path
        FROM ingredients""",
    "recipes": "SELECT o_orderkey AS recipe_id, 'Order ' || (o_orderkey % 5000) AS recipe_name FROM orders",
    "uses": """
        SELECT l_orderkey AS recipe_id, l_partkey + 100000 AS ingredient_id, l_linenumber AS line,
               CASE WHEN NOT (l_returnflag = 'N' AND l_linestatus = 'O') THEN l_quantity END AS amount,
               CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL WHEN l_returnflag = 'N' THEN 'to top'
                    WHEN l_linenumber = 6 THEN 'slice' WHEN l_linenumber = 5 THEN 'smidgen'
                    WHEN l_returnflag = 'R' THEN 'oz' ELSE 'Dashes' END AS unit_name
        FROM lineitem""",
    "rules": f"SELECT * FROM (VALUES {_RULES}) v(alias, unit, kind, factor)",
    "units": "SELECT alias AS unit_name, factor AS conversion_to_ml FROM rules WHERE kind = 'factor'",
    "facts": """
        SELECT recipe_id, recipe_name, u.ingredient_id, ingredient_name, path AS ingredient_path,
               coalesce(substitution_level, 0) AS substitution_level, amount, u.unit_name, conversion_to_ml
        FROM uses u JOIN recipes USING (recipe_id) JOIN ingredients i ON u.ingredient_id = i.ingredient_id
        LEFT JOIN units t ON u.unit_name = t.unit_name""",
    "volumes": "SELECT *, CASE WHEN unit_name = 'to top' THEN 90.0 ELSE amount * conversion_to_ml END AS volume_ml FROM facts",
    "fractions": "SELECT *, volume_ml / nullif(sum(volume_ml) OVER (PARTITION BY recipe_id), 0) AS volume_fraction FROM volumes",
    "cells": """
        SELECT recipe_id, ingredient_id, sum(coalesce(amount * conversion_to_ml, amount, 1.0)) AS v
        FROM facts GROUP BY ALL""",
    "matrix": """
        SELECT recipe_id, ingredient_id, v / sum(v) OVER (PARTITION BY recipe_id) AS w FROM cells WHERE v <> 0""",
    "bag_keys": """
        SELECT recipe_id, string_agg(ingredient_id || ':' || w, ',' ORDER BY ingredient_id) AS content
        FROM matrix GROUP BY recipe_id""",
    "members": """
        SELECT recipe_id, min(recipe_id) OVER (PARTITION BY content) AS bag_id, count(*) OVER (PARTITION BY content) AS copies
        FROM bag_keys""",
    "bags": "SELECT m.* FROM matrix m JOIN members USING (recipe_id) WHERE recipe_id = bag_id",
    "sizes": "SELECT recipe_id, count(*) AS n FROM bags GROUP BY recipe_id",
    "set_pairs": """
        SELECT id1, id2, a.n AS n1, b.n AS n2, c, a.n + b.n - 2 * c AS d
        FROM (SELECT x.recipe_id AS id1, y.recipe_id AS id2, count(*) AS c
              FROM bags x JOIN bags y ON x.ingredient_id = y.ingredient_id AND x.recipe_id < y.recipe_id GROUP BY ALL)
        JOIN sizes a ON a.recipe_id = id1 JOIN sizes b ON b.recipe_id = id2""",
    "manhattan": """
        SELECT id1, id2, d FROM (
            SELECT x.recipe_id AS id1, y.recipe_id AS id2, greatest(2 - 2 * sum(least(x.w, y.w)), 0) AS d
            FROM bags x JOIN bags y ON x.ingredient_id = y.ingredient_id AND x.recipe_id < y.recipe_id GROUP BY ALL)
        WHERE d <= 1.0 + 1e-9""",
    "sharing": """
        SELECT x.recipe_id AS id, y.recipe_id AS neighbour, greatest(2 - 2 * sum(least(x.w, y.w)), 0) AS d
        FROM matrix x JOIN matrix y ON x.ingredient_id = y.ingredient_id AND x.recipe_id <> y.recipe_id GROUP BY ALL""",
    "lowest": "SELECT DISTINCT recipe_id FROM matrix ORDER BY recipe_id LIMIT 40",
    "apart": """
        SELECT a.recipe_id AS id, b.recipe_id AS neighbour, 2.0 AS d FROM (SELECT DISTINCT recipe_id FROM matrix) a
        JOIN lowest b ON a.recipe_id <> b.recipe_id WHERE (a.recipe_id, b.recipe_id) NOT IN (SELECT (id, neighbour) FROM sharing)""",
    "nearest": f"""
        SELECT id, neighbour, rank, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM (
            SELECT id, neighbour, {r6('d')} AS d FROM sharing UNION ALL SELECT * FROM apart)) WHERE rank <= 10""",
    "item_pairs": """
        SELECT DISTINCT l_partkey + 100000 AS id1, o_custkey + 100000 AS id2
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey <> o_custkey""",
    "recipe_pairs": "SELECT DISTINCT l_orderkey AS id1, l_partkey AS id2 FROM lineitem WHERE l_orderkey <> l_partkey",
}


def sql(body: str, **extra: str) -> str:
    """The body with the tables it names put in front, in the order they need."""
    known = {**CTES, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + "\n" + body
