"""Queries that write derived tables to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blendspark.operators.lineage import shared_folder
from blendspark.operators import mapping as MP
from blendspark.plans import standins as S
from blendspark.plans.registry import query
from blendspark.plans.texts import MATCHING, USES, matches_of, name_mapping, named_uses, recipe_docs, status_log
from blendspark.sources import readers, writers


def _place(spark) -> str:
    return f"{shared_folder(spark.sparkContext)}/{uuid.uuid4().hex}"


@query(
    "recipe_batches",
    S.sql("SELECT recipe_id, source, 1 + (row_number() OVER (PARTITION BY source ORDER BY path) - 1) // 100 AS batch FROM docs", **USES),
)
def recipe_batches(spark, sf):
    place = _place(spark)
    writers.write_recipe_batches(recipe_docs(spark, sf), place)
    rows = spark.read.schema("recipe_id long, source string, batch long").json(place)
    return rows.select("recipe_id", "source", "batch")


@query(
    "match_cache",
    S.sql("SELECT text AS name, brand, specific_type, category, confidence, source FROM matches", **MATCHING),
)
def match_cache(spark, sf):
    place = _place(spark)
    writers.write_match_cache(matches_of(spark, sf), place, "text")
    return readers.read_match_cache(spark, place)


@query("mapping_lines", S.sql("SELECT name, mapped_id, mapped_name FROM name_map", **USES))
def mapping_lines(spark, sf):
    place = _place(spark)
    writers.write_mapping(name_mapping(spark, sf), place)
    return spark.read.schema("name string, mapped_id long, mapped_name string").json(place)


@query("status_partitions", S.sql("SELECT source, recipe_name, 'rejected' AS status FROM log WHERE source = 'O' UNION ALL SELECT source, recipe_name, status FROM log WHERE source = 'F'", **USES))
def status_partitions(spark, sf):
    place = _place(spark)
    log = status_log(spark, sf)
    writers.write_status_log(log, place)
    writers.write_status_log(log.where("source = 'O'").withColumn("status", F.lit("rejected")), place)
    return spark.read.parquet(place).select("source", "recipe_name", "status")


@query(
    "recipe_documents",
    S.sql(
        """SELECT recipe_name AS name, coalesce(mapped_name, ingredient_name) AS ingredient_name, amount
        FROM named JOIN docs USING (recipe_id) LEFT JOIN name_map ON name = ingredient_name WHERE line < 6""",
        **USES,
    ),
)
def recipe_documents(spark, sf):
    place = _place(spark)
    mapped = MP.apply_mapping(named_uses(spark, sf), name_mapping(spark, sf))
    writers.write_recipes(MP.rebuild_recipes(mapped, recipe_docs(spark, sf), "https://example.org/"), place)
    schema = "recipe_name string, ingredients array<struct<ingredient_name:string,amount:double,unit_name:string>>"
    rows = spark.read.schema(schema).json(place).select(F.col("recipe_name").alias("name"), F.explode("ingredients").alias("i"))
    return rows.select("name", "i.ingredient_name", "i.amount")


@query(
    "wide_matrix",
    S.sql("SELECT recipe_id, 'qty_' || l_returnflag AS column, w FROM (SELECT l_orderkey AS recipe_id, l_returnflag, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"),
)
def wide_matrix(spark, sf):
    place = _place(spark)
    lines = S.table(spark, sf, "lineitem")
    flags = ("A", "N", "R")
    lines.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(
        *(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(f"qty_{f}") for f in flags)
    ).write.parquet(place)
    return readers.read_matrix(spark, place)
