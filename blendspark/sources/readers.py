"""Reading pages, documents, dictionaries, logs and matrices.

JSON documents that hold one dictionary are read a file at a time; tables of the
same content can be stored as JSON lines or Parquet and read by Spark directly.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECIPES = (
    "recipes array<struct<name:string,description:string,instructions:string,source:string,source_url:string,"
    "ingredients:array<struct<ingredient_name:string,amount:string,unit_name:string>>>>"
)
MAPPING = "map<string,struct<id:bigint,name:string,mapped_at:timestamp,auto_matched:boolean>>"
REVIEW = "array<struct<recipe_name:string,unmapped_ingredients:array<string>>>"
STATUS = f"struct<accepted:array<string>,rejected:array<string>,auto_ingested:array<string>,needs_review:{REVIEW}>"
PROGRESS = "processed array<string>, skipped array<string>"
MATCH_CACHE = "name string, brand string, specific_type string, category string, confidence double, source string"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``value``; a missing file is an empty table."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def read_page_corpus(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """(source, path, html) of all pages of one source, without state files."""
    pages = spark.read.text(f"{folder}/*.html", wholetext=True).select(
        F.lit(source).alias("source"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )
    return pages.where(~F.col("path").contains("download_state"))


def skip_listed_pages(pages: DataFrame, skip_file: str) -> DataFrame:
    """Pages whose path ends in a listed file name fall away; ``#`` starts a comment."""
    listed = (
        pages.sparkSession.read.text(skip_file)
        .select(F.trim("value").alias("_file"))
        .where("_file <> '' and _file not like '#%'")
        .select(F.substring_index("_file", "/", -1).alias("_file"))
        .distinct()
    )
    named = pages.withColumn("_file", F.substring_index("path", "/", -1))
    return named.join(listed, "_file", "left_anti").drop("_file")


def read_recipe_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per recipe of ``{"recipes": [...]}`` files: (file, position, fields).
    Blank amounts become NULL."""
    rows = spark.read.schema(RECIPES).json(path, multiLine=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode("recipes").alias("position", "r")
    )
    clean = F.transform(
        "r.ingredients",
        lambda x: F.struct(
            x["ingredient_name"].alias("ingredient_name"),
            F.nullif(F.trim(x["amount"]), F.lit("")).try_cast("double").alias("amount"),
            F.nullif(F.trim(x["unit_name"]), F.lit("")).alias("unit_name"),
        ),
    )
    return rows.select(
        "file", "position", "r.name", "r.description", "r.instructions", "r.source", "r.source_url", clean.alias("ingredients")
    )


def document_uses(documents: DataFrame) -> DataFrame:
    """(file, position, line, ingredient_name, amount, unit_name), one row per use."""
    return documents.select("file", "position", F.posexplode("ingredients").alias("line", "i")).select(
        "file", "position", "line", "i.ingredient_name", "i.amount", "i.unit_name"
    )


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, mapped_id, mapped_name, mapped_at, auto) from a dictionary document."""
    rows = _documents(spark, path).select(F.explode(F.from_json("value", MAPPING)).alias("name", "m"))
    return rows.select(
        "name", F.col("m.id").alias("mapped_id"), F.col("m.name").alias("mapped_name"), "m.mapped_at",
        F.coalesce("m.auto_matched", F.lit(False)).alias("auto"),
    )


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(ord, category, specific_type, term) in file order; a type is its own first
    term."""
    kinds = _documents(spark, path).select(
        F.posexplode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("_c", "category", "_types")
    )
    types = kinds.select("_c", "category", F.posexplode("_types").alias("_t", "specific_type", "_terms"))
    terms = types.select(
        "_c", "category", "_t", "specific_type",
        F.posexplode(F.concat(F.array("specific_type"), F.coalesce("_terms", F.array().cast("array<string>")))).alias("_v", "term"),
    )
    place = F.shiftleft(F.col("_c").cast("long"), 40) + F.shiftleft(F.col("_t").cast("long"), 20) + F.col("_v")
    return terms.select(place.alias("ord"), "category", "specific_type", "term")


def read_brand_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(brand, generic); keys are lower case, as names are when they are looked up."""
    rows = _documents(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("brand", "generic"))
    return rows.select(F.lower("brand").alias("brand"), "generic")


def read_latest_snapshot(spark: SparkSession, pattern: str, schema: str, kind: str = "csv") -> DataFrame:
    """Rows of the newest file of a pattern (of equally new ones the last by name); no file
    that fits is an empty table.  Names and times come from a listing, no file is opened
    for them, and no other file is read."""
    reader = spark.read.schema(schema).format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    try:
        listed = spark.read.format("binaryFile").load(pattern).select("modificationTime", "path")
        newest = listed.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    return spark.createDataFrame([], schema) if newest is None else reader.load(newest["path"])


def read_match_cache(spark: SparkSession, path: str) -> DataFrame:
    """Earlier matches; no confidence counts as 0."""
    return spark.read.schema(MATCH_CACHE).csv(path, header=True).withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0))
    )


def read_matrix(spark: SparkSession, path: str, key: str = "recipe_id") -> DataFrame:
    """(key, column, w) of the filled cells of a wide Parquet matrix."""
    wide = spark.read.parquet(path)
    columns = [c for c in wide.columns if c != key]
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    return wide.select(key, *values).unpivot([key], columns, "column", "w").where("w <> 0")


def _status_rows(logs: DataFrame) -> DataFrame:
    review = F.transform(F.coalesce("s.needs_review", F.array().cast(REVIEW)), lambda x: x["recipe_name"])
    lists = [
        F.struct(F.lit(status).alias("status"), names.alias("names"))
        for status, names in (
            ("accepted", F.col("s.accepted")), ("rejected", F.col("s.rejected")),
            ("auto_ingested", F.col("s.auto_ingested")), ("needs_review", review),
        )
    ]
    rows = logs.select("source", F.explode(F.array(*lists)).alias("e"))
    return rows.select("source", F.explode("e.names").alias("recipe_name"), "e.status")


def read_status_log(spark: SparkSession, path: str) -> DataFrame:
    """(source, recipe_name, status) from a log keyed by source."""
    return _status_rows(
        _documents(spark, path).select(F.explode(F.from_json("value", f"map<string,{STATUS}>")).alias("source", "s"))
    )


def read_any_status_log(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The same from either shape: a flat log belongs to ``source``."""
    text = _documents(spark, path)
    flat = text.select(F.lit(source).alias("source"), F.from_json("value", STATUS).alias("s"))
    is_flat = F.expr("s.accepted is not null or s.rejected is not null or s.auto_ingested is not null or s.needs_review is not null")
    keyed = F.from_json("value", f"map<string,{STATUS}>")
    keyed_rows = (
        text.withColumn("s", F.from_json("value", STATUS)).where(~is_flat)
        .select(F.explode(keyed).alias("source", "s"))
    )
    return _status_rows(flat.where(is_flat)).unionByName(_status_rows(keyed_rows))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(name, status) from a progress file: processed and skipped names."""
    fields = _documents(spark, path).select(F.from_json("value", PROGRESS).alias("p"))
    lists = F.array(
        F.struct(F.lit("processed").alias("status"), F.col("p.processed").alias("names")),
        F.struct(F.lit("skipped").alias("status"), F.col("p.skipped").alias("names")),
    )
    return fields.select(F.explode(lists).alias("e")).select(F.explode("e.names").alias("name"), "e.status")


def read_recipe_classes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, class, recipe_name) in file order; a missing or broken file has no rows."""
    rows = _documents(spark, path).select(
        F.posexplode(F.from_json("value", "map<string,array<string>>", {"mode": "PERMISSIVE"})).alias("ord", "class", "_names")
    )
    return rows.select("ord", "class", F.explode("_names").alias("recipe_name"))


def read_new_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, parent_name) from ``{"ingredients": [...]}``."""
    rows = _documents(spark, path).select(
        F.explode(F.from_json("value", "ingredients array<struct<name:string,parent_name:string>>")["ingredients"]).alias("n")
    )
    return rows.select("n.name", "n.parent_name")
