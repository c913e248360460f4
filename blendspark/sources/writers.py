"""Writing matches, recipes, distances, edges, mappings and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendspark.operators.lineage import dense_index


def write_match_cache(matches: DataFrame, path: str, name: str = "name") -> None:
    """Matches with a category as CSV, by name; NULL is an empty field."""
    fields = ("brand", "specific_type", "category")
    rows = matches.where(F.col("category").isNotNull()).select(
        F.col(name).alias("name"), *(F.coalesce(f, F.lit("")).alias(f) for f in fields), "confidence", "source"
    )
    rows.orderBy("name").write.mode("overwrite").csv(path, header=True, emptyValue="")


def recipe_batches(recipes: DataFrame, size: int = 100, order: str = "path") -> DataFrame:
    """Recipes with ``batch`` 1, 2, ... of ``size`` each per source, in path order.
    The numbering is one distributed sort over all sources."""
    numbered = dense_index(recipes, "source", order, name="_n")
    firsts = numbered.groupBy("source").agg(F.min("_n").alias("_first"))
    batch = F.floor((F.col("_n") - F.col("_first")) / size) + 1
    return numbered.join(firsts, "source").withColumn("batch", batch.cast("long")).drop("_n", "_first")


def write_recipe_batches(recipes: DataFrame, path: str, size: int = 100, order: str = "path") -> None:
    """JSON lines in a folder per source, with ``batch`` in each line.  A file holds many
    whole batches, in order, so their number is that of the partitions, not of the batches."""
    batched = recipe_batches(recipes, size, order)
    ordered = batched.repartitionByRange("source", "batch").sortWithinPartitions("source", "batch", order)
    ordered.write.mode("overwrite").partitionBy("source").json(path)


def write_recipes(recipes: DataFrame, path: str) -> None:
    """Recipe documents, one JSON object per line."""
    recipes.write.mode("overwrite").json(path)


def write_distance_table(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").csv(path, header=True)


def wide_distances(pairs: DataFrame, ids: list) -> DataFrame:
    """The square table of a few named items; missing pairs are NULL."""
    from blendspark.operators.bags import both_ways

    rows = both_ways(pairs.select("id1", "id2", "d")).where(F.col("id1").isin(*ids) & F.col("id2").isin(*ids))
    return rows.groupBy("id1").pivot("id2", ids).agg(F.first("d"))


def write_edge_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and labelled edges as two CSV tables; lists are joined by ``|``."""
    def flat(df: DataFrame) -> DataFrame:
        return df.select(
            *(F.concat_ws("|", F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes)
        )

    flat(nodes).write.mode("overwrite").csv(f"{path}/nodes", header=True)
    flat(edges).write.mode("overwrite").csv(f"{path}/edges", header=True)


def write_new_names(names: DataFrame, path: str) -> None:
    """Distinct names as {name, parent_name} lines."""
    names.select("name").distinct().withColumn("parent_name", F.lit("")).write.mode("overwrite").json(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Mapping rows as JSON lines: a table of any size, not one dictionary."""
    mapping.write.mode("overwrite").json(path)


def write_status_log(status: DataFrame, path: str) -> None:
    """Status rows by source; the partitions of other sources stay as they are."""
    status.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
