"""Cutting lineage and numbering rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(context) -> str:
    """The checkpoint folder of the session.  A cluster names it in
    spark.checkpoint.dir; only a local session gets one of its own."""
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="blendspark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that loops keep short plans and a lost
    executor costs a re-read, not a re-run."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Written, dealt and sorted by the keys: a join on them leaves these rows where they are.

    Spark forgets how rows were dealt when an adaptive plan is checkpointed, so that only the
    rows themselves are made by one, and the plan that deals them is a fixed one."""
    conf = rows.sparkSession.conf
    made, adaptive = cut(rows), conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(made.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def spread(rows: DataFrame) -> DataFrame:
    """A scanned table that comes in fewer pieces than there are cores, dealt out evenly for
    dear steps per row; one of enough pieces stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dense_index(rows: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order without a one-task window.

    Rows are range-partitioned and numbered inside their partition; the window
    that turns the partition sizes into offsets sees one row per partition.
    """
    numbered = cut(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mark", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mark", 33))
        .withColumn("_row", F.expr("_mark & 8589934591L"))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        numbered.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_mark", "_part", "_row", "_offset")
    )


def prefix_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows before each one.  ``order`` has no ties.

    Range partitions are summed on their own; one row per partition is carried on.
    """
    placed = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum(value).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_offset", "_inside")
    )


def quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """Exact quantile with linear interpolation, by a distributed sort."""
    values = dense_index(rows.select(F.col(column).alias("_v")).where("_v is not null"), "_v")
    n = values.count()
    if n == 0:
        return None
    place = q * (n - 1)
    low = int(place)
    picked = {r["idx"]: r["_v"] for r in values.where(F.col("idx").isin(low, min(low + 1, n - 1))).collect()}
    first, second = picked[low], picked[min(low + 1, n - 1)]
    return first + (second - first) * (place - low)
