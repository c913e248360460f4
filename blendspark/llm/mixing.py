"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.llm.frames import fresh, listed, ranges_for, text_of
from blendspark.operators.lineage import cut, dense_index, prefix_sum

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources, in turn, and how often a document may be taken.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Chances of documents labelled good, labelled poor, and not labelled.
GOOD, POOR, UNKNOWN = 1.0, 0.25, 0.5
SEED = "mix-1"


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, quality_weight: one row per labelled document (of several labels the best)."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).select(
        "doc_id", F.when(F.col("q").isNull(), UNKNOWN).when(F.col("q") > 0, GOOD).otherwise(POOR).alias("quality_weight")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size (one row per source).  Adds source_no (by code point,
    null last) and target.

    The sources share the total by weight; a target stops at ``most`` times its size
    and the excess is shared again.  That is the level at which
    sum(min(most * size, level * weight)) is the total; it is read off the sources
    sorted by the level at which each one stops, with running sums.  Any number of
    sources: nothing but one number reaches the driver.
    """
    placed = dense_index(sizes.withColumn("_null", F.col("source").isNull()), "_null", "source", name="source_no").drop("_null")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = placed.withColumn("weight", weight).withColumn("stop", most * F.col("source_size") / F.col("weight"))
    ordered = dense_index(rows.select("source_no", "weight", "source_size", "stop"), "stop", "source_no", name="at")
    sums = prefix_sum(ordered, "at", "weight", "weight_before")
    sums = prefix_sum(sums, "at", "source_size", "size_before")
    whole = rows.agg(F.sum("weight").alias("all_weight"), F.sum("source_size").alias("all_size"))
    level = F.col("all_size") - most * F.col("size_before")
    level = level / (F.col("all_weight") - F.col("weight_before"))
    # The sources before the first that the level does not stop are all stopped.
    found = sums.join(F.broadcast(whole)).withColumn("level", level).where("level <= stop").agg(F.min_by("level", "at")).first()[0]
    share = F.least(F.lit(found).cast("double") * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return rows.withColumn("target", F.coalesce(share, F.lit(0.0))).select("source", "source_no", "source_size", "target")


def chance_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential variate divided by the weight: the smallest keys are a weighted
    sample without replacement.  Drawn by a hash, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def plan(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """How often each row of docs (doc_id, text, source, anything else) is taken.

    weights: doc_id, quality_weight (one row per doc_id; others: UNKNOWN).  Returns
    row_id (a number of the row), doc_id, size, source, source_size, target, copies.

    Every row of a source has the whole epochs that fit its target.  The rest of the
    target goes by the sorted keys: a row is taken once more if the middle of its
    words lies inside what is left, so that the sum ends within half a document of
    the target.  Rows are dealt to ranges of (source, key) and summed per range, so a
    source may hold any share of all rows.  Null text has size 0 (such rows are taken
    with their epochs); rows that repeat a doc_id are rows of their own.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
    )
    if weights is not None:
        rows = rows.join(weights, "doc_id", "left")
    else:
        rows = rows.withColumn("quality_weight", F.lit(None).cast("double"))
    keyed = cut(rows.withColumn("key", chance_key(F.col("doc_id"), F.coalesce("quality_weight", F.lit(UNKNOWN)))).drop("quality_weight"))
    goals = cut(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"))))
    known = goals.withColumnRenamed("source", "_source")
    placed = keyed.join(known, keyed["source"].eqNullSafe(known["_source"])).drop("_source")
    ranged = cut(
        placed.repartitionByRange(ranges_for(docs), "source_no", "key", "doc_id", "row_id").withColumn("part", F.spark_partition_id())
    )
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each source and range that meet.
    offsets = ranged.groupBy("source_no", "part").agg(F.sum("size").alias("sum")).select(
        "source_no", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source_no", "part").orderBy("key", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["source_no", "part"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    left = F.col("target") - epochs * F.col("source_size")
    once_more = (F.col("size") > 0) & (F.col("offset") + F.col("inside") + F.col("size") / 2 <= left)
    return summed.select(
        "row_id", "doc_id", "size", "source", "source_size", "target",
        (epochs + F.when(once_more, 1).otherwise(0)).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows of docs, each as often as the plan takes it; columns stay.  docs must
    read in the same order each time (files do)."""
    row = fresh(docs, "_row")
    taken = listed(plan(docs, weights).where("copies > 0").select(F.col("row_id").alias("_taken"), "copies"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    times = fresh(numbered, "_times")
    joined = numbered.join(taken.withColumnRenamed("copies", times), numbered[row] == F.col("_taken"))
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[joined[c] for c in docs.columns])
