"""Merkle manifest of a dataset: each level spreads the children of a parent into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.llm.frames import listed
from blendspark.operators.lineage import cut, dense_index

FANOUT = 8
STEP = "struct<left: string, right: string>"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def small_letters(text: Column) -> Column:
    """A-Z as a-z, all else as it is.  Where every character is one byte, the plain
    function does just that, and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, A_TO_Z, A_TO_Z.lower()))


def _placed(leaves: DataFrame, ranges: int) -> tuple[DataFrame, int, int]:
    """leaves with tree (number of the group), idx (place in it) and n (its size); the
    largest n and the number of groups.

    Rows are sorted in ranges over all groups, so a group of any size is many tasks.  The
    tables joined to them have a row per range and group.
    """
    order = ["part", "key", "leaf", "row"]
    sorted_rows = cut(
        leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumn("mark", F.monotonically_increasing_id())
        .withColumns({"range": F.shiftright("mark", 33), "at": F.expr("mark & 8589934591L")})
    )
    pieces = cut(sorted_rows.groupBy("range", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first")))
    trees = dense_index(pieces.groupBy("part").agg(F.sum("rows").alias("n")), "part", name="tree")
    before = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.withColumn("shift", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
    shifts = shifts.alias("s").join(trees.alias("t"), F.col("s.part").eqNullSafe(F.col("t.part"))).select("range", "s.part", "shift", "tree", "n")
    placed = sorted_rows.alias("r").join(
        listed(shifts).alias("s"), (F.col("r.range") == F.col("s.range")) & F.col("r.part").eqNullSafe(F.col("s.part"))
    )
    most = shifts.agg(F.max("n").alias("n"), (F.max("tree") + 1).alias("trees")).first()
    return placed.withColumn("idx", F.col("at") + F.col("shift")), most.n or 0, most.trees or 0


def _levels(n: int) -> int:
    levels = 1
    while n > FANOUT**levels:
        levels += 1
    return levels


def spread(nodes: DataFrame) -> DataFrame:
    """One level up: nodes (tree, idx, n, child: struct with hash, more) to parents (tree,
    idx, n, c0 ... c7, hash).  n is the number of nodes of the tree on the level of the
    children; a lone one passes as it is."""
    slots = [F.max(F.when(F.col("idx") % FANOUT == k, F.col("child"))).alias(f"c{k}") for k in range(FANOUT)]
    wide = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx"), "n").agg(*slots)
    joined = F.concat_ws("", *[f"c{k}.hash" for k in range(FANOUT)])
    return wide.withColumn("hash", F.when(F.col("n") == 1, F.col("c0.hash")).otherwise(F.sha2(joined, 256)))


def _climb(nodes: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels from the leaves up, and the last node of each tree."""
    levels = []
    for _ in range(_levels(n)):
        levels.append(cut(spread(nodes)))
        nodes = levels[-1].select("tree", "idx", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.struct("hash").alias("child"))
    return levels, nodes


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """above (tree, idx, path, more): what is known of the nodes on top.  Returns the
    same of the leaves: child, and path from them up, the steps of this tree first."""
    for wide in reversed(levels):
        known = above.select("tree", "idx", *[c for c in above.columns if c not in ("tree", "idx", "child")])
        children = F.array(*[
            F.struct(
                F.lit(k).cast("long").alias("slot"), F.col(f"c{k}").alias("child"),
                F.struct(
                    F.concat_ws("", *[f"c{j}.hash" for j in range(k)]).alias("left"),
                    F.concat_ws("", *[f"c{j}.hash" for j in range(k + 1, FANOUT)]).alias("right"),
                ).alias("step"),
            )
            for k in range(FANOUT)
        ])
        below = wide.join(known, ["tree", "idx"]).select(*known.columns, "n", F.explode(children).alias("c")).where("c.child is not null")
        step = F.when(F.col("n") > 1, F.array("c.step")).otherwise(F.array().cast(f"array<{STEP}>"))
        above = below.select(
            "tree", (F.col("idx") * FANOUT + F.col("c.slot")).alias("idx"), F.concat(step, F.col("path")).alias("path"),
            *[c for c in known.columns if c not in ("tree", "idx", "path")], "c.child",
        )
    return above


def manifest(docs: DataFrame, fields: Sequence[str], part: str, key: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """The tree over all rows with the proof of each one.

    docs: ``fields`` (hashed into the leaf, in this order), ``part`` (a tree for each of
    its values), ``key`` (order in a tree), anything else (ignored).  ``changed``: columns
    that take the place of fields in a second leaf, as a tampered row would have them.

    Returns one row per row of docs: key, leaf, changed_leaf, subroot, root, path (array of
    left and right siblings, joined, from the leaf up).  Null fields have their own mark; a
    null part is a tree and comes first; null keys come first; rows that share a key are
    ordered by leaf, and equal rows are leaves of their own.  Texts of any length are hashed
    where they are read and never moved.  A single row is its own root, with an empty path.
    An empty table gives no rows.

    Only hashes are shuffled.  The tree has a column per slot: a level is one aggregate by
    parent, summed before the shuffle, as children lie side by side.  Paths are handed down
    from the root by joins on the parent, so siblings of upper levels are written once for
    many leaves.
    """
    values = [docs[f] for f in fields]
    other = [(changed or {}).get(f, docs[f]) for f in fields]
    # Written once: else the sample that finds the ranges would hash all texts too.
    leaves = cut(docs.select(
        docs[part].alias("part"), docs[key].alias("key"), F.monotonically_increasing_id().alias("row"),
        leaf_hash(values).alias("leaf"), leaf_hash(other).alias("changed_leaf"),
    ))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, largest, trees = _placed(leaves, ranges)
    child = F.struct(F.col("leaf").alias("hash"), "key", "changed_leaf")
    levels, subroots = _climb(placed.select("tree", "idx", "n", child.alias("child")), largest)
    tops, root = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "child"), trees)
    start = root.select("tree", "idx", F.array().cast(f"array<{STEP}>").alias("path"), F.col("child.hash").alias("root"))
    over = _descend(tops, start).select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", "root", F.col("child.hash").alias("subroot"))
    return _descend(levels, over).select(F.col("child.key").alias(key), F.col("child.hash").alias("leaf"), "child.changed_leaf", "subroot", "root", "path")


def proof_hash(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
