"""Materialised paths such as ``/1/22/389/`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_nodes(path: Column) -> Column:
    """ARRAY<LONG> of the ids on a path, root side first; empty for no path."""
    ids = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    return F.transform(ids, lambda x: x.cast("long"))


def parent_path(path: Column) -> Column:
    """Path of the parent, NULL for a top-level node."""
    return F.nullif(F.regexp_replace(path, r"[^/]+/$", ""), F.lit("/"))


def common_depth(nodes1: Column, nodes2: Column) -> Column:
    """How many leading nodes two paths share."""
    same = F.zip_with(nodes1, nodes2, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.coalesce(
        F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long")
    ).cast("int")


def level_counts(nodes: Column, levels: Column) -> Column:
    """Running number of level-1 nodes along a path: element k counts the first k+1."""
    ones = F.transform(levels, lambda x: F.when(x == 1, 1).otherwise(0))
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(nodes), F.lit(1))),
        lambda k: F.aggregate(F.slice(ones, F.lit(1), k), F.lit(0), lambda s, x: s + x),
    )
