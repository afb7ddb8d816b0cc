"""Joins that no frequent key slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key may hold this many rows before it is looked at apart.
FEW = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int, parts: int) -> DataFrame:
    """Inner join of ``left``, of ``rows`` rows, with ``right``, which has each ``key`` once
    and in ``held`` its number of rows in ``left`` (dropped).

    A key that alone holds over a quarter of an even share of ``parts`` partitions is joined
    by broadcast, the others by a shuffle. There are at most ``4 * parts`` such keys, so what
    is broadcast has a proven bound if the rows of ``right`` have one. ``left`` is read twice
    and should be a written table or a checkpoint."""
    most = max(rows // (4 * parts), FEW)
    if rows <= most:
        return left.join(right.drop("held"), key)
    heavy = right.filter(F.col("held") > most).drop("held")
    light = right.filter(F.col("held") <= most).drop("held")
    apart = left.join(F.broadcast(heavy), key)
    return left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key).unionByName(apart)
