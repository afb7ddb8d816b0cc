"""Running aggregates by key, where no key has to fit one task.

A key of few rows is a window. Rows of a key with more than ``HEAVY_ROWS`` are dealt by ranges
of (key, order) instead; each partition's own aggregate is carried on to the partitions that
the key goes on in, and applied to the running aggregate inside. What is carried is at most one
row for each partition, as a key can go on into a partition only at its beginning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sonagrid.sources.shared import shared_folder

#: Rows of one key that a task sorts without trouble.
HEAVY_ROWS = 1_000_000

#: How an aggregate is made, and how aggregates of parts are put together.
_KINDS = {"max": (F.max, F.max, F.greatest), "min": (F.min, F.min, F.least), "sum": (F.sum, F.sum, None), "count": (F.count, F.sum, None)}


def heavy_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys (one row without columns' names if there are no keys) with more than
    ``HEAVY_ROWS`` rows; None if there are none."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HEAVY_ROWS).drop("_rows")
    return None if found.isEmpty() else found


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], heavy: DataFrame | None | str = "look") -> DataFrame:
    """``rows`` with, for each name in ``values``, an aggregate (max, min, sum or count) of a
    column over the rows of the same ``keys`` that come before by ``order``, without the row
    itself: null, or 0 for a sum or count, where there is none. ``order`` has to name each
    row of a key; without keys all rows are one run. ``heavy`` is what ``heavy_keys`` found,
    if it is known."""
    found = heavy_keys(rows, keys) if isinstance(heavy, str) else heavy
    if found is None:
        return _plain(rows, keys, order, values)
    if not keys:
        return _segmented(rows, keys, order, values)
    same = lambda how: rows.join(found.toDF(*[f"_k_{k}" for k in keys]), _equal(keys), how)
    return _plain(same("left_anti"), keys, order, values).unionByName(_segmented(same("left_semi"), keys, order, values))


def _equal(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def _plain(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = {name: _KINDS[kind][0](value).over(before) for name, (kind, value) in values.items()}
    return rows.withColumns({name: F.coalesce(x, F.lit(0)) if values[name][0] in ("sum", "count") else x for name, x in made.items()})


def _segmented(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    spark = rows.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a row stays in its partition whatever is lost later
    dealt = rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    own = dealt.groupBy(*keys, "_part").agg(*[_KINDS[kind][0](value).alias(f"_c_{name}") for name, (kind, value) in values.items()])
    ahead = Window.partitionBy(*keys).orderBy("_part")  # a row for each partition that a key is in
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.lag("_part").over(ahead).alias("_was"), *[_KINDS[kind][1](f"_c_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()])
    carried = carried.filter("_was is not null").drop("_was")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # at most a row for each partition
    placed = dealt.repartitionByRange(parts, "_part").join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & _equal(keys), "left")
    for name, (kind, value) in values.items():
        here, earlier = _KINDS[kind][0](value).over(inside), F.col(f"_c_{name}")
        placed = placed.withColumn(name, F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)) if kind in ("sum", "count") else _KINDS[kind][2](here, earlier))
    return placed.select(*rows.columns, *values)
