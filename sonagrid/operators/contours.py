"""Contours of a density as closed rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sonagrid.sources.shared import shared_folder

LEVELS = (0.2, 0.4, 0.6, 0.8)
_NODE = ["share", "node"]


def _padded(density: DataFrame) -> DataFrame:
    """The grid with a frame of nodes of density 0 round it, one step out, so that no contour
    ends at its border."""
    ends = density.agg(*[f(c).alias(f"{c}_{name}") for c in ("gx", "gy", "x", "y") for name, f in (("lo", F.min), ("hi", F.max))])
    step = lambda c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / (F.col(f"g{c}_hi") - F.col(f"g{c}_lo"))
    at = lambda c: F.col(f"{c}_lo") + (F.col(f"g{c}") - F.col(f"g{c}_lo")) * step(c)
    whole = ends.withColumn("gx", F.explode(F.sequence(F.col("gx_lo") - 1, F.col("gx_hi") + 1))).withColumn("gy", F.explode(F.sequence(F.col("gy_lo") - 1, F.col("gy_hi") + 1)))
    frame = whole.filter("gx < gx_lo or gx > gx_hi or gy < gy_lo or gy > gy_hi").select("gx", "gy", at("x").alias("x"), at("y").alias("y"), F.lit(0.0).alias("density"))
    return density.select("gx", "gy", "x", "y", "density").unionByName(frame)


def segments(density: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """share, node, next, x, y: where the density crosses shares of its maximum, by marching
    squares. A node is the crossed edge of the grid (its lower end, and 0 along x or 1 along
    y), with the point on it; next is the edge that the contour comes to after it, with the
    denser side on the left. Each crossed edge is the start of one segment and the end of one.
    """
    top = density.agg(F.max("density").alias("top"))
    rows = _padded(density)
    corner = lambda dx, dy, n: rows.select((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("density").alias(f"d{n}"))
    squares = corner(0, 0, "a").join(corner(1, 0, "b"), ["gx", "gy"]).join(corner(1, 1, "c"), ["gx", "gy"]).join(corner(0, 1, "d"), ["gx", "gy"])
    squares = squares.crossJoin(F.broadcast(top)).filter("top > 0").withColumn("share", F.explode(F.array(*map(F.lit, levels)))).withColumn("level", F.col("share") * F.col("top"))  # top: one row
    over = lambda p: F.col(f"d{p}") > F.col("level")

    def crossing(p: str, q: str, dx: int, dy: int, along: int) -> Column:
        """The edge from corner p to q, walked with the square on the left."""
        t = (F.col("level") - F.col(f"d{p}")) / (F.col(f"d{q}") - F.col(f"d{p}"))
        point = F.struct(F.struct((F.col("gx") + dx).alias("i"), (F.col("gy") + dy).alias("j"), F.lit(along).alias("along")).alias("node"), over(p).alias("out"), (F.col(f"x{p}") + t * (F.col(f"x{q}") - F.col(f"x{p}"))).alias("x"), (F.col(f"y{p}") + t * (F.col(f"y{q}") - F.col(f"y{p}"))).alias("y"))
        return F.when(over(p) != over(q), point)

    edges = F.array(crossing("a", "b", 0, 0, 0), crossing("b", "c", 1, 0, 1), crossing("c", "d", 0, 1, 0), crossing("d", "a", 0, 0, 1))
    found = squares.select("share", F.filter(edges, lambda e: e.isNotNull()).alias("e")).filter(F.size("e") > 0)
    # round a square, crossings out of the dense part and into it take turns; a contour comes in
    # where the walk leaves the dense part, and goes out at the crossing before
    turn = F.filter(F.transform("e", lambda e, k: F.struct(e.alias("start"), F.element_at("e", F.when(k == 0, F.size("e")).otherwise(k)).alias("end"))), lambda s: s["start"]["out"])
    return found.select("share", F.explode(turn).alias("s")).select("share", F.col("s.start.node").alias("node"), F.col("s.end.node").alias("next"), F.col("s.start.x").alias("x"), F.col("s.start.y").alias("y"))


def rings(density: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """share, ring, points (array of x, y; the last is the first), area (of a ring round a
    denser part; negative round a hole), layer: every closed contour as ``density``, and the
    largest ring of the highest level once more as ``boundary``. A flat density of 0 has none.

    The segments are chained by doubling: after k rounds a node knows the smallest node among
    the next 2**k of its ring, how far off it is, and the node after those. A ring is named
    after its smallest node, and starts there."""
    shared_folder(density.sparkSession)
    state = segments(density, levels).withColumn("low", F.col("node")).withColumn("off", F.lit(0).cast("long")).checkpoint()
    reach = 1
    while True:
        ahead = state.select("share", F.col("node").alias("next"), F.col("low").alias("low2"), F.col("off").alias("off2"), F.col("next").alias("next2"))
        nearer = F.col("low2") < F.col("low")
        after = state.join(ahead, ["share", "next"]).select(*_NODE, "x", "y", F.col("next2").alias("next"), F.when(nearer, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(nearer, F.col("off2") + reach).otherwise(F.col("off")).alias("off"), nearer.alias("moved")).checkpoint()
        state, reach = after.drop("moved"), 2 * reach
        if after.filter("moved").isEmpty():
            break
    walked = F.array_sort(F.collect_list(F.struct((-F.col("off")).alias("at"), "x", "y")))
    rows = state.groupBy("share", F.col("low").alias("ring")).agg(walked.alias("w"))
    # the smallest node, whose distance is 0, is the last in this order
    points = F.concat(F.slice("w", F.size("w"), F.lit(1)), F.slice("w", F.lit(1), F.size("w")))
    rows = rows.select("share", "ring", F.transform(points, lambda p: F.struct(p["x"], p["y"])).alias("points"))
    doubled = F.aggregate(F.sequence(F.lit(1), F.size("points") - 1), F.lit(0.0), lambda s, k: s + F.element_at("points", k)["x"] * F.element_at("points", k + 1)["y"] - F.element_at("points", k + 1)["x"] * F.element_at("points", k)["y"])
    rows = rows.withColumn("area", doubled / 2).checkpoint()
    best = rows.filter(F.col("share") == max(levels)).orderBy(F.desc("area"), "ring").limit(1)
    return rows.withColumn("layer", F.lit("density")).unionByName(best.withColumn("layer", F.lit("boundary")))
