"""Chat formatting with cumulative snapshots collapsed, in DataFrame functions only.

Logs often hold a conversation several times, each copy with a few more turns. Rolling
hashes of the turns up to each place identify every prefix of every conversation; a
conversation whose whole hash is a proper prefix of another is left out by an anti-join,
and of equal ones the smallest id stays. What is left is rendered.

Both sides of the anti-join are distinct prefixes, aggregated before they are shuffled,
so a first turn or a whole conversation that a third of the log shares is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN = "<|{}|>\n{}\n<|end|>\n"


def _rendered(role: Column, text: Column) -> Column:
    before, between, after = TURN.split("{}")
    return F.concat(F.lit(before), role, F.lit(between), text, F.lit(after))


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its place, the conversation's number of turns and the rolling hash
    of the turns up to it: two sums of 64-bit hashes of (place, role, text)."""
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(ordered)).withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.xxhash64("place", "role", "text").cast("decimal(28,0)")
    two = F.xxhash64("text", F.lit(1), "role", "place").cast("decimal(28,0)")
    return placed.withColumn("h1", F.sum(one).over(upto)).withColumn("h2", F.sum(two).over(upto))


def collapse(turns: DataFrame, **names: str) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, copies (conversations
    with the same turns) and rendered.

    Turns are ordered by (turn, role, text), nulls first; a null role or text is empty;
    a repeated row is a further turn; rows without a conversation id belong to none and
    are left out; other columns are not looked at."""
    rows = prefixes(turns, **names)
    key = ["n", "h1", "h2"]
    proper = rows.filter("place < n_turns").select(F.col("place").cast("long").alias("n"), "h1", "h2").distinct()
    whole = rows.filter("place = n_turns").groupBy(F.col("n_turns").alias("n"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    kept = whole.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")
    turns_kept = rows.select("conv_id", "place", _rendered(F.col("role"), F.col("text")).alias("part")).join(kept, "conv_id")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "")
    return turns_kept.groupBy("conv_id", "n_turns", "copies").agg(ordered.alias("rendered"))


def oracle() -> str:
    """DuckDB SQL for ``collapse``: prefixes are compared as text, not by hash."""
    before, between, after = (x.replace("\n", "' || chr(10) || '") for x in TURN.split("{}"))
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    ), p AS (
      SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        string_agg('{before}' || role || '{between}' || text || '{after}', '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rendered
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), whole AS (
      SELECT upto, n, min(conv_id) AS conv_id, count(*) AS copies, min(rendered) AS rendered FROM p WHERE place = n GROUP BY upto, n
    )
    SELECT conv_id, n AS n_turns, copies, rendered FROM whole
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = whole.n AND p.upto = whole.upto)"""
