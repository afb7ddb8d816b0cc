"""Training-set operators: splits without leakage, class weights, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sonagrid.operators import scan


def group_split(files: DataFrame, val: float = 0.15, test: float = 0.15, seed: int | None = 42) -> DataFrame:
    """Adds ``split`` so that all files of a recording are in one part.

    Per class: one recording is for training; of two, the second is for validation; else
    max(1, round(n * share)) each for test and validation (halves to even), one each if
    they would take all. Recordings are ranked by a seeded hash, by name if seed is
    None. Only distinct recordings are ranked, not files."""
    recs = files.select("class", "recording_id").distinct()
    order = F.xxhash64(F.lit(seed), "recording_id") if seed is not None else F.lit(0)
    w = Window.partitionBy("class")
    recs = recs.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(order, "recording_id")))
    n_test = F.greatest(F.lit(1), F.bround(F.col("n") * test, 0)).cast("int")
    n_val = F.greatest(F.lit(1), F.bround(F.col("n") * val, 0)).cast("int")
    fits = n_test + n_val < F.col("n")
    nt, nv = F.when(fits, n_test).otherwise(1), F.when(fits, n_val).otherwise(1)
    split = F.when(F.col("n") == 1, "train").when(F.col("n") == 2, F.when(F.col("rank") == 1, "train").otherwise("val")).when(F.col("rank") <= nt, "test").when(F.col("rank") <= nt + nv, "val").otherwise("train")
    return files.join(recs.select("class", "recording_id", split.alias("split")), ["class", "recording_id"])


def label_index(files: DataFrame) -> DataFrame:
    """Classes in order with their indices. The window runs over distinct classes."""
    return files.select("class").distinct().select("class", (F.dense_rank().over(Window.orderBy("class")) - 1).alias("idx"))


def class_counts(files: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class its count (zero if absent) and weight 1 / max(n, 1)."""
    counts = files.groupBy("class").agg(F.count("*").alias("n"))
    return classes.select("class").distinct().join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), (1 / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("weight"))


def sampling_weights(files: DataFrame) -> DataFrame:
    counts = files.groupBy("class").agg(F.count("*").alias("n"))
    return files.join(counts, "class").withColumn("weight", 1 / F.col("n")).drop("n")


def split_stats(split: DataFrame) -> DataFrame:
    return split.groupBy("class", "split").agg(F.count("*").alias("files"), F.count_distinct("recording_id").alias("recordings"))


def leaking_recordings(split: DataFrame) -> DataFrame:
    """Recordings that are in more than one part; there should be none."""
    return split.groupBy("class", "recording_id").agg(F.count_distinct("split").alias("parts")).filter("parts > 1")


def validation_report(found: DataFrame, whitelist: DataFrame, special: tuple[str, ...] = ("_noise",)) -> DataFrame:
    """Classes by verdict: valid, invalid or special."""
    rows = found.select("class").distinct().join(whitelist.select(F.col("slug").alias("class"), F.lit(True).alias("ok")).distinct(), "class", "left")
    return rows.select("class", F.when(F.col("class").isin(*special), "special").when(F.col("ok"), "valid").otherwise("invalid").alias("verdict"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of every (true, predicted) pair of the labels that occur, zeros included."""
    labels = rows.select(F.col("y_true").alias("l")).union(rows.select("y_pred")).distinct()
    pairs = labels.select(F.col("l").alias("y_true")).crossJoin(labels.select(F.col("l").alias("y_pred")))  # classes x classes
    return pairs.join(rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n")), ["y_true", "y_pred"], "left").fillna(0, ["n"])


def class_report(rows: DataFrame) -> DataFrame:
    """Per label precision, recall, F1 (0 where undefined) and support."""
    c = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = c.select(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")).union(c.select("y_pred", F.lit(0), "n", F.lit(0)))
    g = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    g = g.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select("label", "precision", "recall", "f1", "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a class report."""
    cols = ("precision", "recall", "f1")
    macro = report.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("macro").alias("average"), *cols, "support")
    weighted = report.agg(*[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("weighted").alias("average"), *cols, "support")
    return macro.union(weighted)


def first_per_key(rows: DataFrame, key: str, order: list[Column | str], most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def page(rows: DataFrame, number: int, size: int = 6, order: tuple[str, ...] = ("ru",)) -> DataFrame:
    """Page ``number`` (from 0, taken back into range) in lower-case order, then by all
    columns. A large table is ranked by ranges, not in one task."""
    total = rows.agg(F.count("*").alias("_n"))
    by = [F.lower(c).alias(f"_o{k}") for k, c in enumerate(order)]
    names = [f"_o{k}" for k in range(len(order))]
    ranked = scan.running(rows.select("*", *by), [], [*names, *order, *[c for c in rows.columns if c not in order]], {"_r": ("count", F.lit(1))}).drop(*names).crossJoin(F.broadcast(total))  # one row
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / size) - 1)
    at = F.greatest(F.lit(0), F.least(F.lit(number), last))
    return ranked.filter((F.col("_r") >= at * size) & (F.col("_r") < (at + 1) * size)).drop("_r", "_n")
