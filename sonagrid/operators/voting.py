"""Confirmation of detections by voting over the last windows of a series.

All three rules share one buffer: the last ``m`` windows of a chunk, where a window
without a confident species still takes a place. Everything is built-in functions over
one window specification, so a chunk's rows are shuffled and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the model's configuration.
M, K, THRESHOLD, CLIP_SEC, STRIDE_SEC, NOISE = 3, 2, 0.6, 5.0, 2.5, "_noise"
TOUCH_SEC = 1e-6


def classify(species: Column, prob: Column, threshold: float = THRESHOLD, noise: str = NOISE) -> Column:
    """'uncertain' for noise or a probability under the threshold, else 'detected'."""
    return F.when((species == noise) | (prob < threshold) | species.isNull(), "uncertain").otherwise("detected")


def window_starts(duration_sec: Column, clip: float = CLIP_SEC, stride: float = STRIDE_SEC, tail: bool = True, least_rest: float = 0.0) -> Column:
    """Starts of the windows of a series; a last one ends with the series if the regular
    ones leave a rest and more than ``least_rest`` seconds follow the last regular start
    (half a stride by the rule of the offline tool)."""
    last = F.floor((duration_sec - clip) / stride)
    regular = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int")), lambda i: i * F.lit(stride))
    rest = duration_sec - clip - last * stride
    with_tail = F.when((duration_sec > clip) & (rest > 0) & (rest + clip > least_rest), F.concat(regular, F.array(duration_sec - clip))).otherwise(regular)
    return with_tail if tail else regular


def _buffered(windows: DataFrame, m: int) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy("idx").rowsBetween(-(m - 1), 0)
    rows = F.collect_list(F.struct("idx", "start_sec", "end_sec", "species", "prob")).over(w)
    return windows.withColumn("buf", rows)


def _winner(windows: DataFrame, m: int, k: int, tie: str) -> DataFrame:
    """Windows with a winner of at least ``k`` votes. ``tie``: 'greatest' takes the
    greatest name, 'first' the one that is first in the buffer."""
    rows = _buffered(windows, m)
    valid = F.filter("buf", lambda b: b["species"].isNotNull())
    votes = lambda b: F.size(F.filter(valid, lambda c: c["species"] == b["species"])).alias("n")
    if tie == "greatest":
        best = F.array_max(F.transform(valid, lambda b: F.struct(votes(b), b["species"].alias("species"))))
        rows = rows.withColumn("vote", best)
    else:
        best = F.array_max(F.transform(valid, lambda b: F.struct(votes(b), (-b["idx"]).alias("early"), b["species"].alias("species"))))
        rows = rows.withColumn("vote", F.struct(best["n"].alias("n"), best["species"].alias("species")))
    return rows.filter(F.col("vote.n") >= k)


def vote_spans(windows: DataFrame, m: int = M, k: int = K) -> DataFrame:
    """Confirmed spans: chunk_id, species, start_sec, end_sec, confidence (largest),
    mean_confidence, votes, windows_evaluated, window_indices.

    Ties go to the greatest name. Winning windows of a species merge while they touch;
    the mean of a merged span is taken pairwise in order, (old + new) / 2."""
    rows = _winner(windows, m, k, "greatest")
    mine = F.filter("buf", lambda b: b["species"] == F.col("vote.species"))
    pick = lambda f: F.transform(mine, lambda b: b[f])
    hits = rows.select(
        "chunk_id", "idx", F.col("vote.species").alias("species"), F.col("vote.n").alias("votes"), F.size("buf").alias("windows_evaluated"),
        F.array_min(pick("start_sec")).alias("s"), F.array_max(pick("end_sec")).alias("e"), F.array_max(pick("prob")).alias("top"),
        (F.aggregate(pick("prob"), F.lit(0.0), lambda a, x: a + x) / F.size(mine)).alias("mean"), pick("idx").alias("indices"),
    )
    order = Window.partitionBy("chunk_id", "species").orderBy("idx")
    hits = hits.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach") + TOUCH_SEC, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    means = F.sort_array(F.collect_list(F.struct("idx", "mean")))
    folded = F.aggregate(F.slice(means, 2, 1 << 30), means[0]["mean"], lambda z, q: (z + q["mean"]) / 2)
    return hits.groupBy("chunk_id", "species", "island").agg(
        F.min("s").alias("start_sec"), F.max("e").alias("end_sec"), F.max("top").alias("confidence"), folded.alias("mean_confidence"),
        F.max("votes").alias("votes"), F.max("windows_evaluated").alias("windows_evaluated"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("indices")))).alias("window_indices"),
    )


def vote_changes(windows: DataFrame, m: int = M, k: int = K) -> DataFrame:
    """A row whenever the winner differs from the last confirmed one; ties go to the
    species that is first in the buffer."""
    rows = _winner(windows, m, k, "first")
    order = Window.partitionBy("chunk_id").orderBy("idx")
    rows = rows.withColumn("before", F.lag("vote.species").over(order))
    return rows.filter(F.col("before").isNull() | (F.col("before") != F.col("vote.species"))).select("chunk_id", "idx", F.col("vote.species").alias("species"), F.col("vote.n").alias("votes"), F.size("buf").alias("windows_evaluated"), F.round("start_sec", 2).alias("time_sec"))


def vote_change_spans(windows: DataFrame, m: int = M, k: int = K) -> DataFrame:
    """``vote_changes`` as spans over all detected windows of the species in the chunk."""
    changes = vote_changes(windows, m, k)
    spans = windows.filter(F.col("species").isNotNull()).groupBy("chunk_id", "species").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("prob").alias("confidence"), F.avg("prob").alias("mean_confidence"), F.count("*").alias("n_windows"))
    return changes.join(spans, ["chunk_id", "species"])


def vote_mobile(windows: DataFrame, m: int = M, k: int = K) -> DataFrame:
    """A row when the winner changes or at least ``k`` windows after the last row; the
    confidence is the mean of the winner's windows in the buffer."""
    rows = _winner(windows, m, k, "first")
    order = Window.partitionBy("chunk_id").orderBy("idx")
    mine = F.filter("buf", lambda b: b["species"] == F.col("vote.species"))
    rows = rows.select("chunk_id", "idx", F.col("vote.species").alias("species"), F.col("vote.n").alias("votes"), (F.aggregate(F.transform(mine, lambda b: b["prob"]), F.lit(0.0), lambda a, x: a + x) / F.size(mine)).alias("avg_confidence"))
    changed = F.coalesce((F.lag("species").over(order) != F.col("species")).cast("int"), F.lit(1))
    rows = rows.withColumn("run", F.sum(changed).over(order))
    runs = rows.groupBy("chunk_id", "run", "species").agg(F.sort_array(F.collect_list(F.struct("idx", "votes", "avg_confidence"))).alias("list"))
    empty = F.slice("list", 1, 0)
    kept = F.aggregate("list", empty, lambda a, x: F.when((F.size(a) == 0) | (x["idx"] - F.try_element_at(a, F.lit(-1))["idx"] >= k), F.concat(a, F.array(x))).otherwise(a))
    return runs.select("chunk_id", "species", F.explode(kept).alias("x")).select("chunk_id", "species", "x.*")


def to_absolute(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans with times of day: the start of their chunk plus their offset."""
    rows = spans.join(chunks.select("chunk_id", "started_at"), "chunk_id")
    shift = lambda c: F.col("started_at") + F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)"))
    return rows.withColumn("window_start_ts", shift("start_sec")).withColumn("window_end_ts", shift("end_sec"))


def support_ratio(votes: Column, evaluated: Column) -> Column:
    return F.try_divide(votes, evaluated)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(logits, lambda v: F.exp(v - top) / total)


def mean_views(*views: Column) -> Column:
    """Element-wise mean of equally long arrays."""
    zipped = F.arrays_zip(*[v.alias(f"v{k}") for k, v in enumerate(views)])
    return F.transform(zipped, lambda z: sum((z[f"v{k}"] for k in range(1, len(views))), z["v0"]) / len(views))


def top_classes(probabilities: Column, k: int) -> Column:
    """The ``k`` most probable classes as (class_idx, prob); ties: smaller index first."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("neg"), i.alias("class_idx")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda x: F.struct(x["class_idx"].alias("class_idx"), (-x["neg"]).alias("prob")))
