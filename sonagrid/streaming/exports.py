"""Export of waiting rows in batches of a fixed size, as they come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sonagrid.operators import scan


def auto_batch(folder: str, size: int, order: tuple[str, ...] = ("id",)) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``. As soon as ``size`` rows wait, the first of them by
    ``order`` are an export; what is left waits for the next micro-batch.

    ``folder``/export has the exported rows with export (number, from 0) and place (in it, from
    1), under the number of the micro-batch; ``folder``/waiting and ``folder``/done have what
    each micro-batch left behind. A micro-batch that comes again reads what the one before it
    left, and takes the place of what it wrote itself, so that every row is exported once. Exports
    depend on the order of the rows, not on the micro-batches that they come in, if the rows of
    one come after those of the ones before."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [k for k in _numbers(spark, f"{folder}/done") if k < number]
        rows, done = batch, 0
        if earlier:
            rows = spark.read.schema(batch.schema).parquet(f"{folder}/waiting/batch={max(earlier)}").unionByName(batch)
            done = spark.read.parquet(f"{folder}/done/batch={max(earlier)}").first().done
        rows = rows.persist()
        full = rows.count() // size
        ranked = scan.running(rows, [], list(order), {"rank": ("count", F.lit(1))})
        group = F.floor(F.col("rank") / size).cast("long")
        out = ranked.withColumn("export", group + done).withColumn("place", F.col("rank") % size + 1)
        out.filter(group < full).drop("rank").write.mode("overwrite").parquet(f"{folder}/export/batch={number}")
        ranked.filter(group >= full).drop("rank").write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
        # last: only a micro-batch that has written all is one that the next ones go on from
        spark.range(1).select(F.lit(done + full).cast("long").alias("done")).write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
        rows.unpersist()

    return sink


def _numbers(spark, folder: str) -> list[int]:
    """Micro-batches that were written to the end."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in files.listStatus(path)]
    return [int(n.split("=")[1]) for n, p in names if n.startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
