"""Exports: rows in the shape of a file, and writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sonagrid.functions.text import csv_quoted, relative_path


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def csv_rows(rows: DataFrame) -> DataFrame:
    """Twelve text columns: confidence with four places, coordinates with six, empty for
    null. Needs species names (ru, habitat) and device names."""
    num = lambda c, places: F.coalesce(F.format_string(f"%.{places}f", F.col(c)), F.lit(""))
    located = lambda c: F.when(F.col(c).isNull(), "").otherwise(num(c, 6))
    return rows.select(
        F.col("id").cast("string").alias("id"), F.col("device_id").cast("string").alias("device_id"), F.col("name").alias("device_name"), "species_slug", "ru", "habitat", num("confidence", 4).alias("confidence"),
        _stamp("window_start_ts").alias("start"), _stamp("window_end_ts").alias("end"), located("lat").alias("lat"), located("lon").alias("lon"), F.coalesce(F.col("duplicate_of_id").cast("string"), F.lit("")).alias("duplicate_of_id"),
    )


def write_csv(rows: DataFrame, path: str, sep: str = ";") -> None:
    rows.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="", emptyValue="", escape='"')


def csv_lines(rows: DataFrame, sep: str = ",") -> DataFrame:
    """One line of text a row, with quotes doubled."""
    return rows.select(F.concat_ws(sep, *[F.coalesce(csv_quoted(F.col(c).cast("string")), F.lit("")) for c in rows.columns]).alias("line"))


def mobile_csv_rows(rows: DataFrame) -> DataFrame:
    """Twelve text columns of an export on the device: confidence with three places, times
    in milliseconds, text that may hold a comma in quotes. Needs species names (ru, habitat),
    votes_count, created_at and corrected."""
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("string")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.select(
        F.col("id").cast("string").alias("id"), "species_slug", quoted(F.col("ru")).alias("species_ru"), "habitat", F.coalesce(F.format_string("%.3f", F.col("confidence")), F.lit("")).alias("confidence"), plain("votes_count").alias("votes_count"),
        millis("window_start_ts").alias("window_start_ts"), millis("window_end_ts").alias("window_end_ts"), plain("lat").alias("lat"), plain("lon").alias("lon"), quoted(_stamp("created_at")).alias("created_at_iso"), quoted(F.col("corrected")).alias("user_corrected_species"),
    )


def geojson_rows(rows: DataFrame) -> DataFrame:
    """One feature a row; geometry is null where the place is unknown."""
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 7), F.round("lat", 7)).alias("coordinates")))
    props = F.struct("id", "device_id", "species_slug", "confidence", _stamp("window_start_ts").alias("start"))
    return rows.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def geojson_counts(rows: DataFrame) -> DataFrame:
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(located).alias("located"), F.count_if(~located).alias("unlocated"))


def write_geojson(rows: DataFrame, path: str) -> None:
    """Features as lines (GeoJSON text sequence), written in parallel."""
    geojson_rows(rows).select("feature").write.mode("overwrite").text(path)


def manifest_rows(submissions: DataFrame) -> DataFrame:
    """Records of a batch with the path of each file in the archive."""
    file = F.concat(F.lit("rec_"), F.col("id").cast("string"), F.lit(".ogg"))
    proposed = F.col("species_slug").isNull()
    return submissions.select("id", "user_id", "status", F.col("species_slug"), "proposed_name", proposed.alias("is_proposed"), F.date_format("created_at", "yyyy-MM-dd").alias("created"), relative_path(F.col("species_slug"), F.col("proposed_name"), file).alias("path"))


def write_split(split: DataFrame, path: str) -> None:
    """JSON lines in one folder for each part."""
    split.write.mode("overwrite").partitionBy("split").json(path)


def attribution(recordings: DataFrame) -> DataFrame:
    """Per class its recordings, sorted, as one text and their number."""
    return recordings.groupBy("class").agg(F.count_distinct("recording_id").alias("recordings"), F.array_join(F.sort_array(F.collect_set("recording_id")), ", ").alias("sources"))


def attribution_markdown(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(" | ", F.lit(""), F.col("class"), F.col("recordings").cast("string"), F.col("sources"), F.lit("")).alias("line"))


def sync_batch(rows: DataFrame, most: int = 100) -> DataFrame:
    """The oldest pending rows to push."""
    return rows.filter("sync_status = 0").orderBy("window_start_ts", "id").limit(most)


def mark_synced(rows: DataFrame, pushed: DataFrame) -> DataFrame:
    """The table with pushed rows marked; to be written as its next version."""
    p = pushed.select("id", F.lit(1).alias("_p"))
    return rows.join(p, "id", "left").withColumn("sync_status", F.coalesce("_p", "sync_status")).drop("_p")


def write_alerts(messages: DataFrame, path: str) -> None:
    """Alert texts (column msg), a line each, after those that are there."""
    messages.select("msg").write.mode("append").text(path)
