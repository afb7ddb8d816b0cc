"""String, map and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_int(column: str | Column, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}").try_cast("int")


#: Suffixes by which a part of a recording is told from the recording.
_PART = r"(?i)^(.*?)(?:[_-](?:part|clip)\d+|[_-]chunk\d+.*)$"


def recording_id(file_name: str | Column, pattern: str | None = None) -> Column:
    """The recording of a file: its stem without a part suffix, or group 1 of ``pattern``
    where that matches."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    base = F.regexp_extract(stem, _PART, 1)
    found = F.when(base != "", base).otherwise(stem)
    if pattern is None:
        return found
    own = F.regexp_extract(stem, pattern, 1)
    return F.when(own != "", own).otherwise(found)


def sanitize(name: str | Column, default: str = "unknown", most: int = 60) -> Column:
    """A name that is safe in a path: other characters become one underscore."""
    c = F.col(name) if isinstance(name, str) else name
    clean = F.left(F.trim(F.regexp_replace(c, r"(?U)\W+", "_"), F.lit("_")), F.lit(most))
    clean = F.regexp_replace(clean, "_+", "_")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(default)).otherwise(clean)


def scientific_name(slug: str | Column) -> Column:
    """``anas_platyrhynchos`` to ``Anas platyrhynchos``."""
    c = F.replace(F.col(slug) if isinstance(slug, str) else slug, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1000)))


def species_label(name: Column, slug: Column, noise: str = "_noise") -> Column:
    return F.when(slug == noise, F.lit("noise")).otherwise(F.concat(name, F.lit(" ("), slug, F.lit(")")))


def split_csv(text: str | Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_quoted(text: str | Column) -> Column:
    """RFC 4180 quoting where a separator, quote or line end asks for it."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def relative_path(slug: Column, proposed: Column, file: Column) -> Column:
    """Folder of a submission: proposed names apart from known species."""
    return F.when(slug.isNull(), F.concat(F.lit("proposed/"), sanitize(proposed), F.lit("/"), file)).otherwise(F.concat(slug, F.lit("/"), file))


def token_prefix(token: Column, size: int = 12) -> Column:
    return F.left(token, F.lit(size))


def alert_text(name: Column, silent_since: Column, silence_sec: Column) -> Column:
    """Text of a silence alert: since when (HH:mm) and for how many minutes."""
    return F.format_string("%s is silent since %s (%d min)", name, F.date_format(silent_since, "HH:mm"), F.floor(silence_sec / 60))


def argmax(probabilities: Column, order: Column | None = None) -> Column:
    """Key of the largest value of a map; on ties the key that comes first in ``order``
    (an array of keys), or the smallest key without one."""
    if order is None:
        order = F.array_sort(F.map_keys(probabilities))
    scored = F.transform(F.map_entries(probabilities), lambda e: F.struct(e["value"].alias("v"), (-F.array_position(order, e["key"])).alias("r"), e["key"].alias("k")))
    return F.array_max(scored)["k"]
