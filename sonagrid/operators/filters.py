"""The filter object of the observation model, compiled to one Column predicate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sonagrid.functions import geo

#: The row limits of the reference's queries.
DEFAULT_LIMIT, MOST_ROWS = 20_000, 200_000


@dataclass(frozen=True)
class ObservationFilter:
    """What to keep of the detections; all conditions hold together.

    ``limit`` is None by default: aggregates are over all rows. With a limit, the rows
    with the earliest start (then the smallest id) are taken before anything else."""

    species: Sequence[str] = ()
    start: datetime | None = None
    end: datetime | None = None
    devices: Sequence[int | str] = ()
    min_confidence: float | None = None
    hours: Sequence[int] = ()
    include_duplicates: bool = False
    require_location: bool = True
    bbox: tuple[float, float, float, float] | None = None  #: min_lon, min_lat, max_lon, max_lat
    center: tuple[float, float] | None = None  #: lat, lon
    radius_m: float | None = None
    limit: int | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.limit is not None and self.limit > MOST_ROWS:
            raise ValueError(f"a limit is at most {MOST_ROWS} rows; without one, all rows are taken")
        object.__setattr__(self, "hours", tuple(sorted({h % 24 for h in self.hours})))
        if self.bbox is not None:
            min_lon, min_lat, max_lon, max_lat = self.bbox
            if min_lon > max_lon or min_lat > max_lat:
                raise ValueError("a box goes from its smaller to its larger coordinates")

    def is_empty(self) -> bool:
        """True if a user set nothing; a minimum confidence of 0 sets nothing."""
        return not any((self.species, self.start, self.end, self.devices, self.min_confidence, self.hours, self.bbox, self.center and self.radius_m))

    def _box(self) -> Column | None:
        """The box that holds the circle; unlike the exact distance it can prune row
        groups by their statistics."""
        lat, lon = self.center
        r = max(0.0, self.radius_m)
        dlat = math.degrees(r / geo.EARTH_M)
        cos = math.cos(math.radians(lat))
        dlon = min(180.0, math.degrees(r / (geo.EARTH_M * cos))) if cos > 1e-9 else 180.0
        return F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)

    def predicate(self) -> Column:
        found: list[Column] = []
        if self.species:
            found.append(F.col("species_slug").isin(*self.species))
        if self.start is not None:
            found.append(F.col("window_start_ts") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            found.append(F.col("window_start_ts") <= F.lit(self.end).cast("timestamp_ntz"))
        if self.devices:
            found.append(F.col("device_id").isin(*self.devices))
        if self.min_confidence is not None:
            found.append(F.col("confidence") >= self.min_confidence)
        if self.hours:
            found.append(F.hour("window_start_ts").isin(*self.hours))
        if not self.include_duplicates:
            found.append(F.col("duplicate_of_id").isNull())
        if self.require_location:
            found.append(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        if self.bbox is not None:
            min_lon, min_lat, max_lon, max_lat = self.bbox
            found.append(F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon))
        if self.center is not None and self.radius_m is not None:
            found.append(self._box() & (geo.haversine("lat", "lon", *map(F.lit, self.center)) <= self.radius_m))
        out = F.lit(True)
        for c in found:
            out = out & c
        return out

    def apply(self, detections: DataFrame) -> DataFrame:
        rows = detections.filter(self.predicate())
        if self.limit is not None:
            rows = rows.orderBy("window_start_ts", "id").limit(self.limit)
        return rows


def unknown_species(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """The asked slugs that the registry does not have."""
    return asked.join(registry, "slug", "left_anti")


def recent(rows: DataFrame, as_of: datetime, hours: float = 48, column: str = "window_start_ts") -> DataFrame:
    return rows.filter(F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(hours * 3600)} seconds"))


def consent_valid(users: DataFrame, as_of: datetime, days: int = 365) -> DataFrame:
    """Users with consent that is at most ``days`` whole days old."""
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("consented_at").cast("timestamp"))) / 86_400_000_000)
    return users.filter(F.col("consent") & (age <= days))


def quality_at_least(rows: DataFrame, worst: str = "B", country: str | None = None, column: str = "q") -> DataFrame:
    """Recordings of a grade (A is best) of at least ``worst``."""
    kept = rows.filter(F.col(column).between("A", worst))
    return kept if country is None else kept.filter(F.lower("cnt") == country.lower())


def chunk_rejection(as_of: Column, least_sec: float = 20, most_sec: float = 90, old_sec: float = 120, ahead_sec: float = 300) -> Column:
    """Why a chunk is refused, or null: not_positive, too_short, too_long, too_old, ahead."""
    dur = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    now = F.unix_micros(as_of.cast("timestamp"))
    return (
        F.when(dur <= 0, "not_positive").when(dur < least_sec, "too_short").when(dur > most_sec, "too_long")
        .when(F.unix_micros(F.col("ended_at").cast("timestamp")) < now - old_sec * 1e6, "too_old")
        .when(F.unix_micros(F.col("started_at").cast("timestamp")) > now + ahead_sec * 1e6, "ahead")
    )
