"""Time expressions; all of them take the time of reference as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seconds(ts: str | Column) -> Column:
    """Seconds since the epoch as a double, for either kind of timestamp."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 1e6


def epoch_ms(ts: str | Column) -> Column:
    """Whole milliseconds since the epoch, rounded half away from it."""
    micros = F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
    rest = F.try_mod(micros, F.lit(1000))
    return F.call_function("div", micros, F.lit(1000)) + F.when(rest >= 500, 1).when(rest <= -500, -1).otherwise(0)


def between_sec(later: str | Column, earlier: str | Column) -> Column:
    return seconds(later) - seconds(earlier)


def time_bucket(ts: str | Column, hours: int) -> Column:
    """Start of the bucket of ``hours`` hours; buckets start anew each day, and 24 or
    more hours are a day."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if hours >= 24:
        return F.date_trunc("day", c)
    return F.date_trunc("hour", c) - F.make_interval(hours=F.hour(c) % hours)


def parse_timestamp(text: str | Column) -> Column:
    """Unix seconds (as a number or text) or ISO 8601; null where it is neither."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.timestamp_micros((c.try_cast("double") * 1_000_000).cast("bigint")), F.try_to_timestamp(c))


def device_state(last_seen: str | Column, as_of: Column, interval_sec: Column) -> Column:
    """never_seen, online (within one interval), silent (within three) or offline."""
    seen = F.col(last_seen) if isinstance(last_seen, str) else last_seen
    silence = between_sec(as_of, seen)
    return F.when(seen.isNull(), "never_seen").when(silence <= interval_sec, "online").when(silence <= 3 * interval_sec, "silent").otherwise("offline")


def day_end(day: Column) -> Column:
    """The last microsecond of a day."""
    return F.date_trunc("day", day) + F.expr("interval 1 day - interval 1 microsecond")


def parse_bound(text: Column, upper: bool = False) -> Column:
    """A date bound: a bare date means its first or last instant, else a timestamp."""
    stamp = F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), day_end(stamp).cast("timestamp_ntz") if upper else stamp).otherwise(stamp)


def millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def overlap_length(start_a, end_a, start_b, end_b) -> Column:
    """What two intervals share; 0 if they only touch or lie apart."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def overlap_share(start_a, end_a, start_b, end_b) -> Column:
    """The share of the shorter interval that the other has too. Of an interval without length
    it is 1 where the other holds its place, 0 elsewhere."""
    shorter = F.least(end_a - start_a, end_b - start_b)
    held = F.least(end_a, end_b) >= F.greatest(start_a, start_b)
    return F.when(shorter > 0, overlap_length(start_a, end_a, start_b, end_b) / shorter).otherwise(F.when(held, F.lit(1.0)).otherwise(F.lit(0.0)))
