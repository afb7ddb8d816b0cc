"""State changes as events: tables are never updated, the latest version is a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; one aggregate, no sort."""
    rest = [c for c in events.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes``: new keys are added, and a null in a change
    leaves the old value."""
    rest = [c for c in table.columns if c != key]
    a, b = table.alias("a"), changes.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest])


def corrected(rows: DataFrame, corrections: DataFrame, key: str = "id", column: str = "species_slug") -> DataFrame:
    """Rows with a user's value in place of the detected one."""
    return rows.join(corrections.select(key, F.col(column).alias("_own")), key, "left").withColumn(column, F.coalesce("_own", column)).drop("_own")


def expired(rows: DataFrame, before: str, column: str) -> DataFrame:
    """What stays after deletion of rows older than a time."""
    return rows.filter(F.col(column) >= F.lit(before).cast("timestamp_ntz"))


#: Which state of a submission may follow which.
TRANSITIONS = {"incoming": {"pending", "undone"}, "pending": {"sent_for_review", "undone"}, "sent_for_review": {"accepted", "rejected"}}


def transition_allowed(before: str = "before", after: str = "after"):
    found = F.lit(False)
    for a, bs in sorted(TRANSITIONS.items()):
        found = found | (F.col(before) == a) & F.col(after).isin(*sorted(bs))
    return found


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` inserted; a row of a known key takes the place of the old one,
    nulls included."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def consented(users: DataFrame, consents: DataFrame) -> DataFrame:
    """``users`` (user_id, name, consent, consented_at) after ``consents`` (user_id, name, at),
    of which the latest of a user counts: it sets the consent and its time, and the name
    where it has one; unknown users are added."""
    new = latest(consents, "user_id", ["at"]).select("user_id", F.col("name").alias("_name"), "at")
    both = users.join(new, "user_id", "full_outer")
    came = F.col("at").isNotNull()
    return both.select("user_id", F.coalesce("_name", "name").alias("name"), F.when(came, True).otherwise(F.col("consent")).alias("consent"), F.coalesce("at", "consented_at").alias("consented_at"))


def registered(events: DataFrame) -> DataFrame:
    """Devices from their events (device_id, kind: registered, updated, activated or
    deactivated; name, at, id): the last name that was given, whether the device is active
    (from its registration on), when it was registered and last changed."""
    named, switched = F.col("name").isNotNull(), F.col("kind").isin("activated", "deactivated", "registered")
    order = F.struct("at", "id")
    return events.groupBy("device_id").agg(
        F.max_by(F.when(named, F.col("name")), F.when(named, order)).alias("name"),
        F.max_by(F.col("kind") != "deactivated", F.when(switched, order)).alias("is_active"),
        F.min(F.when(F.col("kind") == "registered", F.col("at"))).alias("created_at"),
        F.max("at").alias("updated_at"),
    ).filter("created_at is not null")
