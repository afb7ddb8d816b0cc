"""A sweep over intervals in the order of their starts, with the spans that are still open.

Runs of intervals that touch are dealt over tasks; a task goes through its runs in order and
holds nothing but the open spans of the present one, however long it is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Spans that have ended are dropped when the open ones have grown by so many.
SPARE = 16


def fraction(a: tuple[int, int], b: tuple[int, int]) -> float:
    """The share of the shorter interval that the other has too; of intervals without length,
    1 where they touch and 0 elsewhere."""
    shared, shorter = min(a[1], b[1]) - max(a[0], b[0]), min(a[1] - a[0], b[1] - b[0])
    return max(0, shared) / shorter if shorter > 0 else float(shared >= 0)


def _first(least: float, absorbing: bool, touching: bool, digits: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, open_, bound = None, [], SPARE
        for frame in frames:
            found: list[int | None] = []
            for group, s, e, name, may in zip(frame["run"], frame["s"].tolist(), frame["e"].tolist(), frame["id"].tolist(), frame["may"].tolist(), strict=True):
                if group != present:
                    present, open_, bound = group, [], SPARE
                elif len(open_) > bound:
                    open_ = [x for x in open_ if x[1] >= s]
                    bound = 2 * len(open_) + SPARE
                of = None
                if may:
                    for s0, e0, other in open_:
                        if not (e0 > s or touching and e0 == s):
                            continue
                        share = fraction((s, e), (s0, e0))
                        if (share if digits is None else round(share, digits)) >= least:
                            of = other
                            break
                found.append(of)
                if of is None or not absorbing:
                    open_.append((s, e, name))
            yield pd.DataFrame({"id": frame["id"], "of_id": pd.array(found, "Int64")})

    return run


def first_match(runs: DataFrame, keys: Sequence[str], least: float, absorbing: bool, touching: bool = True, digits: int | None = None) -> DataFrame:
    """id, of_id: for each interval the first one, by (start, id), of its run that it overlaps
    by ``least`` of the shorter interval; null where there is none. ``absorbing``: an interval
    that has a match is none for others. ``touching``: an interval without length matches what
    ends where it begins. ``digits``: shares are rounded first.

    ``runs``: the keys, island (number of the run within the keys), id, s and e (whole
    microseconds), may (whether to look for a match). Between runs nothing may touch."""
    named = runs.select(F.to_json(F.struct(*keys, "island"), {"ignoreNullFields": "false"}).alias("run"), "s", "e", "id", "may")
    sorted_ = named.repartition("run").sortWithinPartitions("run", "s", "id")
    return sorted_.mapInPandas(_first(least, absorbing, touching, digits), "id long, of_id long")
