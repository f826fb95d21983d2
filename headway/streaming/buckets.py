"""Vehicles share a key of a stateful operator by buckets of their number.

A call into the state, a group's data frames and its timers cost milliseconds
each, so a key for every vehicle makes a stream's time grow with the vehicles.
A bucket's states are one list, read and written at once; a micro-batch rewrites
the lists of the buckets that it has rows of.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime, so that numbers with a common step spread; a checkpoint holds for one value only.
BUCKETS = 4099


def bucket() -> Column:
    return F.pmod("vehicle_id", F.lit(BUCKETS)).alias("bucket")


def number(v) -> int | None:
    """A vehicle's number as pandas gives it."""
    return None if v is None or v != v else int(v)


def listed(state, fields: list[str]) -> dict[int | None, dict]:
    """The states by vehicle of a list state of rows (vehicle_id, fields)."""
    return {row[0]: dict(zip(fields, row[1:])) for row in state.get()} if state.exists() else {}
