"""Wide records as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def wide_to_long(record: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """venue_id, day, slot, time of the given columns of day records."""
    return record.unpivot(["venue_id", "day"], list(slots), "slot", "time").filter("time is not null")
