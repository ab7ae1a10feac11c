"""Relational, spatial and temporal queries over venues, their sources and occurrences.

Tables: venue (venue_id, name, city, lat, lng, …), occurrence (venue_id, day,
slot, session, time, begin, …), source (source_id, venue_id, status, …).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAILY, WEEKLY

DEGREE_KM = 111.0


def in_box(box: tuple[float, float, float, float]) -> Column:
    """min_lng, min_lat, max_lng, max_lat; all sides inclusive."""
    return F.col("lat").between(F.lit(box[1]), F.lit(box[3])) & F.col("lng").between(F.lit(box[0]), F.lit(box[2]))


def within(lat: float, lng: float, radius_km: float) -> Column:
    """Equirectangular distance; the implied latitude range comes first, for pruning."""
    dy = (F.col("lat") - F.lit(lat)) * DEGREE_KM
    dx = (F.col("lng") - F.lit(lng)) * DEGREE_KM * F.cos(F.radians(F.lit(lat)))
    slack = radius_km / DEGREE_KM * 1.000001
    return F.col("lat").between(F.lit(lat - slack), F.lit(lat + slack)) & (F.sqrt(dx * dx + dy * dy) <= radius_km)


def filter_venues(venue: DataFrame, city: str | None = None, bbox=None, near=None, radius_km: float | None = None) -> DataFrame:
    if near is not None and radius_km is None:
        raise ValueError("near needs radius_km")
    if city is not None:
        venue = venue.filter(F.col("city") == city)
    if bbox is not None:
        venue = venue.filter(in_box(bbox))
    return venue.filter(within(*near, radius_km)) if near is not None else venue


def with_times(venue: DataFrame, occurrence: DataFrame) -> DataFrame:
    return venue.join(occurrence.select("venue_id"), "venue_id", "left_semi")


def without_times(venue: DataFrame, occurrence: DataFrame) -> DataFrame:
    return venue.join(occurrence.select("venue_id"), "venue_id", "left_anti")


def mark_times(venue: DataFrame, occurrence: DataFrame) -> DataFrame:
    """`venue` with has_times."""
    keys = occurrence.select("venue_id").distinct().withColumn("__has", F.lit(True))
    return venue.join(keys, "venue_id", "left").withColumn("has_times", F.coalesce("__has", F.lit(False))).drop("__has")


def first_source(source: DataFrame) -> DataFrame:
    """The source of least id of each venue."""
    first = source.groupBy("venue_id").agg(F.min_by(F.struct(*source.columns), "source_id").alias("s"))
    return first.select("s.*")


def list_venues(venue: DataFrame, occurrence: DataFrame, source: DataFrame | None = None, has_times: bool | None = None, limit: int = 200, offset: int = 0, **where) -> DataFrame:
    """A page of venues by id, with has_times and the state of their first source."""
    if not 0 < limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    found = mark_times(filter_venues(venue, **where), occurrence)
    if has_times is not None:
        found = found.filter(F.col("has_times") == has_times)
    page = found.orderBy("venue_id").offset(offset).limit(limit)
    if source is not None:
        state = first_source(source).select("venue_id", F.col("status").alias("source_status"), F.coalesce(F.array_contains("flags", "jumuah_missing"), F.lit(False)).alias("weekly_missing"))
        page = page.join(state, "venue_id", "left").withColumn("weekly_missing", F.coalesce("weekly_missing", F.lit(False)))
    return page.orderBy("venue_id")


def search(venue: DataFrame, text: str) -> DataFrame:
    """Case-insensitive part of the name or the city; an empty text finds all."""
    part = F.lit(text.lower())
    return venue.filter(F.contains(F.lower("name"), part) | F.contains(F.lower(F.coalesce("city", F.lit(""))), part))


def venue_times(occurrence: DataFrame, venue_id, first: str, last: str) -> DataFrame:
    """Occurrences of a venue from day to day, both inclusive."""
    return occurrence.filter((F.col("venue_id") == venue_id) & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).orderBy("day", "slot", "session")


def times_on(venue: DataFrame, occurrence: DataFrame, day: str, slot: str | None = None, **where) -> DataFrame:
    """Flat occurrence rows of a day with their venues."""
    rows = occurrence.filter(F.col("day") == F.lit(day).cast("date"))
    if slot is not None:
        rows = rows.filter(F.col("slot") == slot)
    return filter_venues(venue, **where).join(rows, "venue_id")


def group_days(occurrence: DataFrame) -> DataFrame:
    """venue_id, day and the ordered array of its occurrences."""
    row = F.struct("slot", "session", "time", "begin")
    return occurrence.groupBy("venue_id", "day").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def day_pivot(occurrence: DataFrame) -> DataFrame:
    """One record a venue and day: a column for each daily slot, a map of begins, an array of weekly sessions.

    The last session of a daily slot wins; weekly sessions are sorted by time;
    unknown slots are ignored.
    """
    pick = [F.max_by(F.when(F.col("slot") == s, F.col("time")), F.when(F.col("slot") == s, F.col("session"))).alias(s) for s in DAILY]
    begin = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("slot").isin(*DAILY) & F.col("begin").isNotNull(), F.struct("slot", "begin")))))
    weekly = F.array_sort(F.collect_list(F.when(F.col("slot") == WEEKLY, F.struct("time", "session", "begin"))))
    record = occurrence.groupBy("venue_id", "day").agg(*pick, begin.alias("begin"), weekly.alias(WEEKLY))
    return record.withColumn("begin", F.when(F.size("begin") > 0, F.col("begin")))


def snapshot(venue: DataFrame, occurrence: DataFrame, today: str, days: int = 45) -> DataFrame:
    """All venues with their occurrences from today to the horizon; none gives an empty array."""
    start = F.lit(today).cast("date")
    rows = occurrence.filter(F.col("day").between(start, F.date_add(start, days)))
    grouped = rows.groupBy("venue_id").agg(F.array_sort(F.collect_list(F.struct("day", "slot", "session", "time"))).alias("times"))
    empty = F.array().cast(grouped.schema["times"].dataType)
    return venue.join(grouped, "venue_id", "left").withColumn("times", F.coalesce("times", empty)).withColumn("has_times", F.size("times") > 0)


def snapshot_tag(rows: DataFrame, key: str) -> DataFrame:
    """(tag, rows): a quoted name of the content of `rows`, one of each key; equal rows have equal tags, however they lie.

    The canonical JSON of every row is digested where the row is, the digests of a
    range of keys in the order of the keys' digests, and these in order: two
    levels, the upper one of at most 4,096 digests.
    """
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    name = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    each = rows.select(F.left(name, F.lit(3)).alias("range"), F.struct(name.alias("name"), F.sha2(line.cast("binary"), 256).alias("digest")).alias("d"))
    joined = lambda pairs: F.array_join(F.transform(F.array_sort(pairs), lambda x: x["digest"]), "")
    part = each.groupBy("range").agg(F.sha2(joined(F.collect_list("d")).cast("binary"), 256).alias("digest"), F.count("*").alias("rows"))
    top = part.agg(F.sha2(joined(F.collect_list(F.struct("range", "digest"))).cast("binary"), 256).alias("digest"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return top.select(F.concat(F.lit('"'), F.left("digest", F.lit(16)), F.lit('"')).alias("tag"), "rows")


def by_city_size(venue: DataFrame) -> DataFrame:
    """Venues with the size of their city's group, for work order (largest first, then id); null is a city."""
    return venue.withColumn("city_size", F.count("*").over(Window.partitionBy("city")))


def city_size_places(venue: DataFrame, span: int = 10_000) -> DataFrame:
    """(venue_id, place) of every venue in the order of `by_city_size`, from 1.

    Rows are numbered within ranges of `span` ids of a city size; a range's offset
    is what stands before it.  The one window without a partition has a row for each
    city size, of which n venues have at most the root of 2 n.
    """
    rows = by_city_size(venue).select("venue_id", "city_size", F.floor(F.col("venue_id") / span).alias("part"))
    parts = rows.groupBy("city_size", "part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("city_size").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sizes = sizes.select("city_size", before(Window.orderBy(F.desc("city_size"))).alias("larger"))
    parts = parts.withColumn("lower", before(Window.partitionBy("city_size").orderBy("part"))).join(sizes, "city_size")
    within = F.row_number().over(Window.partitionBy("city_size", "part").orderBy("venue_id"))
    return rows.withColumn("k", within).join(parts, ["city_size", "part"]).select("venue_id", (F.col("larger") + F.col("lower") + F.col("k")).alias("place"))


def blocked(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """`urls` with host and blocked: the host, or a domain above it, is listed.

    Each host is cut into the domains above it, which turns the suffix test into
    an equality join; no row is compared with every listed host.
    """
    labels = F.split("host", r"\.")
    above = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    found = urls.select("host").distinct().withColumn("labels", labels).withColumn("domain", F.explode(above))
    found = found.join(hosts.select(F.col("host").alias("domain")), "domain", "left_semi").select("host").distinct().withColumn("__hit", F.lit(True))
    return urls.join(found, "host", "left").withColumn("blocked", F.coalesce("__hit", F.lit(False))).drop("__hit")
