"""Queries over the engine's logical tables, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranking, state, tables, venues
from ..plans import gates, materialize
from ..sources import adapters as A
from ..sources.seeds import BLOCKED_HOSTS, clean_export, read_hosts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VENUE = "venue AS (SELECT c_custkey AS venue_id, c_name AS name, n_name AS city, 50 + CAST(c_custkey * 37 % 800 AS DOUBLE) / 100 AS lat, -6 + CAST(c_custkey * 53 % 800 AS DOUBLE) / 100 AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey)"
OCC = """occ AS (SELECT user_id AS venue_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 'fajr' WHEN 'click' THEN 'dhuhr' WHEN 'signup' THEN 'asr' WHEN 'purchase' THEN 'maghrib' WHEN 'error' THEN 'isha' END AS slot,
  0 AS session, strftime(ts, '%H:%M') AS time FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) = 1)"""
SRC = """src AS (SELECT o_orderkey AS source_id, o_custkey AS venue_id, CASE o_orderstatus WHEN 'F' THEN 'authored' WHEN 'O' THEN 'candidate' ELSE 'review' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'https://host' || (o_orderkey % 97) || '.example/' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 7 = 0 THEN '["jumuah_missing"]' WHEN o_orderkey % 7 = 1 THEN '["partial_horizon","jumuah_missing"]' WHEN o_orderkey % 7 = 2 THEN '[]' END AS flags FROM orders)"""
MIN = "(CAST(substr({0}, 1, 2) AS INT) * 60 + CAST(substr({0}, 4, 2) AS INT))"
ORDER = "CASE slot WHEN 'fajr' THEN 1 WHEN 'dhuhr' THEN 2 WHEN 'asr' THEN 3 WHEN 'maghrib' THEN 4 WHEN 'isha' THEN 5 END"
NEAR = "sqrt(pow((lng - (-1.9)) * 111.0 * cos(radians(52.5)), 2) + pow((lat - 52.5) * 111.0, 2)) <= 250"
SPOT, KM, BOX, DAY = (52.5, -1.9), 250.0, (-4.0, 51.0, 1.0, 56.0), "2024-01-05"
IN_BOX = "lat BETWEEN 51 AND 56 AND lng BETWEEN -4 AND 1"
SLOTS = ("fajr", "dhuhr", "asr", "maghrib", "isha")


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {VENUE}, {OCC} SELECT venue_id, name, city, slot, time FROM venue JOIN occ USING (venue_id) WHERE day = DATE '{DAY}' AND slot = 'asr' AND {IN_BOX} AND {NEAR}")
def flagship_times_near(spark, d):
    rows = venues.times_on(A.venue(spark, d), A.occurrence(spark, d), DAY, "asr", bbox=BOX, near=SPOT, radius_km=KM)
    return rows.select("venue_id", "name", "city", "slot", "time")


@query(f"WITH {VENUE} SELECT venue_id, name FROM venue WHERE city = (SELECT min(n_name) FROM nation)")
def filter_city(spark, d):
    city = A.table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return venues.filter_venues(A.venue(spark, d), city=city).select("venue_id", "name")


@query(f"WITH {VENUE} SELECT venue_id, lat, lng FROM venue WHERE {IN_BOX}")
def bbox(spark, d):
    return venues.filter_venues(A.venue(spark, d), bbox=BOX).select("venue_id", "lat", "lng")


@query(f"WITH {VENUE} SELECT venue_id, name FROM venue WHERE {NEAR}")
def near_radius(spark, d):
    return venues.filter_venues(A.venue(spark, d), near=SPOT, radius_km=KM).select("venue_id", "name")


@query(f"WITH {OCC} SELECT venue_id, day, slot, time FROM occ WHERE venue_id = 7 AND day BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'")
def times_range(spark, d):
    return venues.venue_times(A.occurrence(spark, d), 7, "2024-01-02", "2024-01-20").select("venue_id", "day", "slot", "time")


@query(f"WITH {VENUE}, {OCC} SELECT venue_id, city, slot, time FROM venue JOIN occ USING (venue_id) WHERE day = DATE '{DAY}' AND slot = 'isha'")
def times_by_prayer(spark, d):
    return venues.times_on(A.venue(spark, d), A.occurrence(spark, d), DAY, "isha").select("venue_id", "city", "slot", "time")


@query(f"WITH {VENUE} SELECT venue_id, name FROM venue WHERE contains(lower(name), 'ion_1') OR contains(lower(city), 'ion_1')")
def search_substring(spark, d):
    return venues.search(A.venue(spark, d), "ION_1").select("venue_id", "name")


@query(f"WITH {SRC} SELECT source_id, status FROM src WHERE status IN ('authored', 'review') AND url IS NOT NULL")
def in_list_notnull(spark, d):
    return A.source(spark, d).filter(F.col("status").isin("authored", "review") & F.col("url").isNotNull()).select("source_id", "status")


@query(f"WITH {SRC} SELECT source_id FROM src WHERE contains(flags, '\"jumuah_missing\"')")
def flag_contains(spark, d):
    return A.source(spark, d).filter(F.array_contains(F.from_json("flags", "array<string>"), "jumuah_missing")).select("source_id")


_HOSTS = ", ".join(f"('{h}')" for h in (*BLOCKED_HOSTS, "example.com"))


@query(f"WITH hosts(b) AS (VALUES {_HOSTS}), u AS (SELECT page_id, lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host FROM pages) SELECT page_id, host, EXISTS (SELECT 1 FROM hosts WHERE host = b OR ends_with(host, '.' || b)) AS blocked FROM u")
def blocklist_host(spark, d):
    urls = A.table(spark, d, "pages").select("page_id", S.url_host(F.col("url")).alias("host"))
    hosts = read_hosts(spark).unionByName(spark.createDataFrame([("example.com",)], "host string"))
    return venues.blocked(urls, hosts).select("page_id", "host", "blocked")


@query(f"WITH {VENUE}, {OCC} SELECT venue_id FROM venue WHERE venue_id IN (SELECT venue_id FROM occ)")
def has_times_semi(spark, d):
    return venues.with_times(A.venue(spark, d), A.occurrence(spark, d)).select("venue_id")


@query(f"WITH {VENUE}, {OCC} SELECT venue_id FROM venue WHERE venue_id NOT IN (SELECT venue_id FROM occ)")
def has_times_anti(spark, d):
    return venues.without_times(A.venue(spark, d), A.occurrence(spark, d)).select("venue_id")


@query(f"WITH {VENUE}, {SRC} SELECT venue_id FROM venue WHERE venue_id NOT IN (SELECT venue_id FROM src WHERE status = 'authored')")
def not_in_anti(spark, d):
    return A.venue(spark, d).join(A.source(spark, d).filter("status = 'authored'"), "venue_id", "left_anti").select("venue_id")


@query(f"WITH {VENUE}, {SRC}, f AS (SELECT venue_id, min(source_id) AS source_id FROM src GROUP BY 1) SELECT venue_id, f.source_id, status FROM venue LEFT JOIN f USING (venue_id) LEFT JOIN (SELECT source_id, status FROM src) s ON s.source_id = f.source_id")
def left_first_source(spark, d):
    first = venues.first_source(A.source(spark, d)).select("venue_id", "source_id", "status")
    return A.venue(spark, d).join(first, "venue_id", "left").select("venue_id", "source_id", "status")


@query(f"WITH {VENUE}, {OCC}, g AS (SELECT venue_id, count(*) AS n, string_agg(day || ' ' || slot || ' ' || time, ',' ORDER BY day, slot, session) AS times FROM occ WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-03' + 45 GROUP BY 1) SELECT venue_id, coalesce(n, 0) AS n, coalesce(times, '') AS times FROM venue LEFT JOIN g USING (venue_id)")
def snapshot(spark, d):
    s = venues.snapshot(A.venue(spark, d), A.occurrence(spark, d), "2024-01-03")
    joined = F.array_join(F.transform("times", lambda t: F.concat_ws(" ", t["day"].cast("string"), t["slot"], t["time"])), ",")
    return s.select("venue_id", F.size("times").cast("long").alias("n"), joined.alias("times"))


@query(f"WITH {OCC} SELECT a.venue_id, a.day, a.slot, CASE WHEN {MIN.format('b.time')} + 15 < 1440 THEN printf('%02d:%02d', CAST(({MIN.format('b.time')} + 15) // 60 AS INT), CAST(({MIN.format('b.time')} + 15) % 60 AS INT)) END AS time FROM occ a LEFT JOIN occ b ON a.venue_id = b.venue_id AND a.day = b.day AND b.slot = 'maghrib' WHERE a.slot = 'isha'")
def offset_selfjoin(spark, d):
    o = A.occurrence(spark, d)
    base = o.filter("slot = 'maghrib'").select("venue_id", "day", F.col("time").alias("base"))
    return o.filter("slot = 'isha'").join(base, ["venue_id", "day"], "left").select("venue_id", "day", "slot", S.apply_offset(F.col("base"), F.lit(15)).alias("time"))


@query(f"WITH {OCC}, m AS (SELECT CASE WHEN venue_id % 10 = 3 THEN venue_id - 1 ELSE venue_id END AS venue_id, venue_id AS own, day, slot, time FROM occ) SELECT venue_id, day, slot, time FROM m QUALIFY row_number() OVER (PARTITION BY venue_id, day, slot ORDER BY own <> venue_id, own) = 1")
def merge_dedupe(spark, d):
    o = A.occurrence(spark, d)
    pairs = o.select(F.col("venue_id").alias("dropped")).distinct().filter("dropped % 10 = 3").withColumn("survivor", F.col("dropped") - 1)
    return state.merge_rows(o, pairs).select("venue_id", "day", "slot", "time")


@query(f"WITH {VENUE} SELECT a.venue_id, concat_ws('|', a.city, b.name, b.city) AS aliases FROM venue a JOIN venue b ON b.venue_id = a.venue_id + 1 WHERE a.venue_id % 2 = 0 AND a.city <> b.city UNION ALL SELECT a.venue_id, concat_ws('|', a.city, b.name) FROM venue a JOIN venue b ON b.venue_id = a.venue_id + 1 WHERE a.venue_id % 2 = 0 AND a.city = b.city")
def merge_aliases(spark, d):
    v = A.venue(spark, d).withColumn("aliases", F.array("city"))
    dropped = v.filter("venue_id % 2 = 1").select((F.col("venue_id") - 1).alias("survivor"), F.lit(0).alias("ordinal"), "name", "aliases")
    kept = v.filter("venue_id % 2 = 0").join(dropped.select(F.col("survivor").alias("venue_id")), "venue_id", "left_semi")
    return state.merge_aliases(kept, dropped).select("venue_id", F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {OCC}, s(slot) AS (VALUES ('fajr'), ('dhuhr'), ('asr'), ('maghrib'), ('isha')) SELECT day, slot FROM (SELECT DISTINCT day FROM occ), s")
def calendar_cross(spark, d):
    days = A.occurrence(spark, d).select("day").distinct()
    return days.select("day", F.explode(F.array(*map(F.lit, SLOTS))).alias("slot"))


@query(f"WITH {SRC}, m AS (SELECT unnest([0, 1, 2]) AS idx) SELECT source_id, idx, CAST(idx + 1 AS INT) AS month, url || '/2024/' || printf('%02d', idx + 1) AS url FROM src, m WHERE url IS NOT NULL")
def paging_expand(spark, d):
    source = A.source(spark, d).filter("url is not null").select("source_id", F.concat("url", F.lit("/{year}/{month:02d}")).alias("template"))
    none = spark.createDataFrame([], "url string, html string")
    return materialize.expand_pages(source, none, "2024-01-05", 60).select("source_id", "idx", "month", "url")


@query(f"WITH {SRC} SELECT coalesce(status, 'TOTAL') AS status, count(*) AS n FROM src GROUP BY ROLLUP (status)")
def triage_breakdown(spark, d):
    return A.source(spark, d).rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("TOTAL")).alias("status"), "n")


@query(f"WITH {OCC} SELECT DISTINCT venue_id FROM occ")
def distinct_keys(spark, d):
    return A.occurrence(spark, d).select("venue_id").distinct()


@query(f"WITH {OCC} SELECT venue_id, day, string_agg(slot || '=' || time, ',' ORDER BY slot, session) AS rows FROM occ GROUP BY 1, 2")
def group_collect(spark, d):
    g = venues.group_days(A.occurrence(spark, d))
    return g.select("venue_id", "day", F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["slot"], r["time"])), ",").alias("rows"))


@query(f"WITH {OCC} SELECT venue_id, day, " + ", ".join(f"max(CASE WHEN slot = '{s}' THEN time END) AS {s}" for s in SLOTS) + " FROM occ GROUP BY 1, 2")
def day_pivot(spark, d):
    return venues.day_pivot(A.occurrence(spark, d)).select("venue_id", "day", *SLOTS)


@query(f"WITH {SRC} SELECT CASE WHEN status = 'authored' THEN 'done' WHEN url IS NULL THEN 'no_url' ELSE 'open' END AS outcome, count(*) AS n, CAST(sum(source_id % 3) AS BIGINT) AS calls FROM src GROUP BY 1")
def outcome_tally(spark, d):
    bucket = F.when(F.col("status") == "authored", "done").when(F.col("url").isNull(), "no_url").otherwise("open")
    return A.source(spark, d).groupBy(bucket.alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.col("source_id") % 3).alias("calls"))


@query("SELECT user_id, avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 12 GROUP BY 1")
def column_profile(spark, d):
    e = A.table(spark, d, "events").withColumn("text", F.expr("if(event_id % 3 = 0, date_format(ts, 'H.mm'), 'none')"))
    return ranking.profile(e, ["user_id"], "event_id", S.parse_time(F.col("text")).isNotNull())


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark, d):
    return ranking.last_wins(A.table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END DESC, l_linestatus DESC, l_quantity DESC, l_tax DESC, l_discount DESC, l_linenumber, l_partkey) = 1")
def rank_candidates(spark, d):
    c = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("case l_returnflag when 'A' then 'auto_accept' when 'R' then 'review' else 'reject' end").alias("lane"), F.col("l_linestatus").alias("specific"), F.col("l_quantity").alias("rows"), F.col("l_tax").alias("structured"), F.col("l_discount").alias("confidence"), F.struct("l_linenumber", "l_partkey").alias("place"))
    return ranking.rank_candidates(c, "l_orderkey").filter("rank = 1").select("l_orderkey", "l_linenumber")


@query(f"WITH {VENUE} SELECT venue_id, row_number() OVER (ORDER BY n DESC, venue_id) AS place FROM (SELECT *, count(*) OVER (PARTITION BY city) AS n FROM venue)")
def order_by_group_size(spark, d):
    return venues.city_size_places(A.venue(spark, d))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marker FROM events")
def carry_forward(spark, d):
    e = A.table(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return ranking.carry_forward(e, "user_id", ["ts", "event_id"], "mark", "marker").select("event_id", "marker")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM events")
def segment_tokens(spark, d):
    e = A.table(spark, d, "events")
    return ranking.segments(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "segment").select("event_id", "segment")


@query("WITH p AS (SELECT user_id, CAST(event_id AS BIGINT) AS place FROM events), c AS (SELECT a.user_id, greatest(a.place - 800, 0) AS start, count(*) AS hits FROM p a JOIN p b ON a.user_id = b.user_id AND b.place BETWEEN a.place - 800 AND a.place + 1200 GROUP BY a.user_id, a.place) SELECT user_id, start, hits FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, start) = 1")
def densest_window(spark, d):
    e = A.table(spark, d, "events").select("user_id", F.col("event_id").cast("long").alias("place"))
    return ranking.densest_window(e, "user_id", "place", 800, 2000)


@query(f"WITH {VENUE}, {OCC} SELECT venue_id, venue_id IN (SELECT venue_id FROM occ) AS has_times FROM venue ORDER BY venue_id LIMIT 50 OFFSET 20")
def paged_list(spark, d):
    return venues.list_venues(A.venue(spark, d), A.occurrence(spark, d), limit=50, offset=20).select("venue_id", "has_times")


_SCORE = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{k}', ''))) / {len(k)}" for k in S.KEYWORDS)


@query(f"SELECT doc_id, CAST({_SCORE} + CASE WHEN contains(text, ':') THEN 5 ELSE 0 END AS DOUBLE) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 5")
def topk_score(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.keyword_score(F.col("text")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(5)


@query(f"SELECT doc_id, CAST({_SCORE} + CASE WHEN contains(text, ':') THEN 5 ELSE 0 END AS DOUBLE) AS score FROM documents")
def keyword_score(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.keyword_score(F.col("text")).alias("score"))


@query("WITH h AS (SELECT lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host, page_id FROM pages), u AS (SELECT host, 0 AS part, page_id FROM h WHERE page_id % 2 = 0 UNION ALL SELECT host, 1, page_id FROM h) SELECT host, part, page_id AS ordinal FROM u QUALIFY row_number() OVER (PARTITION BY host ORDER BY part, page_id) = 1")
def ordered_union_dedupe(spark, d):
    h = A.table(spark, d, "pages").select(S.url_host(F.col("url")).alias("host"), F.col("page_id").alias("ordinal"))
    return ranking.ordered_union([h.filter("ordinal % 2 = 0"), h], "host")


@query(f"WITH {OCC} SELECT day, slot, time FROM occ UNION ALL SELECT DISTINCT day, 'jumuah', '13:30' FROM occ WHERE isodow(day) = 5")
def union_rows(spark, d):
    o = A.occurrence(spark, d)
    fridays = o.select("day").distinct().filter(S.is_friday(F.col("day"))).select("day", F.lit("jumuah").alias("slot"), F.lit("13:30").alias("time"))
    return o.select("day", "slot", "time").unionByName(fridays)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, nullif(concat_ws(', ', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END), '') AS address, 'GB' AS country FROM customer")
def seed_clean(spark, d):
    raw = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.expr("if(c_custkey % 3 = 0, '', c_mktsegment)").alias("address_line1"), F.expr("if(c_custkey % 2 = 0, null, c_name)").alias("address_line2"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("postcode"), F.lit(None).cast("string").alias("country"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    return clean_export(raw).select("id", "name", "address", "country")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_merge(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", "c_name")
    return state.upsert(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0").withColumn("c_name", F.lit(None).cast("string")), "c_custkey")


@query(f"WITH {OCC} SELECT venue_id AS source_id, day, slot, CASE WHEN venue_id % 4 = 0 THEN '12:00' ELSE time END AS time FROM occ WHERE venue_id % 4 <> 0 OR slot = 'asr'")
def replace_by_source(spark, d):
    o = A.occurrence(spark, d).select(F.col("venue_id").alias("source_id"), "day", "slot", "time")
    new = o.filter("source_id % 4 = 0 and slot = 'asr'").withColumn("time", F.lit("12:00"))
    return state.replace_by_source(o, new, o.select("source_id").distinct().filter("source_id % 4 = 0"))


@query(f"WITH {SRC} SELECT source_id, CASE WHEN source_id % 6 = 0 THEN 'needs_reauthor' ELSE status END AS status, CASE WHEN source_id % 6 = 0 AND source_id % 4 = 0 THEN 'x' ELSE url END AS url FROM src")
def coalesce_update(spark, d):
    s = A.source(spark, d).select("source_id", "status", "url")
    change = s.filter("source_id % 6 = 0").select("source_id", F.lit("needs_reauthor").alias("status"), F.expr("if(source_id % 4 = 0, 'x', null)").alias("url"))
    return state.coalesce_update(s, change, "source_id")
