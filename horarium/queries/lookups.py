"""Queries of lookups, work lists, counts, page ranking and review decisions, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups, venues
from ..sources import adapters as A
from .core import OCC, SRC, VENUE
from .evidence import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


@query(f"WITH {VENUE} SELECT venue_id, name, city FROM venue WHERE venue_id = (SELECT min(c_custkey) + 7 FROM customer)")
def point_lookup(spark, d):
    key = A.table(spark, d, "customer").agg(F.min("c_custkey")).first()[0] + 7
    return lookups.lookup(A.venue(spark, d), "venue_id", key).select("venue_id", "name", "city")


_STATES = "CASE o_orderkey % 6 WHEN 0 THEN 'needs_reauthor' WHEN 1 THEN 'deferred_media' WHEN 2 THEN 'candidate' WHEN 3 THEN 'review' WHEN 4 THEN 'authored' ELSE 'excluded' END"


@query(f"SELECT o_orderkey AS source_id, CASE {_STATES} WHEN 'needs_reauthor' THEN 'retry' WHEN 'deferred_media' THEN 'media' WHEN 'candidate' THEN 'extract' ELSE 'decide' END AS list FROM orders WHERE o_orderkey % 6 BETWEEN 1 AND 3 OR o_orderkey % 6 = 0 AND o_orderstatus <> 'F'")
def work_lists(spark, d):
    """What is to be done with every source."""
    source = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.expr(_STATES).alias("status"), F.expr("nullif(o_orderstatus, 'F')").alias("config"))
    return lookups.work_lists(source).filter("list is not null").select("source_id", "list")


@query("SELECT o_orderkey AS source_id, o_orderkey % 4 <> 1 AS known, o_orderkey % 4 > 1 AS usable FROM orders")
def given_websites(spark, d):
    """Sources with an address, and with one that is not blank."""
    site = F.expr("case o_orderkey % 4 when 0 then '' when 1 then null else concat('https://', o_orderkey) end")
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), site.alias("url"))
    return rows.select("source_id", lookups.given_text("url", True).alias("known"), lookups.given_text("url").alias("usable"))


@query(f"WITH {VENUE}, {OCC}, {SRC} SELECT 'venue' AS name, count(*) AS rows FROM venue UNION ALL SELECT 'occurrence', count(*) FROM occ UNION ALL SELECT 'source', count(*) FROM src")
def table_totals(spark, d):
    return lookups.totals(venue=A.venue(spark, d), occurrence=A.occurrence(spark, d), source=A.source(spark, d))


@query(f"WITH {VENUE} SELECT venue_id FROM venue WHERE lng BETWEEN -3.5 AND 0.5 AND lat BETWEEN 51 AND 54 AND sqrt(pow((lng - (-1.5)) * 111.0 * cos(radians(52.5)), 2) + pow((lat - 52.5) * 111.0, 2)) <= 120")
def requested_area(spark, d):
    """Venues of a box and around a spot as requests spell them."""
    found = venues.filter_venues(A.venue(spark, d), bbox=lookups.box_of("-3.5, 51,0.5,54"), near=lookups.spot_of("52.5,-1.5"), radius_km=120.0)
    return found.select("venue_id")


_PAGE = "o_custkey AS host, o_orderkey AS idx, ['generic_table', 'mawaqit', 'dom_grid', 'wp_dpt'][1 + o_orderkey % 4] AS platform, ['auto_accept', 'review', 'reject'][1 + o_orderkey % 3] AS lane, o_orderkey % 5 AS rows"


@query(f"SELECT host, idx, platform, lane, rows FROM (SELECT {_PAGE} FROM orders) WHERE lane <> 'reject' QUALIFY row_number() OVER (PARTITION BY host ORDER BY lane = 'auto_accept' DESC, platform IN ('mawaqit', 'wp_dpt') DESC, rows DESC, idx) = 1")
def best_page(spark, d):
    """Of the pages of each site that verify, the best."""
    of = lambda n, *texts: F.get(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % n).cast("int"))
    rows = A.table(spark, d, "orders").select(F.col("o_custkey").alias("host"), F.col("o_orderkey").alias("idx"), of(4, "generic_table", "mawaqit", "dom_grid", "wp_dpt").alias("platform"), of(3, "auto_accept", "review", "reject").alias("lane"), (F.col("o_orderkey") % 5).alias("rows"))
    return lookups.best_page(rows, "host")


@query("""SELECT o_orderkey AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'excluded' WHEN 1 THEN 'review' ELSE 'review' END AS status, CASE WHEN o_orderkey % 8 = 0 THEN 'rejected by reviewer' WHEN o_orderkey % 4 = 0 THEN 'bad' END AS review_reason, CASE WHEN o_orderkey % 4 = 1 THEN 'new' ELSE o_orderstatus END AS config,
  CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 = 0 THEN 'auto_accept' WHEN o_orderkey % 3 = 0 THEN 'review' ELSE 'reject' END AS lane FROM orders""")
def review_decisions(spark, d):
    """Sources and verdicts after a quarter was rejected, a quarter fixed and a quarter approved."""
    key = F.col("o_orderkey")
    rows = A.table(spark, d, "orders")
    source = rows.select(key.alias("source_id"), F.lit("review").alias("status"), F.lit(None).cast("string").alias("review_reason"), F.col("o_orderstatus").alias("config"))
    decision = rows.filter(key % 4 < 3).select(key.alias("source_id"), F.get(F.array(F.lit("reject"), F.lit("fix"), F.lit("approve")), (key % 4).cast("int")).alias("decision"), F.when(key % 8 > 0, "bad").alias("reason"), F.lit("new").alias("config"))
    verdict = rows.select(key.alias("source_id"), F.when(key % 3 == 0, "review").otherwise("reject").alias("lane"))
    return lookups.review_states(source, decision).join(lookups.accepted(verdict, decision), "source_id")
