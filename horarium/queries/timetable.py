"""Queries of the parsers, materialisation, gates and page relations, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pyudfs, scalars as S
from ..operators import state, tables, venues
from ..operators.ranking import last_wins
from ..plans import gates, materialize
from ..sources import adapters as A
from ..sources import html
from ..sources.scratch import spread
from ..sources.seeds import read_hosts
from .core import MIN, OCC, ORACLE_SQL, ORDER, QUERIES, SLOTS, SRC, VENUE, query

__all__ = ["ORACLE_SQL", "QUERIES"]

HM = "printf('%02d:%02d', {0}, {1})"
NOON = "CASE WHEN h BETWEEN 1 AND 11 THEN h + 12 ELSE h END"
GATED = f"g AS (SELECT venue_id, day, slot, time, {MIN.format('time')} AS m FROM occ)"
LIMITS = "w(slot, lo, hi) AS (VALUES ('fajr', 30, 450), ('dhuhr', 690, 900), ('asr', 780, 1230), ('maghrib', 930, 1350), ('isha', 1020, 1439))"


def _rows(spark, d):
    """Occurrences as candidate rows of sources."""
    return A.occurrence(spark, d).select(F.col("venue_id").alias("source_id"), "day", "slot", "session", "time", "begin", F.lit(None).cast("string").alias("label"), F.lit(False).alias("derived"))


@query(f"SELECT event_id, {HM.format('hour(ts)', 'minute(ts)')} AS plain, {HM.format('hour(ts)', 'minute(ts)')} AS marked, {HM.format('CASE WHEN hour(ts) BETWEEN 1 AND 11 THEN hour(ts) + 12 ELSE hour(ts) END', 'minute(ts)')} AS evening FROM events")
def parse_time(spark, d):
    e = spread(A.table(spark, d, "events"))
    return e.select("event_id", S.parse_time(F.date_format("ts", "H.mm")).alias("plain"), S.parse_time(F.date_format("ts", "h:mm a")).alias("marked"), S.parse_time(F.date_format("ts", "'at 'H : mm"), F.lit(True)).alias("evening"))


@query(f"SELECT event_id, {HM.format('hour(ts)', 'minute(ts)')} || ',' || {HM.format('minute(ts) % 24', 'second(ts)')} AS times FROM events")
def parse_times(spark, d):
    text = F.concat_ws(" ", F.date_format("ts", "H:mm"), F.lit("99:99"), F.format_string("%d.%02d", F.minute("ts") % 24, F.second("ts")))
    return A.table(spark, d, "events").select("event_id", F.array_join(S.parse_times(text), ",").alias("times"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN -CAST(l_quantity AS INT) ELSE CAST(l_quantity AS INT) END AS minutes FROM lineitem")
def parse_offset(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_linenumber") % 4 == 0, q).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("−"), q)).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit(" +"), q, F.lit(" min."))).otherwise(F.concat(q, F.lit(" Minutes")))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.parse_offset(text).alias("minutes"))


@query("SELECT event_id, CAST(ts AS DATE) AS iso, CAST(ts AS DATE) AS slashed, make_date(2025, month(ts), least(day(ts), 28)) AS worded, make_date(2025, 3, least(day(ts), 28)) AS bare FROM events")
def parse_date(spark, d):
    e = spread(A.table(spark, d, "events")).withColumn("k", F.least(F.dayofmonth("ts"), F.lit(28)))
    year = F.lit(2025)
    worded = F.concat_ws(" ", F.col("k").cast("string"), F.date_format("ts", "MMMM"))
    return e.select("event_id", S.parse_date(F.date_format("ts", "yyyy-MM-dd"), year).alias("iso"), S.parse_date(F.date_format("ts", "d/M/yyyy"), year).alias("slashed"), S.parse_date(worded, year).alias("worded"), S.parse_date(F.concat_ws(" ", F.lit("Mon"), F.col("k").cast("string")), year, F.lit(3)).alias("bare"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'fajr' WHEN 'click' THEN 'dhuhr' WHEN 'signup' THEN 'asr' WHEN 'purchase' THEN 'maghrib' ELSE 'isha' END AS name, event_type = 'view' AS fuzzy FROM events")
def resolve_token(spark, d):
    e = A.table(spark, d, "events").withColumn("token", F.expr("case event_type when 'view' then 'Fajrr' when 'click' then 'Zuhr' when 'signup' then 'ASR time' when 'purchase' then 'magh-rib maghrib' else '‘Ishā’' end"))
    return pyudfs.resolve_tokens(e.select("event_id", "token"), "token").select("event_id", "name", "fuzzy")


@query(f"WITH {OCC} SELECT venue_id, day, slot, CASE WHEN {MIN.format('time')} + 90 < 1440 THEN printf('%02d:%02d', CAST(({MIN.format('time')} + 90) // 60 AS INT), CAST(({MIN.format('time')} + 90) % 60 AS INT)) END AS later FROM occ")
def apply_offset(spark, d):
    return A.occurrence(spark, d).select("venue_id", "day", "slot", S.apply_offset(F.col("time"), F.lit(90)).alias("later"))


@query(f"WITH {OCC}, x AS (SELECT DISTINCT day FROM occ) SELECT day, CAST(unnest(generate_series(date_trunc('month', day), date_trunc('month', day + 60), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM x")
def months_in_horizon(spark, d):
    return A.occurrence(spark, d).select("day").distinct().select("day", F.explode(S.horizon_months(F.col("day"), 60)).alias("month_start"))


@query(f"WITH {OCC} SELECT DISTINCT day, CASE WHEN month(day) BETWEEN 4 AND 9 THEN 'summer' ELSE 'winter' END AS season FROM occ WHERE isodow(day) = 5")
def fridays(spark, d):
    days = A.occurrence(spark, d).select("day").distinct()
    return days.filter(S.is_friday(F.col("day"))).select("day", S.season(F.col("day")).alias("season"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"))


_HINTS = " + ".join(f"CASE WHEN contains(lower(url), '{h}') THEN 2 ELSE 0 END" for h in S.MEDIA_HINTS)


@query(f"SELECT page_id, CAST({_HINTS} + CASE WHEN regexp_matches(lower(url), '\\b20[0-9][0-9]\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '\\b({'|'.join((*S.MONTHS, *(m[:3] for m in S.MONTHS), 'sept'))})\\b') THEN 1 ELSE 0 END AS DOUBLE) AS score FROM pages")
def media_score(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.media_score(F.col("url")).alias("score"))


@query(f"WITH {OCC} SELECT venue_id, day, max(time) AS main, CASE WHEN count(DISTINCT time) >= 2 THEN min(time) END AS begin FROM occ GROUP BY 1, 2")
def assign_times(spark, d):
    g = A.occurrence(spark, d).groupBy("venue_id", "day").agg(F.collect_list("time").alias("times"))
    return g.select("venue_id", "day", S.assign_times(F.col("times")).alias("t")).select("venue_id", "day", "t.main", "t.begin")


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'lint' WHEN 2 THEN 'zero_rows' WHEN 3 THEN 'self_match' WHEN 4 THEN 'plausibility' WHEN 5 THEN 'incomplete' WHEN 6 THEN 'invalid_schema' ELSE 'unknown' END AS failure FROM orders")
def classify_failure(spark, d):
    texts = ["reply has No JSON object", "lint: no columns", "no occurrences produced", "self-match failed for 3", "missing Jumuah rows", "missing: asr", "invalid config: x", "else"]
    text = F.get(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % 8).cast("int"))
    return A.table(spark, d, "orders").select("o_orderkey", S.classify_failure(text).alias("failure"))


@query(f"WITH {OCC} SELECT venue_id, day, slot, time FROM occ")
def unpivot_columns(spark, d):
    from ..operators.venues import day_pivot

    return tables.wide_to_long(day_pivot(A.occurrence(spark, d)), SLOTS)


@query("SELECT event_id, key, json_extract_string(props, '$.\"' || key || '\"') AS entry FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL)")
def json_calendar(spark, d):
    e = A.table(spark, d, "events").filter("props is not null")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "entry"))


@query("WITH t AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2) SELECT user_id, event_type AS region FROM t WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY days DESC, event_type) = 1")
def richest_region(spark, d):
    t = A.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct(F.col("ts").cast("date")).alias("days")).filter("n >= 2")
    return t.groupBy("user_id").agg(F.min(F.struct(-F.col("days"), "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("region"))


@query()
def keyword_links(spark, d):
    pages = A.table(spark, d, "pages")
    links = html.anchors(pages, "page_id").join(pages.select("page_id", "url"), "page_id").withColumn("target", pyudfs.absolute_url("url", "href"))
    links = links.withColumn("host", S.url_host(F.col("target"))).filter((F.col("host") == S.url_host(F.col("url"))) & S.has_keyword(F.concat_ws(" ", "href", "text")))
    return venues.blocked(links, read_hosts(spark)).filter("not blocked").groupBy("page_id", "target").agg(F.min("ordinal").alias("ordinal"))


@query()
def visible_text(spark, d):
    return html.visible_text(A.table(spark, d, "pages"), "page_id")


@query("SELECT user_id, event_type AS hint, value AS strength FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def max_by_hint(spark, d):
    e = A.table(spark, d, "events").filter("value is not null")
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("value", -F.col("event_id"))).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("hint"), F.col("b.value").alias("strength"))


@query(f"""WITH c AS (SELECT user_id AS source_id, event_id AS seq, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 'fajr' WHEN 'click' THEN 'dhuhr' WHEN 'signup' THEN 'asr' WHEN 'purchase' THEN 'maghrib' ELSE 'isha' END AS slot, event_id % 3 AS k, strftime(ts, '%H:%M') AS t, CAST(event_id % 20 AS INT) AS o FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-23'),
 s AS (SELECT source_id, day, slot, max_by(t, seq) FILTER (WHERE k = 0) AS begin, max_by(t, seq) FILTER (WHERE k = 1) AS time, max_by(o, seq) FILTER (WHERE k = 2) AS o FROM c GROUP BY 1, 2, 3),
 r AS (SELECT source_id, day, slot, begin, time IS NULL AS derived, coalesce(time, CASE WHEN {MIN.format('begin')} + o < 1440 THEN printf('%02d:%02d', CAST(({MIN.format('begin')} + o) // 60 AS INT), CAST(({MIN.format('begin')} + o) % 60 AS INT)) END) AS time FROM s)
 SELECT * FROM r WHERE time IS NOT NULL""")
def materialize_grid(spark, d):
    e = A.table(spark, d, "events")
    slot = F.expr("case event_type when 'view' then 'fajr' when 'click' then 'dhuhr' when 'signup' then 'asr' when 'purchase' then 'maghrib' else 'isha' end")
    cell = e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("day"), slot.alias("slot"), F.expr("if(event_id % 3 = 0, 'begin', 'jamaah')").alias("kind"), F.expr("if(event_id % 3 < 2, date_format(ts, 'HH:mm'), null)").alias("time"), F.expr("if(event_id % 3 = 2, cast(event_id % 20 as int), null)").alias("offset")).withColumn("base_slot", F.col("slot"))
    return materialize.grid_rows(cell, "2024-01-03", 20).select("source_id", "day", "slot", "begin", "derived", "time")


@query(f"WITH {SRC}, f AS (SELECT CAST(unnest(generate_series(DATE '2024-03-01', DATE '2024-03-01' + 60, INTERVAL 1 DAY)) AS DATE) AS day) SELECT source_id, day, k AS session, CASE k WHEN 1 THEN '13:15' ELSE '14:00' END AS time FROM src, f, (SELECT unnest([1, 3]) AS k) WHERE isodow(day) = 5")
def materialize_fridays(spark, d):
    texts = spark.createDataFrame([(1, "13:15"), (2, "after zuhr"), (3, "2.00 pm")], "idx int, text string")
    session = A.source(spark, d).select("source_id").join(F.broadcast(texts)).select("source_id", "idx", F.lit(None).cast("string").alias("label"), "text", F.lit(None).cast("string").alias("season"))
    return materialize.weekly_rows(session, "2024-03-01", 60).select("source_id", "day", "session", "time")


@query(f"WITH {SRC}, f AS (SELECT CAST(unnest(generate_series(DATE '2024-03-01', DATE '2024-03-01' + 30, INTERVAL 1 DAY)) AS DATE) AS day) SELECT source_id, day, slot, time FROM src, f, (VALUES ('dhuhr', '13:30'), ('maghrib', '18:10')) v(slot, time)")
def materialize_rules(spark, d):
    rules = spark.createDataFrame([("dhuhr", "1:30", None), ("maghrib", None, 10), ("isha", None, 5)], "slot string, fixed string, offset int")
    rule = A.source(spark, d).select("source_id").join(F.broadcast(rules))
    begins = rule.filter("slot = 'maghrib'").select("source_id", F.explode(S.horizon_days(F.lit("2024-03-01").cast("date"), 30)).alias("day"), "slot", F.lit("18:00").alias("begin"))
    return materialize.rule_rows(rule, "2024-03-01", 30, begins).select("source_id", "day", "slot", "time")


@query(f"WITH {SRC} SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 'no columns' WHEN source_id % 3 = 1 THEN 'column without slot,template without month' ELSE '' END AS problems FROM src")
def lint(spark, d):
    columns = F.when(F.col("source_id") % 3 == 0, F.array().cast("array<struct<kind:string,slot:string>>")).when(F.col("source_id") % 3 == 1, F.array(F.struct(F.lit("jamaah").alias("kind"), F.lit(None).cast("string").alias("slot")))).otherwise(F.array(F.struct(F.lit("jamaah").alias("kind"), F.lit("asr").alias("slot"))))
    config = A.source(spark, d).select("source_id", F.lit("html_table").alias("shape"), columns.alias("columns"), F.expr("if(source_id % 3 = 1, 'https://x.example/{year}', null)").alias("template"), F.lit(False).alias("single_day"), F.lit(False).alias("month_sections"))
    return gates.lint(config).select("source_id", F.array_join("problems", ",").alias("problems"))


@query(f"WITH {OCC}, {GATED}, {LIMITS} SELECT venue_id AS source_id, day, slot, m BETWEEN lo AND hi AS plausible FROM g JOIN w USING (slot)")
def gate_window(spark, d):
    return gates.in_window(_rows(spark, d)).select("source_id", "day", "slot", "plausible")


@query(f"WITH {OCC}, {GATED}, l AS (SELECT venue_id, day, coalesce(m >= lag(m) OVER (PARTITION BY venue_id, day ORDER BY {ORDER}), true) AS ok FROM g) SELECT venue_id AS source_id, day, bool_and(ok) AS monotonic FROM l GROUP BY 1, 2")
def gate_monotonic(spark, d):
    return gates.monotonic(_rows(spark, d))


@query(f"WITH {OCC}, {GATED}, r AS (SELECT venue_id, day, m, row_number() OVER (PARTITION BY venue_id, day ORDER BY {ORDER}) AS session FROM g), l AS (SELECT *, coalesce(m > lag(m) OVER (PARTITION BY venue_id, day ORDER BY session), true) AND m BETWEEN 720 AND 900 AS ok FROM r) SELECT venue_id AS source_id, day, count(*) AS sessions, bool_and(ok) AND count(*) <= 4 AS ordered FROM l GROUP BY 1, 2")
def gate_sessions(spark, d):
    from pyspark.sql import Window

    rows = _rows(spark, d)
    k = F.row_number().over(Window.partitionBy("source_id", "day").orderBy(gates.slot_order(F.col("slot"))))
    return gates.sessions(rows.withColumn("session", k).withColumn("slot", F.lit("jumuah")))


@query(f"WITH {OCC} SELECT a.venue_id AS source_id, bool_and(NOT starts_with(a.time, '13') OR b.time IS NOT NULL) AS matched FROM occ a LEFT JOIN (SELECT DISTINCT venue_id, time FROM occ) b ON b.venue_id = a.venue_id AND b.time = '01' || substr(a.time, 3) GROUP BY 1")
def gate_selfmatch(spark, d):
    rows = _rows(spark, d)
    text = rows.filter("not startswith(time, '13')").groupBy("source_id").agg(F.array_join(F.collect_list("time"), " ").alias("text"))
    return gates.self_match(rows, text)


@query(f"WITH {OCC}, s(slot) AS (VALUES ('fajr'), ('dhuhr'), ('asr'), ('maghrib'), ('isha')), x AS (SELECT DISTINCT venue_id, day FROM occ), m AS (SELECT DISTINCT venue_id, slot FROM x, s WHERE NOT EXISTS (SELECT 1 FROM occ o WHERE o.venue_id = x.venue_id AND o.day = x.day AND o.slot = s.slot)) SELECT v.venue_id AS source_id, coalesce(string_agg(slot, ',' ORDER BY slot), '') AS missing FROM (SELECT DISTINCT venue_id FROM occ) v LEFT JOIN m USING (venue_id) GROUP BY 1")
def gate_missing(spark, d):
    return gates.missing_slots(_rows(spark, d)).select("source_id", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {OCC} SELECT venue_id AS source_id, venue_id % 2 = 0 AND count(DISTINCT slot) = 5 AND count(DISTINCT day) >= 7 AS constant FROM occ GROUP BY 1")
def gate_constant(spark, d):
    rows = _rows(spark, d).withColumn("time", F.expr("if(source_id % 2 = 0, '12:00', concat(lpad(cast(day(day) % 24 as string), 2, '0'), ':00'))"))
    return gates.constant_columns(rows)


@query(f"WITH {OCC}, {GATED}, {LIMITS}, p AS (SELECT venue_id, bool_and(m BETWEEN lo AND hi) AS ok FROM g JOIN w USING (slot) GROUP BY 1) SELECT v.venue_id AS source_id, CASE WHEN p.venue_id IS NULL OR NOT ok THEN 'reject' ELSE 'review' END AS lane, CASE WHEN p.venue_id IS NULL THEN 'no occurrences produced' WHEN NOT ok THEN 'implausible' ELSE 'incomplete' END AS reason FROM (SELECT c_custkey AS venue_id FROM customer) v LEFT JOIN p USING (venue_id)")
def gate_lane(spark, d):
    rows = _rows(spark, d)
    text = rows.groupBy("source_id").agg(F.array_join(F.collect_set("time"), " ").alias("text"))
    sources = A.venue(spark, d).select(F.col("venue_id").alias("source_id"))
    return gates.lanes(sources, rows, text).select("source_id", "lane", "reason")


@query(f"WITH {OCC} SELECT venue_id AS source_id, day, slot, CASE WHEN venue_id % 3 = 0 THEN '12:00' ELSE time END AS time FROM occ WHERE venue_id % 3 <> 0 OR slot = 'asr'")
def drift_guard(spark, d):
    old = _rows(spark, d).select("source_id", "day", "slot", "time")
    verdict = old.select("source_id").distinct().withColumn("lane", F.expr("case source_id % 3 when 0 then 'auto_accept' when 1 then 'review' else 'reject' end"))
    return state.drift_guard(old, old.filter("slot = 'asr'").withColumn("time", F.lit("12:00")), verdict)


@query(f"WITH {SRC} SELECT source_id, CASE WHEN venue_id % 10 = 0 AND status IN ('candidate', 'review') THEN 'review' ELSE status END AS status, CASE WHEN venue_id % 10 = 0 AND status IN ('candidate', 'review') THEN 'shared_url: twin' END AS review_reason FROM src")
def curation_flag(spark, d):
    shared = A.venue(spark, d).filter("venue_id % 10 = 0").select("venue_id", F.lit("twin").alias("reason"))
    return state.flag_shared_urls(A.source(spark, d), shared).select("source_id", "status", "review_reason")


@query("SELECT CASE WHEN page_id % 3 = 0 THEN 'dead' WHEN page_id % 3 = 1 THEN 'repaired' ELSE 'unchanged' END AS outcome, count(*) AS n FROM pages GROUP BY 1")
def website_triage(spark, d):
    pages = A.table(spark, d, "pages").select("page_id", F.concat_ws("#", "url", "page_id").alias("website"))
    probe = pages.select(F.col("website").alias("url"), F.expr("if(page_id % 3 = 0, 404, 200)").alias("status"), F.expr("if(page_id % 3 = 1, concat(website, '/new'), website)").alias("final_url"))
    return state.website_triage(pages, probe).groupBy("outcome").agg(F.count("*").alias("n"))
