"""A source's captured documents to rows and a verdict; nothing is fetched.

collect → extract → materialise → gate, for all sources at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import horizon_months
from ..operators.state import coalesce_update, drift_guard
from ..sources.html import cells_of, page_items
from ..sources.scratch import stored
from .extract import extract
from .gates import lanes, sessions
from .materialize import ROW, grid_rows, rule_rows, weekly_rows

# Shapes that are read later, and the state that a lane leads to.
MEDIA = ("image", "pdf")
STATES = {"auto_accept": "authored", "review": "review", "deferred": "deferred_media"}


def documents_of(source: DataFrame, fetched: DataFrame, today: str, days: int) -> DataFrame:
    """(source_id, idx, year, month, html) of all captured documents.

    `source` has url and template: without a template one document, else one a
    month of the horizon.  A source without its (current) document has none.
    """
    from .materialize import expand_pages

    day = F.lit(today).cast("date")
    one = source.filter("template is null").join(fetched, "url").filter("html is not null").select("source_id", F.lit(0).alias("idx"), F.year(day).alias("year"), F.month(day).alias("month"), "html")
    paged = expand_pages(source.filter("template is not null").select("source_id", "template"), fetched, today, days).filter("ok and html is not null")
    return one.unionByName(paged.select("source_id", "idx", "year", "month", "html"))


def materialize(cell: DataFrame, session: DataFrame, rule: DataFrame | None, today: str, days: int) -> DataFrame:
    """Rows of scraped cells, weekly sessions and, for sources that have any, rules."""
    rows = grid_rows(cell, today, days).unionByName(weekly_rows(session, today, days).select(*ROW))
    return rows if rule is None else rows.unionByName(rule_rows(rule, today, days).select(*ROW))


def evaluate(source: DataFrame, document: DataFrame, layout: DataFrame, session: DataFrame, today: str, days: int = 60, rule: DataFrame | None = None, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts): verdicts have source_id, lane, status, confidence, reason and flags.

    `source` has source_id, shape and optionally problems; `layout` source_id and
    the columns of `plans.extract`; `session` as in `weekly_rows`.  A source of
    fewer documents than the horizon has months is flagged; one that is read
    later (an image) needs plausible weekly sessions only.  What is read more
    than once is stored in the shared folder; the tables of record are not touched.
    `cells` (doc, a struct of source_id and idx; table_no, row_no, col_no, text) are the
    stored cells of the documents, where the caller has parsed them.
    """
    document = stored(document, "evaluated-documents")
    keyed = document.withColumn("doc", F.struct("source_id", "idx"))
    cells = stored(cells_of(page_items(keyed, "doc"), "doc"), "evaluated-cells") if cells is None else cells
    of_doc = stored(layout.join(keyed.select("source_id", "doc"), "source_id").drop("source_id"), "evaluated-layouts")
    cell = extract(cells, of_doc, "doc", today, keyed.select("doc", "year", "month"))
    cell = cell.withColumn("source_id", F.col("doc.source_id")).withColumn("seq", F.struct(F.col("doc.idx").alias("idx"), "seq")).drop("doc")
    rows = stored(materialize(cell, session, rule, today, days), "evaluated-rows")
    text = document.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "html"))), lambda d: d["html"]), "\n").alias("text"), F.count("*").alias("documents"))
    return rows, stored(gate(source, rows, text, today, days), "verdicts")


def gate(source: DataFrame, rows: DataFrame, text: DataFrame, today: str, days: int) -> DataFrame:
    """(source_id, lane, confidence, reason, flags, status) of materialised rows.

    `text` has source_id, documents (how many) and text, or the values of its
    clock times.
    """
    media = F.col("shape").isin(*MEDIA)
    gated = lanes(source.filter(~media), rows, text, F.col("slot") == "jumuah").join(text.select("source_id", "documents"), "source_id", "left")
    expected = F.size(horizon_months(F.lit(today).cast("date"), days))
    had = F.col("documents").isNotNull()
    part = F.when(F.col("documents") < expected, F.array(F.lit("partial_horizon"))).otherwise(F.array())
    gated = gated.select(
        "source_id", F.when(had, F.col("lane")).otherwise("reject").alias("lane"), F.when(had, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(had, F.col("reason")).otherwise("empty body").alias("reason"),
        F.when(had, F.concat("flags", part)).otherwise(F.array()).alias("flags"),
    )
    week = sessions(rows).groupBy("source_id").agg(F.bool_and("ordered").alias("ordered"))
    good = F.coalesce("ordered", F.lit(True))
    later = source.filter(media).join(week, "source_id", "left").select("source_id", F.when(good, "deferred").otherwise("reject").alias("lane"), F.lit(0.0).alias("confidence"), F.when(~good, "jumuah").alias("reason"), F.array().cast("array<string>").alias("flags"))
    states = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return gated.unionByName(later).withColumn("status", F.coalesce(states[F.col("lane")], F.lit("needs_reauthor")))


def persist(occurrence: DataFrame, source: DataFrame, rows: DataFrame, verdict: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrence, source) after an evaluation.

    Accepted and deferred sources replace their rows; rejected ones and those
    under review keep what they have.  Flags change with acceptance only.
    """
    taken = verdict.withColumn("lane", F.when(F.col("lane") == "deferred", "auto_accept").otherwise(F.col("lane")))
    change = verdict.select("source_id", "status", F.when(F.col("lane") == "auto_accept", F.to_json("flags")).alias("flags"))
    return drift_guard(occurrence, rows, taken), coalesce_update(source, change, "source_id")
