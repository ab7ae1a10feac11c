"""Point lookups, work lists, counts, request values, page ranking and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import coalesce_update

# The classes of what a page verifies to, and the plug-ins that know no provider.
LANES = {"auto_accept": 2, "review": 1, "deferred": 0}
GENERIC = ("generic_table", "dom_grid", "dom_records")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, if there is one; the comparison reaches the scan."""
    return table.filter(F.col(key) == F.lit(value))


def given_text(column: str, blank_is_given: bool = False) -> Column:
    """Whether a text is there: not null and, unless allowed, not empty."""
    return F.col(column).isNotNull() & (F.lit(blank_is_given) | (F.col(column) != ""))


def work_lists(source: DataFrame) -> DataFrame:
    """`source` (status, config) with list: what is to be done with a source, null if nothing.

    Retries of sources to author again that still have a layout, media to read
    later, candidates to extract and decisions to take.
    """
    retry = (F.col("status") == "needs_reauthor") & F.col("config").isNotNull()
    name = F.when(retry, "retry").when(F.col("status") == "deferred_media", "media").when(F.col("status") == "candidate", "extract").when(F.col("status") == "review", "decide")
    return source.withColumn("list", name)


def floats(text: str | None, n: int, form: str) -> tuple[float, ...] | None:
    """`n` numbers parted by commas; anything else is an error that names the form."""
    if text is None:
        return None
    try:
        parts = tuple(float(x) for x in text.split(","))
    except ValueError:
        parts = ()
    if len(parts) != n:
        raise ValueError(f"expected {form}")
    return parts


def box_of(text: str | None) -> tuple[float, ...] | None:
    return floats(text, 4, "min_lng,min_lat,max_lng,max_lat")


def spot_of(text: str | None) -> tuple[float, ...] | None:
    return floats(text, 2, "lat,lng")


def totals(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table: one count each, none of the rows travels."""
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, t in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def best_page(verified: DataFrame, by: str) -> DataFrame:
    """The best page of each group: (by, idx, platform, lane, rows).

    `verified` has by, idx (its place), platform, lane and rows.  Lane, then a
    plug-in for one provider, then rows, then the earlier page; lanes that do not
    pass are left out.
    """
    lanes = F.create_map(*[F.lit(x) for pair in LANES.items() for x in pair])
    passed = verified.filter(F.col("lane").isin(*LANES))
    rank = F.struct(lanes[F.col("lane")], (~F.col("platform").isin(*GENERIC)).cast("int"), "rows", -F.col("idx"))
    return passed.groupBy(by).agg(F.max_by(F.struct("idx", "platform", "lane", "rows"), rank).alias("b")).select(by, "b.*")


def review_states(source: DataFrame, decision: DataFrame) -> DataFrame:
    """`source` (source_id, status, review_reason, config) after decisions (source_id, decision, reason, config).

    reject excludes and says why; fix puts a new layout in place and leaves the
    source in review; approve changes nothing here: its evaluation is taken in
    with `accepted`.
    """
    change = decision.filter("decision in ('reject', 'fix')").select(
        "source_id", F.when(F.col("decision") == "reject", "excluded").otherwise("review").alias("status"),
        F.when(F.col("decision") == "reject", F.coalesce("reason", F.lit("rejected by reviewer"))).alias("review_reason"), F.when(F.col("decision") == "fix", F.col("config")).alias("config"),
    )
    return coalesce_update(source, change, "source_id")


def accepted(verdict: DataFrame, decision: DataFrame) -> DataFrame:
    """`verdict` (source_id, lane, ...) in which approved sources under review count as accepted."""
    yes = decision.filter("decision = 'approve'").select("source_id", F.lit(True).alias("__yes"))
    both = verdict.join(yes, "source_id", "left")
    return both.withColumn("lane", F.when(F.col("__yes") & (F.col("lane") == "review"), "auto_accept").otherwise(F.col("lane"))).drop("__yes")
