"""State changes as pure functions from old tables to new ones; writing is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the key, nulls included; the rest stays."""
    return new.select(old.columns).unionByName(old.join(new.select(key), key, "left_anti"))


def coalesce_update(old: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Only non-null values of `change` overwrite; keys that `old` lacks are ignored."""
    fields = [c for c in change.columns if c != key]
    both = old.join(change.select(key, *[F.col(c).alias(f"__{c}") for c in fields]), key, "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def replace_by_source(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """All rows of the given sources are dropped and the new ones added."""
    return old.join(sources.select("source_id"), "source_id", "left_anti").unionByName(new)


def drift_guard(old: DataFrame, candidate: DataFrame, verdict: DataFrame) -> DataFrame:
    """Candidates of accepted sources replace their rows; every other source keeps what it has."""
    accepted = verdict.filter(F.col("lane") == "auto_accept").select("source_id")
    return replace_by_source(old, candidate.join(accepted, "source_id", "left_semi"), accepted)


def merge_rows(occurrence: DataFrame, pairs: DataFrame) -> DataFrame:
    """Occurrences after venues were merged; `pairs` has dropped and survivor.

    A dropped venue's row goes if the survivor, or a dropped venue of smaller id,
    has its day, slot and session.
    """
    moved = occurrence.join(pairs.withColumnRenamed("dropped", "venue_id"), "venue_id", "left")
    moved = moved.withColumn("__own", F.coalesce("survivor", "venue_id"))
    best = moved.groupBy("__own", "day", "slot", "session").agg(F.min_by(F.struct(*occurrence.columns), F.struct(F.col("survivor").isNotNull(), "venue_id")).alias("r"))
    return best.select(*[F.col("__own").alias(c) if c == "venue_id" else F.col(f"r.{c}").alias(c) for c in occurrence.columns])


def merge_venues(venue: DataFrame, source: DataFrame, occurrence: DataFrame, run: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """All four tables after merges; pairs whose venues are not both there change nothing, so a second run is the same.

    Dropped venues, their sources and the runs of these go; occurrences of these
    sources stay without a source.
    """
    ids = venue.select("venue_id")
    pairs = pairs.join(ids.withColumnRenamed("venue_id", "dropped"), "dropped", "left_semi").join(ids.withColumnRenamed("venue_id", "survivor"), "survivor", "left_semi")
    gone = pairs.select(F.col("dropped").alias("venue_id"))
    lost = source.join(gone, "venue_id", "left_semi").select("source_id").withColumn("__lost", F.lit(True))
    named = pairs.join(venue.withColumnRenamed("venue_id", "dropped"), "dropped").select("survivor", F.col("dropped").alias("ordinal"), "name", "aliases")
    freed = occurrence.join(lost, "source_id", "left").withColumn("source_id", F.when(F.col("__lost").isNull(), F.col("source_id"))).select(occurrence.columns)
    return {
        "venue": merge_aliases(venue.join(gone, "venue_id", "left_anti"), named).select(venue.columns),
        "source": source.join(gone, "venue_id", "left_anti").select(source.columns),
        "occurrence": merge_rows(freed, pairs.select("dropped", "survivor")),
        "run": run.join(lost, "source_id", "left_anti").select(run.columns),
    }


def merge_aliases(survivor: DataFrame, dropped: DataFrame) -> DataFrame:
    """Survivors with the names and aliases of the venues they take over, in order, without their own name.

    `dropped` has survivor, ordinal, name, aliases.
    """
    more = dropped.groupBy("survivor").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.concat(F.array("name"), F.coalesce("aliases", F.array())).alias("names")))).alias("m"))
    both = survivor.join(more.withColumnRenamed("survivor", "venue_id"), "venue_id", "left")
    names = F.concat(F.coalesce("aliases", F.array()), F.coalesce(F.flatten(F.col("m.names")), F.array()))
    kept = F.filter(F.array_distinct(names), lambda x: x.isNotNull() & (x != "") & (x != F.col("name")))
    return both.withColumn("aliases", kept).drop("m")


def flag_shared_urls(source: DataFrame, shared: DataFrame) -> DataFrame:
    """Sources of venues that share a URL go to review, unless they are past it; `shared` has venue_id and reason."""
    both = source.join(shared.select("venue_id", F.col("reason").alias("__reason")), "venue_id", "left")
    hit = F.col("__reason").isNotNull() & F.col("status").isin("candidate", "review", "blocklisted")
    out = both.withColumn("review_reason", F.when(hit, F.concat(F.lit("shared_url: "), "__reason")).otherwise(F.col("review_reason")))
    return out.withColumn("status", F.when(hit, "review").otherwise(F.col("status"))).drop("__reason")


def website_triage(venue: DataFrame, probe: DataFrame) -> DataFrame:
    """Dead sites become null, moved ones are repaired; `probe` has url, status, final_url."""
    both = venue.join(probe.withColumnRenamed("url", "website"), "website", "left")
    alive = F.col("status").between(200, 399)
    outcome = F.when(F.col("website").isNull(), "none").when(~F.coalesce(alive, F.lit(False)), "dead").when(F.col("final_url") != F.col("website"), "repaired").otherwise("unchanged")
    out = both.withColumn("outcome", outcome)
    return out.withColumn("website", F.when(F.col("outcome") == "repaired", F.col("final_url")).when(F.col("outcome") != "dead", F.col("website"))).select(*venue.columns, "outcome")
