"""Quality gates: one verdict a source from grouped checks of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAILY, minutes, time_values

# Minutes of the day within which each slot may lie, inclusive.
WINDOWS = {"fajr": (30, 450), "dhuhr": (690, 900), "asr": (780, 1230), "maghrib": (930, 1350), "isha": (1020, 1439), "jumuah": (720, 900)}


def slot_order(slot: Column) -> Column:
    """Place of a slot in the day, from 1; 0 for others."""
    return F.array_position(F.array(*map(F.lit, DAILY)), slot)


def in_window(row: DataFrame) -> DataFrame:
    """`row` with `plausible`: its time lies in the slot's window."""
    m, chain = minutes(F.col("time")), F
    for slot, (low, high) in WINDOWS.items():
        chain = chain.when(F.col("slot") == slot, m.between(low, high))
    return row.withColumn("plausible", F.coalesce(chain.otherwise(F.lit(False)), F.lit(False)))


def monotonic(row: DataFrame) -> DataFrame:
    """(source_id, day, monotonic): the daily slots' times do not fall in the order of the day."""
    daily = row.filter(F.col("slot").isin(*DAILY)).select("source_id", "day", "slot", minutes(F.col("time")).alias("m"))
    before = F.lag("m").over(Window.partitionBy("source_id", "day").orderBy(slot_order(F.col("slot"))))
    return daily.withColumn("ok", F.coalesce(F.col("m") >= before, F.lit(True))).groupBy("source_id", "day").agg(F.bool_and("ok").alias("monotonic"))


def sessions(row: DataFrame) -> DataFrame:
    """(source_id, day, sessions, ordered): one to four weekly sessions, strictly later each, in their window."""
    weekly = row.filter(F.col("slot") == "jumuah").withColumn("m", minutes(F.col("time")))
    before = F.lag("m").over(Window.partitionBy("source_id", "day").orderBy("session"))
    low, high = WINDOWS["jumuah"]
    ok = F.coalesce(F.col("m") > before, F.lit(True)) & F.col("m").between(low, high)
    return weekly.withColumn("ok", ok).groupBy("source_id", "day").agg(F.count("*").alias("sessions"), (F.bool_and("ok") & (F.count("*") <= 4)).alias("ordered"))


def missing_slots(row: DataFrame) -> DataFrame:
    """(source_id, missing): names of daily slots that some day lacks, sorted."""
    day = row.groupBy("source_id", "day").agg(F.collect_set("slot").alias("have"))
    lack = day.withColumn("lack", F.array_except(F.array(*map(F.lit, DAILY)), "have"))
    return lack.groupBy("source_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lack")))).alias("missing"))


def constant_columns(row: DataFrame, days: int = 7) -> DataFrame:
    """(source_id, constant): a week or more, no begin anywhere, and every daily slot at one time."""
    daily = row.filter(F.col("slot").isin(*DAILY))
    one = daily.groupBy("source_id", "slot").agg(F.count_distinct("time").alias("times"), F.count("begin").alias("begins"))
    slots = one.groupBy("source_id").agg((F.count_if(F.col("times") == 1) == len(DAILY)).alias("same"), F.sum("begins").alias("begins"))
    dates = daily.groupBy("source_id").agg(F.count_distinct("day").alias("days"))
    return slots.join(dates, "source_id").select("source_id", (F.col("same") & (F.col("begins") == 0) & (F.col("days") >= days)).alias("constant"))


def self_match(row: DataFrame, text: DataFrame, exempt: Column | None = None) -> DataFrame:
    """(source_id, matched): every time that was not derived stands in the source's text; `text` has source_id, text."""
    known = text.select("source_id", time_values(F.col("text")).alias("values"))
    free = F.col("derived") | (exempt if exempt is not None else F.lit(False))
    both = row.join(known, "source_id", "left").withColumn("ok", free | F.coalesce(F.array_contains("values", F.col("time")), F.lit(False)))
    return both.groupBy("source_id").agg(F.bool_and("ok").alias("matched"))


def lint(config: DataFrame) -> DataFrame:
    """`config` with the list of its problems.

    Columns: shape, columns (array of kind, slot), template, single_day,
    month_sections and, optionally, label_index (the layout with slots down a
    label column, whose columns name no slot).
    """
    label = F.col("label_index").isNotNull() if "label_index" in config.columns else F.lit(False)
    main = F.filter("columns", lambda c: c["kind"] == "jamaah")
    paged, rest = F.col("template").isNotNull(), F.regexp_replace("template", r"\{(?:year|month)(?::0?[0-9]*d)?\}", "")
    checks = [
        F.when(F.col("shape").isin("html_table", "html_repeated") & (F.size("columns") == 0), "no columns"),
        F.when(~label & F.exists(main, lambda c: c["slot"].isNull()), "column without slot"),
        F.when(paged & (F.col("shape") == "rules"), "paging with rules"),
        F.when(paged & F.col("single_day"), "paging with a single day"),
        F.when(paged & label, "paging with a label column"),
        F.when(paged & F.col("month_sections"), "paging with month sections"),
        F.when(paged & ~F.contains("template", F.lit("{month")), "template without month"),
        F.when(paged & rest.rlike("[{}]"), "template cannot be filled"),
    ]
    return config.withColumn("problems", F.array_compact(F.array(*checks)))


def lanes(source: DataFrame, row: DataFrame, text: DataFrame, exempt: Column | None = None) -> DataFrame:
    """(source_id, lane, confidence, reason, flags): the first gate that fails decides.

    `source` has source_id and, optionally, problems (from `lint`).  The rows are
    grouped by source and day, and these by source; times that must stand in the
    text are a set of at most 1,440 a source.  `text` has source_id and text, or
    `values`, the clock times of it.
    """
    values = F.col("values") if "values" in text.columns else time_values(F.col("text"))
    if "problems" not in source.columns:
        source = source.withColumn("problems", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    daily, weekly = F.col("slot").isin(*DAILY), F.col("slot") == "jumuah"
    free = F.col("derived") | (exempt if exempt is not None else F.lit(False))
    bit = F.lit(0)
    for i, s in enumerate(DAILY):
        bit = F.when(F.col("slot") == s, 1 << i).otherwise(bit)
    # HH:MM compares as text, so a slot's range of a day is two aggregates and the order of the day five comparisons
    per_day = in_window(row).groupBy("source_id", "day").agg(
        F.count("*").alias("rows"), F.bool_and("plausible").alias("plausible"), F.count_if(~weekly).alias("daily"), F.count_if(weekly).alias("weekly"), F.count_if(daily & F.col("begin").isNotNull()).alias("begins"),
        F.bit_or(bit).alias("have"), F.collect_set(F.when(~free, F.col("time"))).alias("claimed"),
        *[f(F.when(F.col("slot") == s, F.col("time"))).alias(f"{n}_{s}") for s in DAILY for n, f in (("least", F.min), ("most", F.max))],
    )
    rising, before = F.lit(True), F.lit("")
    for s in DAILY:
        rising &= F.coalesce(F.col(f"least_{s}") >= before, F.lit(True))
        before = F.greatest(before, F.col(f"most_{s}"))
    every = (1 << len(DAILY)) - 1
    constant = [F.coalesce(F.min(f"least_{s}") == F.max(f"most_{s}"), F.lit(False)) for s in DAILY]
    made = per_day.withColumn("rising", rising).groupBy("source_id").agg(
        F.sum("rows").alias("rows"), F.bool_and("plausible").alias("plausible"), F.sum("daily").alias("daily"), F.sum("weekly").alias("weekly"), F.bool_and("rising").alias("monotonic"),
        (F.bit_and(F.when(F.col("daily") > 0, F.col("have"))) != every).alias("incomplete"), F.array_distinct(F.flatten(F.collect_set("claimed"))).alias("claimed"),
        (reduce(lambda a, b: a & b, constant) & (F.sum("begins") == 0) & (F.count_if(F.col("have") > 0) >= 7)).alias("constant"),
    )
    made = made.join(sessions(row).groupBy("source_id").agg(F.bool_and("ordered").alias("ordered")), "source_id", "left").withColumn("ordered", F.coalesce("ordered", F.lit(True)))
    both = source.select("source_id", "problems").join(made, "source_id", "left").join(text.select("source_id", values.alias("values")), "source_id", "left")
    lied = F.size(F.array_except(F.coalesce("claimed", none), F.coalesce("values", none))) > 0
    rules = [
        (F.size("problems") > 0, "reject", 0.0, "lint"), (F.col("rows").isNull(), "reject", 0.0, "no occurrences produced"),
        (~F.col("plausible") | ~F.col("monotonic"), "reject", 0.0, "implausible"), (lied, "reject", 0.0, "self-match failed"),
        (~F.col("ordered"), "reject", 0.0, "jumuah"), (F.col("daily") == 0, "review", 0.5, "only jumuah"),
        (F.coalesce("incomplete", F.lit(False)), "review", 0.7, "incomplete"), (F.coalesce("constant", F.lit(False)), "review", 0.7, "constant"),
    ]
    lane = F.array(*[F.when(c, F.struct(F.lit(x).alias("lane"), F.lit(y).alias("confidence"), F.lit(w).alias("reason"))) for c, x, y, w in rules])
    fine = F.struct(F.lit("auto_accept").alias("lane"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("reason"))
    # the verdict is one value, and what follows reads its fields
    both = both.select("source_id", F.explode(F.array(F.coalesce(F.get(F.array_compact(lane), F.lit(0)), fine))).alias("v"), F.coalesce("weekly", F.lit(0)).alias("weekly"))
    flags = F.when((F.col("v.lane") == "auto_accept") & (F.col("weekly") == 0), F.array(F.lit("jumuah_missing"))).otherwise(none)
    return both.select("source_id", "v.*", flags.alias("flags"))


# Shapes whose cells come from a grid of columns.
GRIDS = ("html_table", "html_repeated", "dom_records")


def authoring_problems(config: DataFrame) -> DataFrame:
    """`config` with the list of what would make its extraction give nothing, worded for whoever wrote it.

    Columns: shape, row_selector, columns (array of kind, slot, index, selector,
    time_index), label_index, date (index, selector), single_day,
    month_sections, template.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    grid, repeated = F.col("shape").isin(*GRIDS), F.col("shape") == "html_repeated"
    columns = F.coalesce("columns", F.array().cast(config.schema["columns"].dataType))

    def of_column(c: Column, k: Column) -> Column:
        who = F.concat(F.lit("column "), k.cast("string"), F.lit(" ("), c["kind"], F.lit(" "), F.coalesce(c["slot"], F.lit("label")), F.lit(")"))
        place = F.when(repeated, F.when(blank(c["selector"]), " needs a selector")).when(c["index"].isNull(), " needs an index from 0").when(c["index"] < 0, " has a negative index")
        return F.array(F.concat(who, place), F.concat(who, F.when(c["time_index"] < 0, " has a negative time index")))

    dated = F.col("date").isNotNull()
    checks = [
        F.when(repeated & blank(F.col("row_selector")), "no row selector"), F.when(F.size(columns) == 0, "no columns"), F.when(F.col("label_index") < 0, "negative label index"),
        F.when(~dated & ~yes("single_day") & ~yes("month_sections") & F.col("template").isNull(), "no date axis"),
        F.when(dated & ~yes("single_day") & ~yes("month_sections") & F.when(repeated, blank(F.col("date.selector"))).otherwise(F.col("date.index").isNull()), "date without its place"),
    ]
    found = F.array_compact(F.concat(F.array(*checks[:2]), F.flatten(F.transform(columns, of_column)), F.array(*checks[2:])))
    return config.withColumn("problems", F.when(grid, found).otherwise(F.array().cast("array<string>")))
