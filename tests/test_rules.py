"""Rules meet the begins of their slot before they are repeated for every day."""

from horarium.plans import materialize


def test_days_are_not_joined(spark):
    """Two begins of one day give two rows, days without one none; nothing is joined by day."""
    rule = spark.createDataFrame([(1, "isha", None, 5), (1, "fajr", "12:30", None), (2, "isha", None, 5)], "source_id int, slot string, fixed string, offset int")
    begins = spark.createDataFrame([(1, "2024-03-02", "isha", "18:57"), (1, "2024-03-02", "isha", "19:00"), (1, "2024-04-09", "isha", "1:00")], "source_id int, day string, slot string, begin string").selectExpr("source_id", "cast(day as date) as day", "slot", "begin")
    rows = materialize.rule_rows(rule, "2024-03-01", 2, begins)
    assert sorted((r.source_id, r.day.day, r.slot, r.time, r.begin) for r in rows.collect()) == [(1, 1, "fajr", "00:30", None), (1, 2, "fajr", "00:30", None), (1, 2, "isha", "19:02", "18:57"), (1, 2, "isha", "19:05", "19:00"), (1, 3, "fajr", "00:30", None)]
    joins = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("day#" in line for line in joins)
