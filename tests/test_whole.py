"""Places over range partitions."""


def test_places_across_ranges(spark):
    from horarium.operators.venues import city_size_places

    rows = [(k * 7 % 101, None if k % 9 == 0 else f"city{k % 4 + k % 3 // 2}") for k in range(101)]
    n = {c: sum(x == c for _, x in rows) for _, c in rows}
    want = [v for v, _ in sorted(rows, key=lambda r: (-n[r[1]], r[0]))]
    got = sorted(city_size_places(spark.createDataFrame(rows, "venue_id long, city string"), 10).collect(), key=lambda r: r.place)
    assert [r.venue_id for r in got] == want and [r.place for r in got] == list(range(1, 102))
