"""op12 against plain Python, and its runs."""

import hashlib
from collections import defaultdict

from horarium.llm import line_runs
from horarium.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {a: a + 32 for a in range(65, 91)}


def brute(rows):
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for d, ls in lines:
        for x in ls:
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    order = lambda d: (d is not None, d or 0)
    owner = {k: max(v, key=order) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, ls in lines:
        kept = [x for x in ls if key(x) not in owner or owner[key(x)] == d]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = _got(QUERIES["op12_line_runs"](spark, sf_dir))
    assert got == brute(rows) and sum(x[2] for x in got)


def test_odd_texts(spark, docs):
    common, near, wide = "A common Line of TWENTY+ marks", " \ta common line of twenty+ marks\x0b\r", "ÄÖÜ " * 6
    rows = [(k, "\n".join([common if k % 2 else near, f"own {k}", "short", wide if k < 4 else "", common])) for k in range(100, 120)]
    rows += [(k, common) for k in range(3)] + [(5, common + "\n\n")] * 2 + [(5, near)]
    rows += [(None, common + "\nx"), (None, None), (7, None), (8, ""), (9, "\n\n"), (10, wide + "\n" + wide)]
    rows += [(k, "two documents hold this line only") for k in (200, 201)] + [(300, ("line %d of a very long text\n" * 1) % 1 + "\n".join(f"a line of a long text, number {j}" for j in range(5000)))] * 2
    rows += [(k, "\n".join(f"a line of a long text, number {j}" for j in range(0, 5000, 3))) for k in (301, 302)]
    df = spark.createDataFrame([(d, t, "en", 1, True, 5, 0.5) for d, t in rows], docs.schema)
    want = brute(rows)
    assert _got(line_runs.report(df)) == want
    assert _got(line_runs.report(df, batches=7, buckets=3)) == want
    assert _got(line_runs.report(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, empty):
    assert line_runs.report(empty).collect() == []


def test_runs_are_levels_that_meet_without_a_shuffle(spark):
    runs = line_runs.LineRuns(spark, 4)
    sizes = []
    for batch in range(6):
        lines = spark.range(1000 * batch, 1000 * batch + 1500).selectExpr("id + 10000 as doc_id", "xxhash64(id) as h1", "id as h2")
        runs.add(lines)
        sizes.append([level for level, *_ in runs.levels])
    assert sizes == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]
    assert sum(spark.table(name).count() for _, name, _ in runs.levels) == 6500  # each key is in one run
    left, right = spark.table(runs.levels[0][1]), spark.table(runs.levels[1][1]).select("h1", "h2")
    assert "Exchange" not in left.join(right.hint("merge"), ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    assert runs.decisions(2).count() == 2500 and runs.decisions(3).count() == 0
    runs.close()
    assert not any(t.name.startswith("line_run_") for t in spark.catalog.listTables())


def test_main_path_is_native(spark, docs):
    plan = line_runs.drop_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
