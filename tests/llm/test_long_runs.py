"""Long benchmark runs are cut from long documents that they hardly cover."""

from horarium.llm import decontaminate


def test_long_runs_are_cut(spark):
    item = [f"i{k}" for k in range(60)]
    rest = [f"r{k}" for k in range(2000)]
    texts = [" ".join(rest[:900] + item[:n] + rest[900:]) for n in (60, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got[0].split() == rest and got[1] == texts[1]
