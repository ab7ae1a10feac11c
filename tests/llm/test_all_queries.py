"""Every registered corpus query over its whole table: one row for each document or conversation, with the contract's columns."""

import pytest

from horarium.llm.queries import QUERIES

COLUMNS = {
    1: "doc_id held_out score predicted", 2: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 3: "doc_id n_bytes n_removed n_spans kept_sha256",
    4: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 5: "doc_id n_tokens ids_sha256 decoded_sha256", 6: "doc_id start n_tokens ids_crc32",
    7: "doc_id n_shingles component_id", 8: "doc_id", 9: "doc_id held_out score predicted", 10: "doc_id n_words n_hit n_items items_sha256 contaminated",
    11: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", 12: "doc_id n_lines n_dropped kept_sha256", 13: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, sf_dir, name):
    number = int(name[2:].split("_")[0])
    table, key = ("conversations", "conv_id") if number == 11 else ("documents", "doc_id")
    got = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[number].split()) <= set(got.columns)
    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    want = sorted(r[0] for r in (ids.distinct() if number == 11 else ids).collect())
    assert sorted(r[0] for r in got.select(key).collect()) == want
