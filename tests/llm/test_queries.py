"""The registered queries: their columns and types, the rows they hold, and what the driver derives from ids."""

import zlib

import pytest

import __spark_entry__ as entry
from inkstone.llm import queries

TYPES = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "text_sha256": "string"},
    "op5_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op11_fill_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op12_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_best_fit": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}
#: The remainder of an id's crc32 that is held out of training, and what it divides by.
HELD_OUT = {"op1_language_id": (4, 2), "op9_toxicity": (5, 0)}


def test_all_queries_are_registered():
    assert set(queries.queries()) == set(TYPES) and set(TYPES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(TYPES))
def test_query(name, spark, data, texts):
    out = queries.queries()[name](spark, data)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in TYPES[name]} == TYPES[name]
    rows = out.collect()
    if "doc_id" in types and name not in ("op3_packing", "op13_best_fit"):
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    if name in HELD_OUT:
        by, due = HELD_OUT[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % by == due) and 0 <= r["score"] <= 1 for r in rows)
        assert 0 < sum(r["held_out"] for r in rows) < len(rows)
    if name == "op8_quality":
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    if name == "op6_neighbours":
        known = {r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
        assert {r["query_id"] for r in rows} == {v for v in known if v % 20 == 0} and all(r["vec_id"] != r["query_id"] for r in rows)
        assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, k) for q in sorted({r["query_id"] for r in rows}) for k in range(1, 21)]
