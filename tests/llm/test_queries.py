"""The registered queries: columns and types of their results, and those that SQL can say."""

import pytest

from lattica.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, same

COLUMNS = {
    "op1_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_tokens": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op11_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_collocations": {"lang": "string", "phrase": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")},
    "op13_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    got = dict(QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    assert {c: got.get(c) for c in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    assert same(QUERIES[name](spark, sf), connection(sf), ORACLE_SQL[name]) > 0
