import glob
import os

import pytest

from lithogrid.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES) and all(isinstance(sql, str) for sql in ORACLES.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found, expected = QUERIES[name](spark, DATA).toPandas(), connection.sql(ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)

    def rows(frame):
        """Null and whole numbers look alike, whatever pandas makes of a column with nulls."""
        def plain(v):
            if v is None or str(v) in ("nan", "<NA>"):
                return None
            return int(v) if isinstance(v, float) and v == int(v) else v

        return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())

    assert rows(found) == rows(expected)


COLUMNS = {
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op7_token_files": "doc_id start n_tokens ids_crc32",
    "op8_html_extract": "page_id url text n_chars",
    "op9_simhash_dedup": "doc_id fingerprint component_id",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op11_setsketch_dedup": "doc_id n_shingles component_id kept",
    "op12_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}
OTHER_ROWS = ("op2_packing", "op12_prefix_trie", "op13_hard_negatives")
LONG = ("n_shingles depth n_convs n_children n_leaves saved_tokens positive_score negative_score "
        "start length ids_crc32 doc_tokens sequence_id offset n_words n_base first_word last_word group_size n_tokens n_chars")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows_are_those_asked_for(spark, name):
    found = QUERIES[name](spark, DATA)
    types = dict(found.dtypes)
    assert set(COLUMNS[name].split()) <= set(types)
    assert all(types[c] == "bigint" for c in LONG.split() if c in types)
    assert types.get("score", "double") == "double" and types.get("predicted", "int") == types.get("rank", "int") == "int"
    rows = spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()
    assert found.count() == rows or name in OTHER_ROWS
