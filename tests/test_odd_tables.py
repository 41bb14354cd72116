"""Queries agree with their SQL on tables with rows that the small data lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import difference

from srcgraph import catalog

catalog.load()

TEXTS = ["", None, " ", "\n", "x" * 160, "x" * 161, "a" * 81 + " " + "b" * 100, "\U0001f600" * 200 + " end"]
TABLES = {
    "documents": {"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS},
    "conversations": {
        "conv_id": pa.array(range(len(TEXTS)), pa.int64()),
        "turn": pa.array([0] * len(TEXTS), pa.int32()),
        "role": ["user"] * len(TEXTS),
        "text": TEXTS,
    },
}


@pytest.mark.parametrize("name, source", [("answer_chunks", "documents"), ("event_sequence", "conversations")])
def test_empty_texts_have_the_pieces_of_the_sql(spark, tmp_path, name, source):
    pq.write_table(pa.table(TABLES[source]), tmp_path / f"{source}.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {source} AS SELECT * FROM '{tmp_path}/{source}.parquet'")
    assert difference(spark, connection, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name]) is None
