import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def llm(spark):
    from ledgerlens.llm.common import ready

    ready(spark)
    return spark


@pytest.fixture(scope="session")
def documents():
    """The small documents table as Python rows."""
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def docs_frame(spark, rows, partitions=3):
    """A documents table with a clashing extra column from (doc_id, text) rows."""
    data = [(i, t, "en", "s", 0, "x", 1) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep string, run int"
    return spark.createDataFrame(data, schema).repartition(partitions)
