import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_rows():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture
def texts(spark):
    def make(*values, extra=None):
        rows = [(i, v, "x") for i, v in enumerate(values)]
        return spark.createDataFrame(rows, f"doc_id long, text string, {extra or 'note'} string")

    return make
