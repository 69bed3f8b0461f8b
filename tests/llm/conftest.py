import glob

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, token string, rid long"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "One two"), (5, "One two"), (6, "one TWO"), (None, "lost id"), (7, "x" * 5000), (8, "  lead and trail  "),
    (9, "tab\tand\nfeed  two spaces"), (10, "é è <|endoftext|> \x01 中文 😀 ́x"), (11, "mail me@a.example.org +49 30 1234567 10.0.0.300 10.0.0.1 4111 1111 1111 1111"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, long and repeated texts, with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, None, None, None, "fp", "key", "token", 7) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sf_rows():
    return pq.read_table(glob.glob(f"{SF}/documents.parquet")[0]).to_pylist()
