import pytest

from lotline.llm import common
from tests.conftest import spark  # noqa: F401


@pytest.fixture(scope="session", autouse=True)
def settled(spark):  # noqa: F811
    common.settle(spark)


SF = "/root/testdata/sf0.001"


def docs(spark, rows):  # noqa: F811
    """(doc_id, text) rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, rid string, n int, v long")
