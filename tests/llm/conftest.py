import pytest

from tests.llm.data import SCHEMA, frame, saved


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("llm") / "docs", frame(spark))


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("llm") / "none", spark.createDataFrame([], SCHEMA))
