import pytest


@pytest.fixture
def docs(spark):
    """Documents with columns whose names operators use inside."""

    def build(*rows):
        data = [(i, t, "src", "a", 1, "b", 2.0, 3, "c") for i, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, source string, id string, row int, `key` string, ratio double, n_words int, `odd.name x` string")

    return build
