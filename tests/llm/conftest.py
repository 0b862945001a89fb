import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use themselves."""

    def make(rows, columns=("doc_id", "text")):
        schema = StructType([StructField(columns[0], LongType()), StructField(columns[1], StringType()), StructField("score", StringType()), StructField("key", StringType()), StructField("n", StringType())])
        return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello  world\n"), (4, "Hello  world\n"), (None, "The of and to is that was"), (5, "über x" * 20_000), (6, "a▁b <|endoftext|> <s> 漢字 \U0001f600"), (7, "Der die und das ist nicht ein")]


@pytest.fixture(scope="session")
def odd():
    return ODD
