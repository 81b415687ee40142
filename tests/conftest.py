import pytest

from loomcat.session import get_spark


# Columns can only be built with a session, and some tests build them while being collected.
SPARK = get_spark("loomcat-tests", cores=4)
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions over rows of one text column ``x`` (and more columns if given)."""

    def evaluate(rows, schema, *columns):
        out = spark.createDataFrame(rows, schema).select(*columns).collect()
        return [tuple(r) if len(columns) > 1 else r[0] for r in out]

    return evaluate
