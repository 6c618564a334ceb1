import pytest

from folioscope.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Builds a frame from a DDL schema and tuples."""

    def build(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return build


@pytest.fixture
def one(spark):
    """Evaluates one expression on literal columns a, b, .."""

    def run(expr, *values):
        from pyspark.sql import functions as F

        cols = [F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]) for v in values]
        return spark.range(1).select(expr(*cols).alias("v")).first()["v"]

    return run
