import pytest


@pytest.fixture(autouse=True)
def pii_key(spark):
    """A key for surrogates, which have none by default."""
    spark.conf.set("spark.tickloom.pii.key", "of the tests")
    yield
    spark.conf.unset("spark.tickloom.pii.key")
