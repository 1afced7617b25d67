import pytest


@pytest.fixture(scope="session", autouse=True)
def cleared(spark):
    """Tables that the operators have written go when the tests are over."""
    yield
    from tessera.llm.shared import cleared

    cleared(spark)
