import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The shared folder of the tests' session."""
    from tracewright.llm.shared import shared_dir

    return shared_dir(spark)
