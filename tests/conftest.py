import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sheetmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "tests", 4, "4g")


@pytest.fixture(scope="session")
def rows():
    """The rows of a DataFrame as sorted tuples of its columns in order."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
