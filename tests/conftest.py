import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


def rows(df, *order):
    """Rows as dicts, sorted by the named columns."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(str(r[c]) for c in order))
