from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from waymark.session import local_session  # noqa: E402

DATA = Path(os.environ.get("WAYMARK_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def small() -> str:
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test data")
    return str(folder)


def rows(df, *columns: str) -> list[tuple]:
    """Sorted rows of ``df`` as tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
