from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scenarium.session import build_session  # noqa: E402
from scenarium.storage import sweep  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark() -> Iterator[SparkSession]:
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    sweep(session)
