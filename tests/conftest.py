from __future__ import annotations

import pytest

from sonagrid.session import build, share_code


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.default.parallelism": "4", "spark.sql.maxMetadataStringLength": "2000"})
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    yield session
    session.stop()
