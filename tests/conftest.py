from __future__ import annotations

import pytest

from rowmill.session import forget, local_session, prepare


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", 4)
    s.conf.set("spark.sql.adaptive.enabled", "true")
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    forget(s)
    s.stop()
