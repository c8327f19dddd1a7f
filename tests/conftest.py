from __future__ import annotations

import pytest

from weftgraph.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="2", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
