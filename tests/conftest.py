"""A small Spark session for all tests. Generated code is off: these tests check results on small tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from emberlog.session import local_session

    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    session = local_session(4, 2, "3g", **quick)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
