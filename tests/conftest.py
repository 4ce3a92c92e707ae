from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.join(ROOT, "tests", "llm")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pairloom.session import local_session

    session = local_session(
        "4", "4", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.driver.memory": "4g"}
    )
    yield session
    session.stop()
