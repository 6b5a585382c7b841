import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build_session, shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tidemark-tests", "local[4]", 4)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield session
    session.stop()


def vectors_frame(spark, windows: dict[int, np.ndarray]):
    """{window_id: matrix} -> (window_id, post_id, embedding)."""
    rows = [(int(w), f"p{w}_{i}", [float(v) for v in x]) for w, m in windows.items() for i, x in enumerate(m)]
    return spark.createDataFrame(rows, "window_id bigint, post_id string, embedding array<float>")


@pytest.fixture(scope="session")
def frame(spark):
    return lambda windows: vectors_frame(spark, windows)
