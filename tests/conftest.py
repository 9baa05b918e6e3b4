import datetime as dt
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from hourloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    settings = {"spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    session = build_session("tests", "local[8]", 4, settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def hourly(start: str, n: int) -> list[dt.datetime]:
    first = at(start)
    return [first + dt.timedelta(hours=i) for i in range(n)]
