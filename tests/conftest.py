from __future__ import annotations

import datetime as dt
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changefold.schema import ENVELOPE  # noqa: E402
from changefold.session import build_session  # noqa: E402

BASE = dt.datetime(2024, 1, 15, 10, 0, 0, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[*]", shuffle_partitions=8)
    yield session
    session.stop()


def edit_json(
    wiki: str = "enwiki",
    title: str = "Peat bog",
    user: str = "someone",
    bot: bool = False,
    type: str = "edit",
    namespace: int = 0,
    timestamp: int = 1705312800,
    **extra,
) -> str:
    body = {
        "type": type,
        "wiki": wiki,
        "title": title,
        "user": user,
        "bot": bot,
        "timestamp": timestamp,
        "server_name": f"{wiki}.example.org",
        "namespace": namespace,
    }
    body.update(extra)
    return json.dumps(body)


def envelope(spark, records):
    """records: (key, value, seconds after BASE[, partition]) -> envelope DataFrame,
    offsets in list order."""
    rows = []
    for i, rec in enumerate(records):
        key, value, secs = rec[0], rec[1], rec[2]
        part = rec[3] if len(rec) > 3 else 0
        rows.append((key, value, BASE + dt.timedelta(seconds=secs), part, i))
    return spark.createDataFrame(rows, ENVELOPE)


def at(secs: float) -> dt.datetime:
    return BASE + dt.timedelta(seconds=secs)
