import datetime as dt
from decimal import Decimal

import pytest

from tallyspark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted (NULL first)."""
    data = [tuple(r) for r in df.collect()]
    return sorted(data, key=lambda r: tuple((v is not None, v if not isinstance(v, (list, dict)) else str(v)) for v in r))


def money(text):
    return Decimal(text)


def day(text):
    return dt.date.fromisoformat(text)
