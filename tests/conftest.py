import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hustings.session import get_spark

    shared = str(tmp_path_factory.mktemp("shared"))
    session = get_spark("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(map(tuple, picked.collect()), key=str)
