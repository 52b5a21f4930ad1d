import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from seqwatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session(8, "tests", spark__checkpoint__dir=f"file:{folder}", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate an expression over a column ``v`` holding the given values."""

    def run(items, kind, expression):
        frame = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"i int, v {kind}")
        rows = frame.select("i", expression(F.col("v")).alias("result")).orderBy("i").collect()
        return [row.result for row in rows]

    return run
