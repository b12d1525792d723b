import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sourceloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column over a list of single values, in order."""
    from pyspark.sql import functions as F

    def run(make, items, kind="string"):
        rows = spark.createDataFrame(list(enumerate(items)), f"i int, v {kind}")
        return [r["out"] for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def plan_of(frame) -> str:
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
