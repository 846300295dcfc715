import os
import sys

import pytest

_TESTS = os.path.dirname(os.path.abspath(__file__))
_ROOT = os.path.dirname(_TESTS)
sys.path.insert(0, _ROOT)
# Python workers start from the JVM's environment: let them import the test
# modules (providers defined in tests) and the package.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [_ROOT, _TESTS] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])


@pytest.fixture(scope="session")
def spark():
    from docquill.session import get_spark
    import tempfile
    s = get_spark("local[4]", shuffle_partitions=4, app_name="docquill-tests",
                  conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="docquill-warehouse-"),
                        "spark.driver.memory": "8g"})
    yield s
    s.stop()


def one(spark, col, value, schema="t string"):
    """Evaluate a column expression on a single-row frame."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("r")).first()["r"]


SMOKE = "/root/testdata/sf0.001"
