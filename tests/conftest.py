import tempfile

import pytest

from fathom.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='spark-')}", "spark.driver.memory": "4g"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
