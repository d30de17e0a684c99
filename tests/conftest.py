import pytest

from leadloom import runtime


@pytest.fixture(scope="session")
def spark():
    s = runtime.session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
