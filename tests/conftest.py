import pytest

from pairloom.session import builder


@pytest.fixture(scope="session")
def spark():
    s = (
        builder("tests", "local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        # keep small shuffles in 8 pieces, so that keys do cross chunk borders
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.pairloom.textTasks", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
