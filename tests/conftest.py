import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("heatsheet-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark, tmp_path_factory):
    """The sample competition, loaded from CSV with the declared schemas and kept as parquet."""
    import seed_rows

    from heatsheet import schemas
    from heatsheet.sources import tables

    folder = tmp_path_factory.mktemp("seed")
    for name, text in seed_rows.TABLES.items():
        path = folder / f"{name}.csv"
        path.write_text(text)
        loaded = tables.read_csv(spark, str(path), schemas.TABLES[name])
        tables.overwrite(loaded, str(folder / "db"), name)
    return {n: tables.read_parquet(spark, str(folder / "db"), n) for n in schemas.TABLES}


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    changed = {}

    def set_option(name, value):
        changed.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield set_option
    for name, value in changed.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)
