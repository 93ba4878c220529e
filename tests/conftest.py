import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

RATING_SCHEMA = "user_id int, item_id int, rating double"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ranksmith-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ratings(spark):
    """60 users, 40 items, about 900 ratings with a few pairs rated twice, from a fixed seed."""
    rng = np.random.default_rng(7)
    taste, trait = rng.normal(size=(60, 3)), rng.normal(size=(40, 3))
    rows = []
    for user in range(60):
        for item in rng.choice(40, size=15, replace=False):
            value = float(np.clip(np.round(5.5 + 2 * taste[user] @ trait[item]), 1, 10))
            rows.append((user, int(item) + 100, value))
            if rng.random() < 0.05:
                rows.append((user, int(item) + 100, max(1.0, value - 1)))
    return spark.createDataFrame(rows, RATING_SCHEMA).cache()


@pytest.fixture(scope="session")
def catalog(spark):
    """Items 100 to 139 by type in turn; 139 has none, 140 was never rated."""
    types = ["TV", "Movie", "OVA"]
    rows = [(i, f"Title {i}", f"題名 {i}", types[i % 3]) for i in range(100, 139)]
    rows += [(139, "Untyped", "無", None), (140, "Unrated", "無", "TV")]
    return spark.createDataFrame(rows, "ID int, Name string, `Japanese name` string, Type string").cache()


@pytest.fixture(scope="session")
def model(ratings):
    from ranksmith.operators import fit_als

    return fit_als(ratings)


@pytest.fixture(scope="session")
def factors(model):
    """User and item factors as dicts of numpy vectors."""

    def load(table):
        return {r["id"]: np.array(r["features"], dtype=np.float64) for r in table.collect()}

    return load(model.user_factors), load(model.item_factors)
