import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def people_frame():
    """100 rows: two duplicate rows, three missing ages, three extreme salaries."""
    rng = np.random.default_rng(42)
    n = 100
    frame = pd.DataFrame({
        "id": np.arange(1, n + 1),
        "name": [f"User_{i}" for i in range(1, n + 1)],
        "age": rng.integers(18, 65, n).astype(float),
        "salary": rng.normal(50000, 10000, n),
        "gender": rng.choice(["Male", "Female", None], n, p=[0.45, 0.45, 0.10]),
        "date": pd.date_range("2026-01-01", periods=n),
    })
    frame.loc[[10, 25, 50], "age"] = np.nan
    frame.loc[5, "salary"], frame.loc[15, "salary"], frame.loc[50, "salary"] = 150000.0, -5000.0, 200000.0
    frame.loc[30] = frame.loc[20]
    frame.loc[40] = frame.loc[20]
    return frame


@pytest.fixture(scope="session")
def people(spark, people_frame):
    rows = [
        (int(r.id), r.name_, None if pd.isna(r.age) else float(r.age), float(r.salary), r.gender,
         r.date.to_pydatetime())
        for r in people_frame.rename(columns={"name": "name_"}).itertuples()
    ]
    return spark.createDataFrame(
        rows, "id long, name string, age double, salary double, gender string, date timestamp"
    ).cache()


@pytest.fixture(scope="session")
def data_folder():
    return DATA
