import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcast.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Series frame from ``{key: (first day, frequency, values)}``."""
    def build(series):
        rows = []
        for key, (first, freq, values) in series.items():
            for ds, y in zip(pd.date_range(first, periods=len(values), freq=freq), values):
                rows.append((key, ds.date(), None if y is None else float(y)))
        return spark.createDataFrame(rows, "series_key string, ds date, y double")

    return build


@pytest.fixture(scope="session")
def values():
    """Values per key in time order."""
    def read(df, column="y"):
        pdf = df.toPandas().sort_values(["series_key", "ds"])
        return {k: g[column].tolist() for k, g in pdf.groupby("series_key")}

    return read
