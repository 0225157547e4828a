from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.local.dir": str(out / "local"), "spark.sql.warehouse.dir": str(out / "warehouse"), "spark.checkpoint.dir": f"file://{out}/shared", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a form in which Spark's and DuckDB's values compare."""
    def one(x):
        if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
            return "null"
        return str(x) if isinstance(x, (str, bytes, bool)) or hasattr(x, "isoformat") else repr(round(float(x), 9))

    columns = sorted(frame.columns)
    return sorted(tuple(map(one, row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def oracle():
    def run(sql: str, sf: str) -> pd.DataFrame:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
        return con.execute(sql).df()

    return run
