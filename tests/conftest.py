import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from borefield.session import configure

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def plain(value):
    """Values of either engine in one form."""
    if value is None or type(value).__name__ in ("NAType", "NaTType") or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if isinstance(value, int | float) or type(value).__module__ == "numpy":
        return repr(float(value) + 0.0)
    return str(value)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)), key=lambda r: [(v is None, v or "") for v in r])


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return con
