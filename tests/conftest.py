"""One local session for all tests; comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1]) + os.pathsep + os.environ.get("PYTHONPATH", "")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("MESHLARK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    import datetime
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return v


def same_rows(df, con, sql: str) -> None:
    """Equal columns, row counts and values, whatever the order of rows."""
    rel = con.execute(sql)
    theirs_cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(theirs_cols)
    order = sorted(theirs_cols)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [theirs_cols.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
