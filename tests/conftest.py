import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def differences(query, sql, spark, sf_dir):
    """Rows of either side that the other doesn't have as often."""
    from collections import Counter

    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    return ours - theirs, theirs - ours
