"""Compare a query with its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def differences(spark, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(row[c]) for c in columns)) for row in df.collect()))
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for path in glob.glob(f"{SF}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in found.fetchall())
    return [x for x in got if x not in want][:3], [x for x in want if x not in got][:3], len(got) - len(want)
