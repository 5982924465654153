"""Compares registered queries with their SQL in DuckDB."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    tell = lambda v: "-" if v is None or v != v else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(tell, r)) for r in frame.itertuples(index=False))


def mismatch(spark, sf_dir, query, sql):
    with duckdb.connect() as c:
        for t in TABLES:
            if Path(f"{sf_dir}/{t}.parquet").exists():
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        theirs = c.sql(sql).df()
    ours = query(spark, sf_dir).toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    return [x for x in zip(a, b) if x[0] != x[1]][:3]
