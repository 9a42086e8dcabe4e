"""Compare a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def rows_of(frame):
    """Rows with columns by name, floats rounded, sorted."""
    names = sorted(frame.columns)
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = rows_of(con.execute(sql).df()), rows_of(query(spark, sf_dir).toPandas())
    return want == got, want, got
