"""Small frames of chunks, and comparison with DuckDB."""

import pandas as pd

from promptsift.schema import as_chunks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def chunks(spark, rows):
    """rows: dicts with any of a chunk's columns; one request, numbered in order, unless they say otherwise."""
    names = ("request_id", "pos", "text", "kind", "source", "tier", "severity", "relevance")
    kinds = "request_id string, pos long, text string, kind string, source string, tier int, severity string, relevance double"
    plain = {"request_id": "r", "kind": "text", "source": "s", "tier": 1}
    full = [plain | {"pos": k} | row for k, row in enumerate(rows)]
    return as_chunks(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], kinds))


def asked(spark, query, request="r"):
    return spark.createDataFrame([(request, query)], "request_id string, query string")


def canonical(frame):
    def cell(v):
        if pd.isna(v):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return float(round(v, 6))
        return float(v) if hasattr(v, "__index__") else str(v)

    return sorted((tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=str)


def duck(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()
