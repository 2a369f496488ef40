import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def _value(x):
    return round(float(x), 9) if isinstance(x, float) else x


def rows(found) -> list[tuple]:
    return sorted((tuple(_value(x) for x in r) for r in found), key=str)
