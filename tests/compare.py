"""A query's rows against its SQL's rows in DuckDB, in any order."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted(repr([round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in values)


def compared(spark, connection, query, sql, sf_dir):
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, wanted = query(spark, sf_dir).toPandas(), connection.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    assert _rows(got, columns) == _rows(wanted, columns)
    return True
