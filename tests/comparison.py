"""Compare a Spark result with the rows DuckDB returns for its SQL."""

import duckdb

TABLES = "documents benchmark conversations pages".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(table):
    names = sorted(table.column_names)
    columns = [table[name].to_pylist() for name in names]
    return names, sorted(map(repr, zip(*columns)))


def differences(spark_table, duck_table):
    names, rows = canonical(spark_table)
    expected_names, expected = canonical(duck_table)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    types = [str(spark_table.schema.field(n).type).replace("large_", "") for n in names]
    expected_types = [str(duck_table.schema.field(n).type).replace("large_", "") for n in names]
    if types != expected_types:
        return f"types {list(zip(names, types, expected_types))}"
    if rows != expected:
        extra = sorted(set(rows) - set(expected))[:3]
        missing = sorted(set(expected) - set(rows))[:3]
        return f"{len(rows)} rows, expected {len(expected)}; extra {extra}; missing {missing}"
    return None
