"""Comparing a registered query with its SQL check."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def check_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare_query(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None if both sides agree, else a description of the first difference."""
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {d[0]: str(d[1]).lower() for d in result.description}
    alike = {"string": "varchar", "int": "integer", "timestamp_ntz": "timestamp"}
    off = {n: (alike.get(kinds[n], kinds[n]), duck[n]) for n in names
           if alike.get(kinds[n], kinds[n]) != duck[n]}
    if off:
        return f"types {off}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lacking = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}; only here {extra}; only there {lacking}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None
