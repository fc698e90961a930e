"""Compare a registered query with its SQL twin, value by value."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return (type(value).__name__, value) if isinstance(value, bool) else value


def rows_of(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in place], Counter(
        tuple(_plain(row[i]) for i in place) for row in rows
    )


def differences(spark, con, run, sql, sf_dir) -> str | None:
    """None if equal, else a short description."""
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        return None
    only_got, only_want = got - want, want - got
    return (
        f"rows {sum(got.values())} vs {sum(want.values())}; "
        f"spark only {sorted(map(str, only_got))[:2]}; sql only {sorted(map(str, only_want))[:2]}"
    )
