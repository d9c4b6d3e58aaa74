"""Run queries next to their SQL and compare the results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def canonical(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        return x

    return Counter(tuple(value(row[i]) for i in order) for row in rows)


def difference(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else a short description."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = canonical(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    got = canonical(frame.columns, [tuple(row) for row in frame.collect()])
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = {n: (t, types[n]) for n, t in frame.dtypes if pairs.get(t) != types[n]}
    if got != want:
        extra, missing = got - want, want - got
        return f"{sum(got.values())} vs {sum(want.values())} rows; +{str(list(extra)[:2])[:600]} -{str(list(missing)[:2])[:600]}"
    return f"types differ {wrong}" if wrong else None


def main() -> None:
    from docloom import catalog
    from docloom.session import build_session

    directory = sys.argv[1]
    wanted = sys.argv[2:]
    catalog.load()
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    bad = 0
    for name, function in catalog.QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in catalog.CHECKS:
                verdict = difference(function(spark, directory), connection, catalog.CHECKS[name])
            else:
                verdict = None if function(spark, directory).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += verdict is not None
        print(f"{name:22} {time.time() - start:6.2f}s {'sql ' if name in catalog.CHECKS else 'rows'} {verdict or 'ok'}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
