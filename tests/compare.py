"""Runs reports against their SQL twins: same columns, same rows in any order."""

from __future__ import annotations

import sys
import time

import duckdb

seconds = {"spark": 0.0}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


_KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "varchar", "boolean": "boolean", "date": "date"}


def differences(spark_df, con, sql: str) -> list[str]:
    """Human-readable differences between a DataFrame and a query; empty when they agree."""
    relation = con.sql(sql)
    kinds = {c: str(t).lower().replace("bigint", "int64").replace("integer", "int32") for c, t in zip(relation.columns, relation.types)}
    found = []
    if sorted(spark_df.columns) != sorted(relation.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}"]
    for name, kind in spark_df.dtypes:
        if _KINDS.get(kind, kind) != kinds[name]:
            found.append(f"type of {name}: {kind} != {kinds[name]}")
    start = time.time()
    ours = spark_df.toArrow()
    seconds["spark"] = time.time() - start
    con.register("ours", ours)
    con.execute(f"CREATE OR REPLACE TEMP TABLE theirs AS {sql}")
    names = ", ".join(f'"{c}"' for c in sorted(spark_df.columns))
    sizes = [con.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("ours", "theirs")]
    if sizes[0] != sizes[1]:
        found.append(f"rows {sizes[0]} != {sizes[1]}")
    for here, there in (("ours", "theirs"), ("theirs", "ours")):
        extra = con.sql(f"SELECT {names} FROM {here} EXCEPT ALL SELECT {names} FROM {there}")
        rows = extra.limit(3).fetchall()
        if rows:
            found.append(f"only in {here} ({len(extra.fetchall())} of {sizes[0]}): {rows[0]}")
    for name, kind in spark_df.dtypes:
        if kind == "double":
            signs = [con.sql(f"""SELECT count(*) FROM {t} WHERE CAST("{name}" AS VARCHAR) = '-0.0' OR isnan("{name}")""").fetchall()[0][0] for t in ("ours", "theirs")]
            if any(signs):
                found.append(f"negative zero or NaN in {name}: {signs}")
    con.unregister("ours")
    return found


def main(folder: str, wanted: list[str]) -> int:
    from demandgrid.plans import REPORTS
    from demandgrid.session import build_session
    from demandgrid.sources.driver_tables import driver_star

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__sql__execution__arrow__pyspark__enabled="true",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name, report in REPORTS.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = report.build(driver_star(spark, folder))
            notes = differences(df, con, report.sql) if report.sql else [] if df.toPandas().shape[0] else ["no rows"]
        except Exception as error:  # a report that cannot run is reported, the rest still run
            notes = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(notes)
        print(f"{'FAIL' if notes else 'ok  '} {name} {time.time() - start:.2f}s spark {seconds["spark"]:.2f}s {'; '.join(notes)}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
