"""JDBC: incremental range reads, append, upsert. Works with any driver on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _relation(table_or_sql: str) -> str:
    return f"({table_or_sql}) src" if table_or_sql.lstrip().lower().startswith("select") else table_or_sql


def bounds(spark: SparkSession, url: str, table_or_sql: str, column: str, options: dict | None = None):
    """Lowest and highest value of the range column, asked in the database."""
    probe = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {_relation(table_or_sql)}) b"
    row = spark.read.format("jdbc").options(url=url, dbtable=probe, **(options or {})).load().first()
    return row[0], row[1]


def _literal(value) -> str:
    if isinstance(value, (int, float)):
        return str(value)
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f") if hasattr(value, "strftime") else str(value)
    return f"TIMESTAMP('{text}')" if hasattr(value, "strftime") else "'" + text.replace("'", "''") + "'"


def range_predicates(column: str, start, end, step=None, max_parts: int = 10_000) -> list[str]:
    """One `column > a AND column <= b` per step window, from start to end without gaps.

    A step is a number of units, or of seconds for times. Steps are widened when there would be
    more than `max_parts` of them, so the list stays small; no row is left out.
    """
    from datetime import datetime, timedelta

    wide = timedelta(seconds=step) if isinstance(start, datetime) and step else step
    if wide and (end - start) / wide > max_parts:
        wide = (end - start) / max_parts
    out, at = [], start
    while wide and at + wide < end:
        out.append(f"{column} > {_literal(at)} AND {column} <= {_literal(at + wide)}")
        at = at + wide
    out.append(f"{column} > {_literal(at)} AND {column} <= {_literal(end)}")
    return out


def range_read(spark: SparkSession, url: str, table_or_sql: str, column: str, start=None, end=None, step=None,
               options: dict | None = None, max_parts: int = 10_000) -> DataFrame:
    """Rows with `column > start AND column <= end`, one predicate (and task) per step window.

    Missing ends are asked in the database first; without a start the lowest row belongs to the result.
    """
    first = None
    if start is None or end is None:
        low, high = bounds(spark, url, table_or_sql, column, options)
        end = high if end is None else end
        if start is None:
            start, first = low, low
    predicates = ["1 = 0"] if start is None or end is None else range_predicates(column, start, end, step, max_parts)
    if first is not None:
        predicates.insert(0, f"{column} = {_literal(first)}")
    df = spark.read.jdbc(url, _relation(table_or_sql), predicates=predicates, properties=options or {})
    return plain_numbers(df)


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as double, or as long when they have no fraction."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            col = col.cast("long" if f.dataType.scale == 0 else "double").alias(f.name)
        out.append(col)
    return df.select(*out)


def append(df: DataFrame, url: str, table: str, columns: dict[str, str], options: dict | None = None) -> None:
    """Append the declared columns (name -> SQL type); the table is made when it is absent."""
    kept = df.select(*[c for c in columns if c in df.columns])
    ddl = ", ".join(f"{c} {columns[c]}" for c in kept.columns)
    kept.write.option("createTableColumnTypes", ddl).jdbc(url, table, mode="append", properties=options or {})


def append_routed(df: DataFrame, url: str, name: str, columns: dict[str, str], options: dict | None = None,
                  max_tables: int = 1000) -> list[str]:
    """Append each row to the table named in column `name`. Table names are few by nature; more
    than `max_tables` of them is taken for a wrong template."""
    names = [r[0] for r in df.select(name).distinct().limit(max_tables + 1).collect()]
    if len(names) > max_tables:
        raise ValueError(f"more than {max_tables} table names in {name}")
    for table in names:
        append(df.where(F.col(name) == table), url, table, columns, options)
    return names


def merge_statement(table: str, staging: str, names: list[str], key: list[str]) -> str:
    on = " AND ".join(f'd."{k}" = s."{k}"' for k in key)
    update = ", ".join(f'd."{c}" = s."{c}"' for c in names if c not in key)
    matched = f"WHEN MATCHED THEN UPDATE SET {update} " if update else ""
    insert = ", ".join(f'"{c}"' for c in names)
    values = ", ".join(f's."{c}"' for c in names)
    return f"MERGE INTO {table} d USING {staging} s ON {on} {matched}WHEN NOT MATCHED THEN INSERT ({insert}) VALUES ({values})"


def upsert(df: DataFrame, url: str, table: str, key: list[str], staging: str, columns: dict[str, str],
           options: dict | None = None) -> None:
    """Insert or update by key: rows go to a staging table in parallel, then one MERGE in the database."""
    kept = df.select(*[c for c in columns if c in df.columns])
    ddl = ", ".join(f"{c} {columns[c]}" for c in kept.columns)
    kept.write.option("createTableColumnTypes", ddl).jdbc(url, staging, mode="overwrite", properties=options or {})
    jvm = df.sparkSession.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for name, value in (options or {}).items():
        properties.setProperty(name, str(value))
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        statement = connection.createStatement()
        statement.executeUpdate(merge_statement(table, staging, kept.columns, key))
        statement.close()
    finally:
        connection.close()
