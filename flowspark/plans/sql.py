"""SQL text over named tables."""

from __future__ import annotations


from pyspark.sql import DataFrame


def run_sql(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run SQL over temp views. Result columns get back the spelling they have in the tables."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)
    spelling = {c.lower(): c for df in tables.values() for c in df.columns}
    return out.toDF(*[spelling.get(c.lower(), c) for c in out.columns])


# Scalar functions callable by name inside SQL text.
FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION Long2Date(ms BIGINT) RETURNS DATE RETURN CAST(timestamp_millis(ms) AS DATE)",
    "CREATE OR REPLACE TEMPORARY FUNCTION Date2Long(ts TIMESTAMP) RETURNS BIGINT RETURN coalesce(unix_millis(ts), 0L)",
    """CREATE OR REPLACE TEMPORARY FUNCTION LikeEnds(s STRING, p STRING) RETURNS BOOLEAN RETURN CASE
       WHEN length(p) > 1 AND startswith(p, '%') AND endswith(p, '%') THEN contains(s, substring(p, 2, length(p) - 2))
       WHEN startswith(p, '%') THEN endswith(s, substring(p, 2))
       WHEN endswith(p, '%') THEN startswith(s, substring(p, 1, length(p) - 1)) ELSE s = p END""",
)


def register_functions(spark) -> None:
    for statement in FUNCTIONS:
        spark.sql(statement)
