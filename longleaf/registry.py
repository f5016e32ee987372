"""Registered queries: name to callable, and name to the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longleaf.functions import text as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Token estimates and words of a column `text`, in SQL.
TOKENS = "CASE WHEN text IS NULL THEN 0 ELSE CAST((length(text) + 3 * (length(text) - length(regexp_replace(text, '{u}', '', 'g'))) + 3) // 4 AS BIGINT) END".replace("{u}", T.UNSPACED)
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


def query(sql: str | None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:  # white space is that of Unicode, which the other engine's pattern doesn't mean
            SQL[f.__name__] = sql.replace(r"'\s+'", f"'{T.SPACE}+'").replace(r"'\s'", f"'{T.SPACE}'")
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Bytes of a table's files, as far as its columns are read, for each task of a shuffle of its rows: about a tenth of what their sort needs.
SHARE = 8 << 20


def dealt(rows: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Rows by a key in as many partitions as the tables that they come from ask for, so that a task's memory stays when these grow.

    Small ones are left to the session's number of partitions.
    """
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    n = -(-size // SHARE)
    return rows.repartition(n, key) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
