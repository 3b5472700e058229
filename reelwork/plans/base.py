"""Registration of the queries: a name, the views it reads, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelwork.sources.views import common_tables, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of the views' DataFrames under a name.

    sql continues the WITH clause of the views: a SELECT, or ', more AS (...) SELECT'.
    """

    def add(function: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(*[view(spark, sf_dir, v) for v in views])
            return out.withColumns({c: out[c].cast("long") for c, kind in out.dtypes if kind == "int"})

        QUERIES[name] = run
        if sql:
            ORACLE[name] = f"{common_tables(list(views))}\n{sql.strip()}"
        return function

    return add
