"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.adapters import Model
from razao.catalog.model_sql import with_model

QUERIES: dict[str, Callable[[Model], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, tables: str | None = None, sql: str | None = None):
    """Register a function of the model; ``sql`` runs with the ``tables`` it names."""

    def register(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = with_model(tables, sql) if tables else sql.strip()
        return build

    return register


def iso_text(df: DataFrame) -> DataFrame:
    """Days and instants as ISO text, the form in which results leave the engine."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "date":
            columns.append(F.col(name).cast("string").alias(name))
        elif kind in ("timestamp", "timestamp_ntz"):
            columns.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: iso_text(QUERIES[name](Model(spark, sf_dir)))
