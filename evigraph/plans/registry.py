"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.sources.standin import VIEWS, table, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable:
    """Register a function of the named tables' frames, and SQL over the same names."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(*(table(spark, sf_dir, t) for t in tables))
        if sql is not None:
            views = [t for t in tables if t in VIEWS]
            body = sql.strip()
            if views and body[:15].upper() == "WITH RECURSIVE ":
                body = f"WITH RECURSIVE {view_sql(*views)[5:]}, {body[15:]}"
            elif views and body[:5].upper() == "WITH ":
                body = f"{view_sql(*views)}, {body[5:]}"
            elif views:
                body = f"{view_sql(*views)} {body}"
            ORACLE_SQL[name] = body
        return build

    return register
