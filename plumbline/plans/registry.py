"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", ctes: str = ""):
    """Register fn(v: Views) -> DataFrame under `name`.

    `sql` is the DuckDB twin. `views` names the derived views it reads (their
    definitions are prepended); `ctes` holds further WITH members.
    """

    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql, ctes)
        return fn

    return wrap
