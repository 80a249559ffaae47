"""Registered queries: a Spark function and, where there is one, the SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import Tables

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name."""

    def add(function: Callable[[Tables], DataFrame]):
        if name in RUN:
            raise ValueError(f"query {name} is registered twice")
        RUN[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return function

    return add
