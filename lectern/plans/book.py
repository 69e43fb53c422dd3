"""A book of queries: each is entered under its name, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.standins import SQL


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, plain: bool = False) -> Callable:
        """Enter the decorated f(spark, root). sql reads the stand-in tables unless plain."""

        def enter(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                # the stand-ins are a WITH list: a query with tables of its own continues it
                text = sql.strip()
                self.oracles[name] = text if plain else SQL + ("," + text[5:] if text.startswith("with ") else text)
            return f

        return enter


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})
