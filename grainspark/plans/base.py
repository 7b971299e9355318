"""A registered query: its Spark form, its SQL, and the columns both return.

``columns`` is a line of names; a mark after a name says how values are compared: ``*`` doubles rounded to 6 places,
``~`` to 2 places, ``#`` whole numbers as bigint, nothing for the value as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None = None

    def _parts(self) -> list[tuple[str, str]]:
        return [(c.rstrip("*~#"), c[-1] if c[-1] in "*~#" else "") for c in self.columns.split()]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for name, mark in self._parts():
            c = F.col(f"`{name}`")
            if mark in ("*", "~"):
                c = F.round(c.cast("double"), 6 if mark == "*" else 2) + F.lit(0.0)
            elif mark == "#":
                c = c.cast("bigint")
            out.append(c.alias(name))
        return self.run(spark, sf_dir).select(*out)

    def oracle(self) -> str:
        out = []
        for name, mark in self._parts():
            q = f'"{name}"'
            if mark in ("*", "~"):
                q = f"round(CAST({q} AS DOUBLE), {6 if mark == '*' else 2}) + 0.0::DOUBLE"
            elif mark == "#":
                q = f"CAST({q} AS BIGINT)"
            out.append(f'{q} AS "{name}"')
        return f"SELECT {', '.join(out)} FROM (\n{self.sql.strip()}\n)"
