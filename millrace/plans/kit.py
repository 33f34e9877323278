"""Small written tables, and given tables whose rows take them on, for queries whose every branch the driver's tables don't reach."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import table


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Rows:
    """A named table of literal rows: `df` for Spark, `cte` for SQL."""

    name: str
    schema: str
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([*self.rows], self.schema)

    @property
    def cte(self) -> str:
        body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(_names(self.schema))}) AS (VALUES {body})"

    def over(self, source: str, key: str, every: bool = False, **columns: str) -> Sown:
        """The rows of a given table, each with one of these rows, by its key; with `every`, with each of them."""
        return Sown(self, source, key, every, tuple(columns.items()))


@dataclass(frozen=True)
class Sown:
    """A given table `t` whose rows each take a written row `p`, the one that `key` modulo their number points at.

    The columns are p's; those in `columns` are expressions over t and p that mean
    the same in Spark SQL and DuckDB. PLAIN(x) stands for x with runs of anything
    but ASCII letters and digits as one space, so that it can stand within JSON.
    """

    rows: Rows
    source: str
    key: str
    every: bool
    columns: tuple[tuple[str, str], ...]

    def _select(self, plain: str) -> list[str]:
        made = {c: f"p.{c}" for c in _names(self.rows.schema)} | dict(self.columns)
        return [f"{re.sub(r'PLAIN[(]([^()]*)[)]', plain, e)} AS {c}" for c, e in made.items()]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        written = [(n, *r) for n, r in enumerate(self.rows.rows)]
        p = F.broadcast(spark.createDataFrame(written, f"n_ int, {self.rows.schema}")).alias("p")  # a written table is small
        on = F.lit(True) if self.every else F.expr(f"({self.key}) % {len(written)} = p.n_")
        return table(spark, sf_dir, self.source).alias("t").join(p, on).selectExpr(*self._select(r"regexp_replace(\1, '[^A-Za-z0-9]+', ' ')"))

    @property
    def cte(self) -> str:
        body = ", ".join("(" + ", ".join(map(literal, (n, *r))) + ")" for n, r in enumerate(self.rows.rows))
        on = "true" if self.every else f"({self.key}) % {len(self.rows.rows)} = p.n_"
        select = ", ".join(self._select(r"regexp_replace(\1, '[^A-Za-z0-9]+', ' ', 'g')"))
        return f"{self.rows.name} AS (SELECT {select} FROM {self.source} t JOIN (VALUES {body}) p(n_, {', '.join(_names(self.rows.schema))}) ON {on})"
