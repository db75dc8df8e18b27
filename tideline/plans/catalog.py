"""Registration of queries with the SQL that gives the same rows, and the shape that both return.

A shape lists "column kind": s text, d date, t timestamp (both as text), i integer, b boolean, fN number rounded to N digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(shape: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in shape.split(",")]


def shaped(df: DataFrame, shape: str) -> DataFrame:
    out = []
    for name, kind in _columns(shape):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind[0] == "f":
            c = F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)  # no negative zeros
        else:
            c = c.cast({"s": "string", "i": "long", "b": "boolean"}[kind])
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(sql: str, shape: str) -> str:
    out = []
    for name, kind in _columns(shape):
        q = f'"{name}"'
        if kind == "d":
            c = f"strftime(CAST({q} AS DATE), '%Y-%m-%d')"
        elif kind == "t":
            c = f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
        elif kind[0] == "f":
            c = f"round(CAST({q} AS DOUBLE), {kind[1:]}) + CAST(0 AS DOUBLE)"
        else:
            c = f"CAST({q} AS {dict(s='VARCHAR', i='BIGINT', b='BOOLEAN')[kind]})"
        out.append(f"{c} AS {q}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS result"


def query(name: str, shape: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of (spark, sf_dir); `sql` may use the views named in `views`, which stand before it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: shaped(f(spark, sf_dir), shape)
        if sql is not None:
            from .substrate import VIEWS

            need: list[str] = []
            for v in views.split():
                need += [x for x in VIEWS[v][0].split() if x not in need] + [v]
            need = list(dict.fromkeys(need))
            head = "WITH RECURSIVE " + ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in need) + " " if need else ""
            ORACLES[name] = head + shaped_sql(sql, shape)
        return f

    return register
