"""Registry: a query, its output columns, and its SQL.

``columns`` names every output column with its kind: ``i`` whole number, ``d`` real number
(rounded to six places on both sides), ``s`` text. The same list shapes the Spark result and
the SQL result, so both sides have equal names, order and types.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querybook.inputs import Inputs, oracle_inputs


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None


BOOK: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    spec = tuple((part.split(":")[0], part.split(":")[1]) for part in columns.split())

    def register(run):
        BOOK[name] = Query(run, spec, sql)
        return run

    return register


def shaped(df: DataFrame, spec) -> DataFrame:
    kinds = {"i": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "s": lambda c: c.cast("string")}
    return df.select(*[kinds[k](F.col(f"`{n}`")).alias(n) for n, k in spec])


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, folder: shaped(q.run(Inputs(spark, folder)), q.columns)

    return {name: bind(q) for name, q in BOOK.items()}


def oracle_queries() -> dict[str, str]:
    inputs = oracle_inputs()
    kinds = {"i": 'cast("{0}" as bigint) as "{0}"', "d": 'round(cast("{0}" as double), 6) + 0e0 as "{0}"', "s": 'cast("{0}" as varchar) as "{0}"'}
    out = {}
    for name, q in BOOK.items():
        if q.sql is None:
            continue
        used = [f"{k} as ({v})" for k, v in inputs.items() if re.search(rf"\b{k}\b", q.sql)]
        body = q.sql.strip()
        own = ""
        if body.lower().startswith("with "):
            depth, i = 0, 5
            # the final select starts at nesting depth 0
            while not (depth == 0 and body[i:i + 7].lower() == "select "):
                depth += {"(": 1, ")": -1}.get(body[i], 0)
                i += 1
            own, body = body[5:i].strip(), body[i:]
        ctes = ", ".join([*used, *([own] if own else [])])
        selected = ", ".join(kinds[k].format(n) for n, k in q.columns)
        out[name] = (f"with {ctes} " if ctes else "") + f"select {selected} from ({body}) q"
    return out
