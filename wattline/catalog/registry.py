"""Registered queries: a DataFrame builder, its output columns and, where SQL can say it, the oracle.

``cols`` lists ``name:code`` pairs: ``i`` bigint, ``s`` string, ``d`` double rounded to ``scale``,
``b`` boolean, ``t`` date as ISO text. Both sides are projected through the same list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.catalog.views import with_views
from wattline.sources.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEFINITIONS: dict[str, dict] = {}


def _parse(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def _spark_col(name: str, code: str, scale: int):
    c = F.col(name)
    return {
        "i": lambda: c.cast("bigint"),
        "s": lambda: c.cast("string"),
        "d": lambda: F.round(c.cast("double"), scale) + F.lit(0.0),
        "b": lambda: c.cast("boolean"),
        "t": lambda: c.cast("date").cast("string"),
    }[code]().alias(name)


def _sql_col(name: str, code: str, scale: int) -> str:
    return {
        "i": f"cast({name} as bigint)",
        "s": f"cast({name} as varchar)",
        "d": f"round(cast({name} as double), {scale}) + cast(0 as double)",
        "b": f"cast({name} as boolean)",
        "t": f"cast(cast({name} as date) as varchar)",
    }[code] + f" as {name}"


def query(name: str, cols: str, sql: str | None = None, views: str = "", ctes: str = "", scale: int = 4,
          recursive: bool = False, tables: type[Tables] = Tables):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` may use the named views and CTEs.

    ``tables`` is the class that reads the data folder.
    """
    parsed = _parse(cols)

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(tables(spark, sf_dir))
            return df.select(*[_spark_col(n, c, scale) for n, c in parsed])

        run.__name__ = name
        QUERIES[name] = run
        DEFINITIONS[name] = {"fn": fn, "cols": cols, "sql": sql, "views": views, "ctes": ctes, "scale": scale, "recursive": recursive}
        if sql is not None:
            parts = [p for p in (with_views(*views.split()) if views else "", ctes.strip().rstrip(",")) if p]
            head = f"with {'recursive ' if recursive else ''}{', '.join(parts)} " if parts else ""
            ORACLES[name] = (f"{head}select {', '.join(_sql_col(n, c, scale) for n, c in parsed)} "
                             f"from ({sql.strip()}) as result_rows")
        return fn

    return register
