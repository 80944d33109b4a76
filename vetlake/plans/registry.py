"""Query registry: a Spark callable, its output columns and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SPARK = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}
_DUCK = {"str": "VARCHAR", "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN"}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; both sides are cast to ``columns`` ("a:str b:int c:float d:bool").

    Doubles are rounded to six places, since sums depend on the order of their terms.
    """
    cols = [tuple(c.split(":")) for c in columns.split()]

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[(F.round(F.col(c).cast("double"), 6) if t == "float" else F.col(c).cast(_SPARK[t])).alias(c) for c, t in cols])

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            out = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' if t == "float" else f'CAST("{c}" AS {_DUCK[t]}) AS "{c}"' for c, t in cols)
            ORACLES[name] = f"SELECT {out} FROM ({sql}) q"
        return fn

    return wrap
