"""Registry of named queries (one per operator id) and their SQL oracles.

``@query(name, sql=...)`` registers a ``(spark, sf_dir) -> DataFrame``
callable.  Registered outputs are normalised for cross-engine comparison:
integer columns become BIGINT, doubles are rounded to 6 decimals (with -0.0
folded to 0.0 on the SQL side).  Library functions themselves return full
precision; only the registered views are normalised.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NO_ORACLE: dict[str, str] = {}   # name -> reason there is no SQL oracle

_TYPES_FILE = os.path.join(os.path.dirname(__file__), "oracle_types.json")


def normalize(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round_half_up(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def round_half_up(c, digits: int = 6):
    """floor(x * 10^d + 0.5) / 10^d — plain IEEE arithmetic, so any engine
    that computes the same double rounds it the same way (SQL side mirrors it)."""
    k = float(10 ** digits)
    return F.floor(c * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def query(name: str, sql: str | None = None, no_oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        run.raw = fn
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        if no_oracle is not None:
            NO_ORACLE[name] = no_oracle
        return run
    return deco


def load_types() -> dict:
    if os.path.exists(_TYPES_FILE):
        with open(_TYPES_FILE) as fh:
            return json.load(fh)
    return {}


def wrap_sql(name: str, sql: str, types: dict) -> str:
    """Apply the same normalisation to the oracle's output columns."""
    spec = types.get(name)
    if not spec:
        return sql
    repl = []
    for col, kind in spec:
        q = '"' + col.replace('"', '""') + '"'
        if kind == "double":
            repl.append(f"(CAST(floor(CAST({q} AS DOUBLE) * 1e6 + 0.5) AS DOUBLE) / 1e6) AS {q}")
        elif kind == "bigint":
            repl.append(f"CAST({q} AS BIGINT) AS {q}")
    if not repl:
        return sql
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) AS oracle_q"


def oracle_sql() -> dict[str, str]:
    types = load_types()
    return {k: wrap_sql(k, v, types) for k, v in ORACLES.items()}


def column_kinds(df: DataFrame) -> list:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.LongType):
            out.append([f.name, "bigint"])
        elif isinstance(f.dataType, T.DoubleType):
            out.append([f.name, "double"])
    return out
