"""Registry of (name, Spark query, oracle SQL)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F, types as T

from halocline.session import tune

QUERIES: dict = {}
ORACLES: dict = {}


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Round floating results, since the order of a sum is free."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None, digits: int = 9, keys: str = ""):
    """Register a query. `keys` lists the oracle columns that must not be rounded."""

    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            tune(spark)
            return tidy(fn(spark, sf_dir), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            if keys.strip() == "*":
                ORACLES[name] = f"SELECT * FROM ({oracle}) AS q"
            elif keys.strip():
                ORACLES[name] = (
                    f"SELECT {keys}, round(COLUMNS(* EXCLUDE ({keys})), {digits}) + 0e0 FROM ({oracle}) AS q")
            else:
                ORACLES[name] = f"SELECT round(COLUMNS(*), {digits}) + 0e0 FROM ({oracle}) AS q"
        return run

    return deco
