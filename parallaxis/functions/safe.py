"""Column helpers shared by the operators: missing values are NULL, and a division by nothing is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else NULL."""
    return F.when(b > 0, a.cast("double") / b)


def root(x: Column) -> Column:
    """Square root with rounding below zero cut off; NULL stays NULL."""
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table that every task may get whole (heights, gates, strata, variants), after a look at how many rows it has; more are refused."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: too many to meet every row of another table")
    return F.broadcast(df)


def missing(*columns: str) -> list[Column]:
    """The columns with NaN turned into NULL, as sources hand them on."""
    return [F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns]


def rounded(df, digits: int = 6):
    """All doubles of a result rounded, for comparison between engines; -0 becomes 0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def settled(df, *names: str):
    """The same rows, with these columns' values computed once, here.

    A filter or join key on a column of many nested steps would else be pushed below them, each step written out
    as often as it is used; no predicate passes a generated column.
    """
    rest = [c for c in df.columns if c not in names]
    x = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("__settled"))
    return x.select(*[F.col(f"__settled.{c}").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])
