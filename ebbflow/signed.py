"""The sign algebra: every row carries a weight, +1 for an addition and -1 for a retraction.

A stateless operator passes the weight through, a join multiplies weights, a grouped operator emits the difference
of its previous and its current result.  The net rows of a signed frame are what a batch job would have given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "__sign"


def columns(df: DataFrame) -> list[str]:
    """The user's columns."""
    return [c for c in df.columns if c != SIGN]


def positive(df: DataFrame) -> DataFrame:
    """Every row as an addition; a frame that has signs keeps them."""
    return df if SIGN in df.columns else df.withColumn(SIGN, F.lit(1))


def negate(df: DataFrame) -> DataFrame:
    """Additions as retractions and the other way round."""
    return positive(df).withColumn(SIGN, -F.col(SIGN))


def consolidate(df: DataFrame) -> DataFrame:
    """Net weight of every distinct row; rows that net to zero are dropped."""
    keys = columns(df)
    return df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.sum(SIGN).cast("long").alias(SIGN)).filter(F.col(SIGN) != 0)


def net_rows(df: DataFrame) -> DataFrame:
    """The rows of the net multiset, each as often as it counts; transient negatives are hidden."""
    whole = consolidate(df).filter(F.col(SIGN) > 0)
    many = F.explode(F.sequence(F.lit(1).cast("long"), F.col(SIGN)))
    return whole.withColumn("__n", many).drop(SIGN, "__n")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed rows that lead from old to new."""
    return consolidate(positive(new).unionByName(negate(old)))


def expanded(df: DataFrame) -> DataFrame:
    """Rows of weight m as m rows of weight 1 or -1."""
    sign = F.signum(F.col(SIGN)).cast("int")
    return df.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs(F.col(SIGN)).cast("long")))).withColumn(SIGN, sign).drop("__n")


def weighted(c: Column) -> Column:
    """A value times its row's weight."""
    return c * F.col(SIGN)
