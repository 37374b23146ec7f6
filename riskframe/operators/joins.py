"""Joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows with a NULL key match nothing; they are dealt over so many places of their own.
NULL_PLACES = 4096


def lookup_join(fact: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Join with a lookup table that is unique per key.

    Spark measures the lookup side while it runs and broadcasts it only if it is small; otherwise both sides are
    shuffled and adaptive execution splits the partitions of hot keys. Rows without a key would all meet in one task:
    a second join column spreads them.
    """
    on = [on] if isinstance(on, str) else on
    missing = F.greatest(*[F.col(k).isNull() for k in on]) if len(on) > 1 else F.col(on[0]).isNull()
    others = [F.col(c) for c in fact.columns if not _unhashable(fact, c)]
    place = F.when(missing, 1 + F.pmod(F.xxhash64(*others), F.lit(NULL_PLACES))).otherwise(F.lit(0)).cast("int")
    joined = fact.withColumn("_place", place).join(dim.withColumn("_place", missing.cast("int")), [*on, "_place"], how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*fact.columns)
    return joined.select(*on, *[c for c in fact.columns if c not in on], *[c for c in dim.columns if c not in on])


def _unhashable(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark limits each partition before the shuffle."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
