"""Orders over whole tables without one task: ranks and carried values by ranges of the key.

A table is cut into ranges at bounds taken from a bounded sample of its keys (those whose rows have the least hashes, so any partitioning gives the same sample).
Inside a range a window counts; what comes before a range is known from one number, or one value, a range.
Rows with equal keys fall into one range: name keys that tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, and sampled keys a range.
RANGES, SAMPLED = 64, 32


def _range(df: DataFrame, key: Column, ranges: int) -> Column:
    """The number of the range that a row's key falls into."""
    sample = df.select(key.alias("k"), F.xxhash64(*df.columns).alias("h")).orderBy("h", "k").limit(ranges * SAMPLED)  # a top-k: so many rows a partition
    keys = [r["k"] for r in sample.select("k").orderBy("k").collect()]
    kind = sample.schema["k"].dataType
    bounds = sorted({i * len(keys) // ranges for i in range(1, ranges)}) if len(keys) > 1 else []
    literal = lambda k: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, kind.fields)))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*(literal(keys[i]) for i in bounds)), lambda b: b <= key))


def ranked(df: DataFrame, *order: str, by: tuple[str, ...] = (), name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: the row's place, from 1, in ``order`` (nulls first), counted anew in each group of ``by``; a group may have any share of the rows."""
    key = F.struct(*by, *order)
    placed = df.withColumn("_range", _range(df, key, ranges))
    sizes = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = sizes.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    inner = placed.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    return inner.join(before, same).withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).select(*df.columns, name)


def carried(df: DataFrame, value: str, *order: str, by: tuple[str, ...] = (), name: str = "carried", ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: the last value of ``value`` that is not null, at the row or before it in ``order``, in each group of ``by``.

    Each range hands on the last value it has; a range without one hands on what it was given."""
    key = F.struct(*by, *order)
    placed = df.withColumn("_range", _range(df, key, ranges)).withColumn("_key", key)
    own = placed.groupBy(*by, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_key"))).alias("_last"))
    before = own.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_given"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    inner = placed.withColumn("_mine", F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return inner.join(before, same).withColumn(name, F.coalesce("_mine", "_given")).select(*df.columns, name)
