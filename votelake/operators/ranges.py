"""Running sums, ranks and exact quantiles over ordered ranges: two levels, and no task that holds a whole group.

All rows are dealt to ranges of their order.  Each range sums its own rows side
by side with the others.  What the ranges before it hold of its first group is
one row per range, and is added afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

Written = Callable[[DataFrame, str], DataFrame]

#: Per kind: the aggregate of rows, the one of its results, and how two results become one.
KINDS = {
    "sum": (F.sum, F.sum, lambda a, b: a + b),
    "count": (F.count, F.sum, lambda a, b: a + b),
    "bit_xor": (F.bit_xor, F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
}


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]], write: Written = written) -> DataFrame:
    """``df`` with running aggregates per group in an ascending order, nulls first, the own row included.

    ``values`` maps a name to a kind (``sum``, ``count``, ``bit_xor``, ``max``
    or ``min``) and what it is taken of.  ``order`` should be total within a
    group; rows that it does not tell apart come in any order, in one range.
    ``write`` puts a table where all executors see it and reads it back, so that
    the ranges are cut once.  A group that holds any part of all rows spans
    several ranges and is summed in all of them at once; the rows that are
    broadcast are at most one per range.
    """
    cut = write(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.select("*", *[KINDS[k][0](v).over(local).alias(f"_own_{n}") for n, (k, v) in values.items()])
    # only the first and the last group of a range can lie in other ranges too
    group = F.struct(*by) if by else F.lit(0)
    ends = cut.groupBy("_part").agg(F.min(group).alias("_a"), F.max(group).alias("_z"))
    held = cut.join(F.broadcast(ends), "_part").where(group.eqNullSafe(F.col("_a")) | group.eqNullSafe(F.col("_z")))
    totals = held.groupBy("_part", *by).agg(*[KINDS[k][0](v).alias(n) for n, (k, v) in values.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    merged = [KINDS[k][1](n).over(before).alias(f"_far_{n}") for n, (k, _) in values.items()]
    carry = totals.select(F.col("_part").alias("_to"), *[F.col(c).alias(f"_to_{c}") for c in by], F.count("*").over(before).alias("_seen"), *merged).where("_seen > 0")
    met = F.col("_part") == F.col("_to")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_to_{c}"))
    both = own.join(F.broadcast(carry), met, "left")
    out = [F.coalesce(KINDS[k][2](F.col(f"_own_{n}"), F.col(f"_far_{n}")), f"_own_{n}", f"_far_{n}").alias(n) for n, (k, _) in values.items()]
    return both.select(*df.columns, *out)


def counted(df: DataFrame, x: str, by: Sequence[str] = (), write: Written = written) -> DataFrame:
    """``(*by, x, n, upto)``: how often each value occurs in its group, and how many rows have it or a smaller one.

    Equal values are one row, summed up before the shuffle, so ties stay
    together however many they are.  Rows without ``x`` are left out.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    return running(counts, by, [x], {"upto": ("sum", F.col("n"))}, write)


def exact_quantiles(df: DataFrame, x: str, ps: Sequence[float], by: Sequence[str] = (), name: str = "quantiles", write: Written = written) -> DataFrame:
    """``(*by, n, <name>)``: exact, linearly interpolated quantiles of ``x`` per group, as an array in the order of ``ps``.

    A distributed selection by rank: of all values only the two that bracket a
    quantile are kept, so no task holds the values of a group.  A group
    without values has no row; over all rows there is always one, with nulls.
    """
    values = counted(df, x, by, write)
    sizes = values.groupBy(*by).agg(F.max("upto").alias("_all"))
    met = values.join(sizes, list(by)) if by else values.crossJoin(F.broadcast(sizes))  # one row
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    at = [F.lit(float(p)) * (F.col("_all") - 1) for p in ps]
    near = [F.max(F.when(side(h).between(first, last), F.col(x).cast("double"))).alias(f"_{n}{i}") for i, h in enumerate(at) for n, side in (("low", F.floor), ("high", F.ceil))]
    found = met.groupBy(*by).agg(F.max("_all").alias("_all"), *near)
    cells = []
    for i, h in enumerate(at):
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        cells.append(F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high))
    return found.select(*by, F.coalesce("_all", F.lit(0)).alias("n"), F.array(*cells).alias(name))


def quantiles_of(df: DataFrame, columns: Mapping[str, Column], ps: Sequence[float], by: Sequence[str] = (), write: Written = written) -> DataFrame:
    """``exact_quantiles`` of several columns in one job: per group an array column for each name of ``columns``."""
    cells = F.array(*[F.struct(F.lit(n).alias("_of"), c.cast("double").alias("_x")) for n, c in columns.items()])
    long = df.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")
    found = exact_quantiles(long, "_x", ps, [*by, "_of"], "_q", write)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_of") == n, F.col("_q"))).alias(n) for n in columns])
