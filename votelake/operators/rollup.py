"""Roll-ups: shares, pivots, weighted statistics, quantile bins, ranks and top rows.

Groups with a null key are dropped unless said otherwise, and sums of nothing
are 0: both are stated here once and hold for every function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import col, share
from .ranges import counted, exact_quantiles, quantiles_of, running


def total(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """Sums per group."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])


def pivot_sum(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str], amount: str, prefix: str = "v_", with_total: str | None = None) -> DataFrame:
    """One column of sums per listed value of ``key``, 0 where there is none; ``with_total`` sums all values, listed or not."""
    cols = [F.coalesce(F.sum(F.when(F.col(key) == v, F.col(amount))), F.lit(0)).alias(f"{prefix}{v}") for v in values]
    extra = [F.coalesce(F.sum(amount), F.lit(0)).alias(with_total)] if with_total else []
    return df.dropna(subset=list(by)).groupBy(*by).agg(*cols, *extra)


def share_of_group(df: DataFrame, value: str, by: Sequence[str], name: str = "share") -> DataFrame:
    """Each row's part of its group's sum."""
    return df.withColumn(name, share(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Ratio of sums."""
    return share(F.sum(col(a)), F.sum(col(b)))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Mean of ``x`` with weights; rows without ``x`` have no weight."""
    return share(F.sum(col(x) * col(w)), F.sum(F.when(col(x).isNotNull(), col(w))))


def effective_size(w: Column | str) -> Column:
    return share(F.pow(F.sum(col(w)), 2), F.sum(col(w) * col(w)))


def error_summary(df: DataFrame, by: Sequence[str], error: str, hit: str | None = None) -> DataFrame:
    """Root mean square, mean absolute and mean error, number of rows, and hits."""
    e = F.col(error)
    extra = [F.sum(F.col(hit).cast("int")).cast("long").alias("hits")] if hit else []
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.count(e).alias("n"), *extra)


def frequency(df: DataFrame, by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Relative frequency of each group among those of the same ``within``."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("frequency", share(F.col("n"), F.sum("n").over(Window.partitionBy(*within))))


def consistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def mid_rank(x: str, at: Column | str) -> Column:
    """Mid-rank percentile of ``at`` in a distribution of ``x``."""
    return F.avg((F.col(x) < col(at)).cast("double")) + F.avg((F.col(x) == col(at)).cast("double")) * 0.5


def histogram(df: DataFrame, x: str, edges: Sequence[float], weight: str) -> DataFrame:
    """Weight per bin; bins are left-closed but for the last, which holds its right edge too."""
    v = F.col(x)
    at = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        inside = (v >= low) & ((v < high) if i < len(edges) - 2 else (v <= high))
        at = F.when(inside, i).otherwise(at)
    return df.withColumn("bin", at).where("bin is not null").groupBy("bin").agg(F.sum(weight).alias("weight"))


def quantile_bin(df: DataFrame, x: str, n: int, name: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """Bins 1..n at the interpolated quantiles of ``x`` (right-closed, the lowest included); a null value has none.

    Equal edges are an error in the rows they'd concern: their bin is null.
    The edges are one small row per group, found by rank and joined back.
    """
    edges = exact_quantiles(df, x, [i / n for i in range(n + 1)], by, "_edges").drop("n")
    joined = df.join(edges, list(by), "left") if by else df.crossJoin(F.broadcast(edges))  # one row
    distinct = F.size(F.array_distinct("_edges")) == n + 1
    at = sum((F.when(F.col(x) > F.col("_edges")[i], 1).otherwise(0) for i in range(1, n)), F.lit(1))
    return joined.withColumn(name, F.when(F.col(x).isNotNull() & distinct, at)).drop("_edges")


def variance_parts(df: DataFrame, upper: str, lower: str, x: str, w: str) -> DataFrame:
    """Weighted variance of ``x`` split: between upper units, between lower units inside them, and inside these; as shares of the whole."""
    own = df.where(F.col(x).isNotNull() & F.col(w).isNotNull())
    low = own.groupBy(upper, lower).agg(F.sum(w).alias("_w"), weighted_mean(x, w).alias("_low"), F.sum(F.col(w) * F.col(x) * F.col(x)).alias("_xx"))
    up = low.groupBy(upper).agg(weighted_mean("_low", "_w").alias("_up"))
    all_ = low.agg(weighted_mean("_low", "_w").alias("_all"))
    j = low.join(F.broadcast(up), upper).crossJoin(F.broadcast(all_))
    sums = j.agg(
        F.sum(F.col("_w") * F.pow(F.col("_up") - F.col("_all"), 2)).alias("a"),
        F.sum(F.col("_w") * F.pow(F.col("_low") - F.col("_up"), 2)).alias("b"),
        F.sum(F.col("_xx") - F.col("_w") * F.pow("_low", 2)).alias("c"),
    )
    whole = F.col("a") + F.col("b") + F.col("c")
    return sums.select(share(F.col("a"), whole).alias("between_upper"), share(F.col("b"), whole).alias("between_lower"), share(F.col("c"), whole).alias("within"))


def change(df: DataFrame, series: Sequence[str], order: str, value: str, name: str = "change") -> DataFrame:
    """Difference to the period before in the same series."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*series).orderBy(order)))


def first_last(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """First and last value of each group in an order (ties: the smaller, the larger value) and the change between them."""
    s = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(F.struct(order, value)).alias("_a"), F.max(F.struct(order, value)).alias("_z"))
    s = s.select(*by, F.col("_a")[value].alias("first"), F.col("_z")[value].alias("last"))
    return s.withColumn("change", F.col("last") - F.col("first"))


def fill_constant(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Nulls take the value that their group has elsewhere, the smallest if it has several."""
    known = df.groupBy(*by).agg(F.min(value).alias("_known"))
    return df.join(known, list(by), "left").withColumn(value, F.coalesce(value, "_known")).drop("_known")


def line_input(df: DataFrame, by: Sequence[str], x: str, y: str, target: float) -> DataFrame:
    """Slope and intercept of a straight line per group, and the ``x`` at which it gives ``target``."""
    s = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return s.withColumn("needed", F.try_divide(F.lit(target) - F.col("intercept"), F.col("slope")))


def bin_summary(binned: DataFrame, columns: Sequence[str], weight: str, name: str = "bin") -> DataFrame:
    """Per bin: rows, weighted mean and median of each column."""
    own = binned.where(F.col(name).isNotNull())
    means = own.groupBy(name).agg(F.count("*").alias("n"), *[weighted_mean(x, weight).alias(f"{x}_mean") for x in columns])
    middle = quantiles_of(own, {x: F.col(x) for x in columns}, [0.5], [name])
    cells = [c for x in columns for c in (F.col(f"{x}_mean"), F.col(x)[0].alias(f"{x}_median"))]
    return means.join(middle, name, "left").select(name, "n", *cells)


def hit_rates(df: DataFrame, truth: str, methods: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Per method: cases it decides, how many it gets right, and their part."""
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("said")) for m, c in methods.items()])
    long = df.select(*by, truth, F.explode(cells).alias("x")).select(*by, truth, "x.*").where(F.col("said").isNotNull())
    s = long.groupBy(*by, "method").agg(F.count("*").alias("n"), F.sum((F.col("said") == F.col(truth)).cast("long")).alias("hits"))
    return s.withColumn("rate", share("hits", "n"))


def complete_grid(df: DataFrame, axes: Sequence[Sequence[str]], value: str) -> DataFrame:
    """All combinations of the values that occur on each axis; the value is 0 where there was none."""
    grid: DataFrame | None = None
    for axis in axes:
        own = df.select(*axis).distinct()
        grid = own if grid is None else grid.crossJoin(F.broadcast(own))
    assert grid is not None
    keys = [c for axis in axes for c in axis]
    return grid.join(df.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def duplicates(df: DataFrame, key: Sequence[str], name: str = "duplicated") -> DataFrame:
    """Marks every member of a key that occurs more than once."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*key)) > 1)


def average_rank(df: DataFrame, x: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank with ties at their mean, from a count per value and running sums over ranges of these."""
    values = counted(df, x, by)
    ranks = values.select(*by, x, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, x], "left")


def numbered(df: DataFrame, key: str, name: str = "pos", per_task: int = 50_000) -> DataFrame:
    """Positions from 0 in the order of a numeric key: ranges of the key are numbered side by side and start where those before end."""
    cuts = min(4096, df.count() // per_task)
    bounds = sorted(set(df.approxQuantile(key, [(i + 1) / (cuts + 1) for i in range(cuts)], 0.2 / (cuts + 1)))) if cuts else []
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.lit([float(b) for b in bounds]), lambda b: b <= F.col(key)))
    own = df.withColumn("_part", part)
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    placed = own.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    return placed.join(F.broadcast(start), "_part").withColumn(name, F.col("_r") - 1 + F.col("_start")).drop("_part", "_r", "_start")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(own, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"))


def concentration(df: DataFrame, by: Sequence[str], value: str, key: str, shares: Sequence[float] = (0.5, 0.8)) -> DataFrame:
    """How many of the largest members reach each share of the group's sum; sums run over ranges, so a group may be of any size."""
    placed = running(df.withColumn("_down", F.negative(value)), by, ["_down", key], {"_run": ("sum", F.col(value))})
    sums = placed.groupBy(*by).agg(F.sum(value).alias("_all"))
    part = placed.join(sums, list(by)).withColumn("_run", F.col("_run") / F.col("_all")) if by else placed.crossJoin(F.broadcast(sums)).withColumn("_run", F.col("_run") / F.col("_all"))
    return part.groupBy(*by).agg(*[(F.sum((F.col("_run") < s).cast("int")) + 1).cast("long").alias(f"reach_{round(s * 100)}") for s in shares])


def profile(df: DataFrame, columns: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Means of columns under several weightings, long: (weighting, measure, mean)."""
    cells = [F.struct(F.lit(w).alias("weighting"), F.lit(c).alias("measure"), (F.col(c) * F.col(w)).cast("double").alias("xw"), F.when(F.col(c).isNotNull(), F.col(w)).cast("double").alias("w")) for w in weights for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return long.groupBy("weighting", "measure").agg(share(F.sum("xw"), F.sum("w")).alias("mean"))


def bracket_value(curve: DataFrame, x: str, y: str, at: float, by: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation of a curve at a point."""
    order = Window.partitionBy(*by).orderBy(x)
    seg = curve.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1"))
    inside = seg.where((F.col("x0") <= at) & (F.col("x1") > at) | (F.col("x0") == at) & F.col("x1").isNull())
    step = F.try_divide(F.lit(at) - F.col("x0"), F.col("x1") - F.col("x0"))
    return inside.select(*by, F.when(F.col("x0") == at, F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * step).alias("value"))


def trim_box(df: DataFrame, columns: Sequence[str], low: float = 0.002, high: float = 0.998) -> DataFrame:
    """Rows inside the quantiles of every column."""
    box = quantiles_of(df, {f"_{c}": F.col(c) for c in columns}, [low, high])
    out = df.crossJoin(F.broadcast(box))
    for c in columns:
        out = out.where(F.col(c).between(F.col(f"_{c}")[0], F.col(f"_{c}")[1]))
    return out.drop(*[f"_{c}" for c in columns])


def layers(df: DataFrame, sets: Mapping[str, Sequence[str]], measures: Sequence[Column], distinct: Mapping[str, str] = {}) -> DataFrame:
    """The same measures for several layers, each a set of columns; ``layer`` names the set, the other columns are null.

    ``distinct`` names counts of the distinct values of a column.  They are not
    given as measures, since rows would then be repeated per layer and count: a
    value's combinations of the columns meet in one row instead, which says
    once in which groups of each layer the value is.
    """
    columns = sorted({c for s in sets.values() for c in s})
    bit = lambda own: sum(1 << i for i, c in enumerate(columns) if c not in own)
    mark = sum((F.grouping(c).cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))
    out = df.groupingSets([list(s) for s in sets.values()], *columns).agg(*measures, mark.alias("_g"))
    for name, counted_column in distinct.items():
        own = df.where(F.col(counted_column).isNotNull()).groupBy(F.col(counted_column).alias("_v")).agg(F.collect_set(F.struct(*columns)).alias("_c"))
        kinds = {c: df.schema[c].dataType for c in columns}
        cut = lambda s: F.array_distinct(F.transform("_c", lambda x: F.struct(F.lit(bit(s)).alias("_g"), *[(x[c] if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in columns])))  # noqa: B023, E731
        groups = own.select(F.explode(F.flatten(F.array(*[cut(s) for s in sets.values()]))).alias("x")).select("x.*")
        n = groups.groupBy("_g", *columns).agg(F.count("*").alias("_n"))
        n = n.select(*[F.col(c).alias(f"_k_{c}") for c in ["_g", *columns]], "_n")
        same = F.col("_g") == F.col("_k__g")
        for c in columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        out = out.join(n, same, "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n", *[f"_k_{c}" for c in ["_g", *columns]])
    layer = F.lit(None).cast("string")
    for name, s in sets.items():
        layer = F.when(F.col("_g") == bit(s), name).otherwise(layer)
    return out.withColumn("layer", layer).drop("_g")


def levels(df: DataFrame, hierarchy: Sequence[str], measures: Sequence[Column], distinct: Mapping[str, str] = {}) -> DataFrame:
    """The same measures at every level of a hierarchy and over all (grouping sets of its prefixes); ``distinct`` as in ``layers``."""
    made = layers(df, {str(n): list(hierarchy[:n]) for n in range(len(hierarchy) + 1)}, measures, distinct)
    rest = [c for c in made.columns if c not in (*hierarchy, "layer")]
    return made.select(*hierarchy, *rest, F.col("layer").cast("long").alias("level"))


def set_verdict(first: DataFrame, second: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, first, second, both, equal)``: how many keys two sets have, how many they share, and whether they are equal; null is a key like others."""
    side = lambda df, n: df.select(*by, key, F.lit(n).alias("_side"))
    marks = side(first, 1).unionByName(side(second, 2)).groupBy(*by, key).agg(F.max(F.col("_side") == 1).alias("_a"), F.max(F.col("_side") == 2).alias("_b"))
    n = marks.groupBy(*by).agg(F.count_if("_a").alias("first"), F.count_if("_b").alias("second"), F.count_if(F.col("_a") & F.col("_b")).alias("both"))
    return n.withColumn("equal", (F.col("first") == F.col("both")) & (F.col("second") == F.col("both")))
