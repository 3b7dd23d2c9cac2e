"""Places, sectors, polygons and neighbours: nearest joins, point in polygon, clusters, local regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, floor, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import ABREAST, digests
from ..functions.maths import digest, haversine_km, planar_km, share, uniform_part
from ..sources.shared import written
from . import rollup
from .ranges import quantiles_of

#: Nodes whose values every task of a permutation test holds as one array (8 bytes each), at most; more are joined by a shuffle.
BROADCAST_NODES = 1 << 22
#: Draws of a permutation test that a task makes, about, and that it holds at a time.
TASK_DRAWS, HELD_DRAWS = 1 << 21, 1 << 18


def _grid(points: DataFrame, targets: DataFrame, x: str, y: str, tx: str, ty: str, k: int, cell: float, within: Sequence[str] = ()) -> tuple[float, float, float, int]:
    """``(x0, y0, size, levels)`` of nested grids: cells of ``size``, twice that, and so on, up to one for all.

    ``size`` is ``cell`` halved until no cell holds over 4 ``k`` targets, or
    until coordinates can't be told apart any more.
    """
    edges = lambda df, a, b: df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    both = [e for e in (edges(points, x, y), edges(targets, tx, ty)) if e[0] is not None]
    x0, y0 = min((e[0] for e in both), default=0.0), min((e[2] for e in both), default=0.0)
    span = max([max(e[1] for e in both) - x0, max(e[3] for e in both) - y0] if both else [0.0])
    size = float(cell)
    while span / size < 2.0**48:
        at = [F.floor((F.col(c) - low) / size).alias(n) for c, low, n in ((tx, x0, "_cx"), (ty, y0, "_cy"))]
        most = targets.groupBy(*within, *at).agg(F.count("*").alias("_c")).agg(F.max("_c")).first()[0] or 0
        if most <= 4 * k:
            break
        size /= 2.0 ** ceil(log2(most / (4 * k)) / 2)  # what evenly spread targets take
    return x0, y0, size, max(1, ceil(log2(max(span / size, 1.0)) + 1e-9) + 1)


def _placed(df: DataFrame, a: str, b: str, x0: float, y0: float, size: float) -> DataFrame:
    """``df`` with the cell of the grid ``_l`` that each row lies in."""
    own = F.lit(size) * F.pow(F.lit(2.0), F.col("_l"))
    return df.withColumn("_cx", F.floor((F.col(a) - x0) / own)).withColumn("_cy", F.floor((F.col(b) - y0) / own))


def _finest(points: DataFrame, targets: DataFrame, key: Sequence[str], x: str, y: str, tx: str, ty: str, k: int, grid: tuple[float, float, float, int], within: Sequence[str] = ()) -> DataFrame:
    """``points`` in their cells of the finest grid whose cell around each holds ``k`` targets, or else of the one cell for all."""
    x0, y0, size, levels = grid
    at = [*within, "_l", "_cx", "_cy"]
    every = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    t = _placed(targets.select(*within, tx, ty, every.alias("_l")), tx, ty, x0, y0, size)
    full = t.groupBy(*at).agg(F.count("*").alias("_c")).where(F.col("_c") >= k).drop("_c")
    names = list(dict.fromkeys([*within, *key, x, y]))
    own = _placed(points.select(*names, every.alias("_l")), x, y, x0, y0, size).join(full, at, "left_semi").groupBy(*key).agg(F.min("_l").alias("_l"))
    return _placed(points.join(own, list(key), "left").withColumn("_l", F.coalesce("_l", F.lit(levels - 1))), x, y, x0, y0, size)


def near_candidates(points: DataFrame, targets: DataFrame, key: Sequence[str], x: str, y: str, tx: str, ty: str, k: int, cell: float, within: Sequence[str] = (), reach: Column | None = None) -> DataFrame:
    """Each row of ``points`` with all targets that can be among its ``k`` nearest, and few others: joined by grid cells, not by pairs.

    Grids are nested, the finest one as fine as the targets are dense; ``cell``
    is where that search begins.  A point uses the finest one whose cell around
    it holds ``k`` targets: these are at most a cell's diagonal away, so no
    nearer ones lie beyond the second ring of cells.  ``reach`` is the number of
    rings along ``x``, for a distance that shrinks ``x``.  ``key`` identifies
    the points; ``within`` are columns of both that must be equal.  Of targets
    at one place only ``k`` should be given.
    """
    w, at = list(within), ["_l", "_cx", "_cy"]
    grid = _grid(points, targets, x, y, tx, ty, k, cell, w)
    t = _placed(targets.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(grid[3] - 1)))), tx, ty, *grid[:3])
    p = _finest(points, targets, key, x, y, tx, ty, k, grid, w)
    rings = F.lit(2) if reach is None else F.greatest(reach.cast("int"), F.lit(2))
    p = p.withColumn("_dx", F.explode(F.sequence(-rings, rings))).withColumn("_cx", F.col("_cx") + F.col("_dx")).drop("_dx")
    p = p.withColumn("_dy", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dy")
    return p.join(t, [*w, *at]).drop(*at)


def nearest_place(sectors: DataFrame, places: DataFrame, within: str, sector: str = "sector", place: str = "place", cell: float = 0.5) -> DataFrame:
    """``(within, sector, place, km)``: the nearest place of the same unit, planar with the sector's latitude; ties to the smaller place.

    A sector meets the places of grid cells around it, as far as a nearer one can
    be (up to 89 degrees of latitude).  Sectors without coordinates, or in a
    unit without places, have none.
    """
    p = places.where("lat is not null").groupBy(within, F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).agg(F.min(place).alias("_p"))  # of places at one point the smaller is nearest
    s = sectors.select(within, sector, "lat", "lon").where("lat is not null")
    shrink = F.greatest(F.cos(F.radians("lat")), F.lit(0.0174))  # a degree of longitude against one of latitude
    reach = F.ceil(F.sqrt(1 + 1 / (shrink * shrink)))
    pairs = near_candidates(s, p, [within, sector], "lon", "lat", "_lon", "_lat", 1, cell, [within], reach).withColumn("_km", planar_km("lat", "lon", "_lat", "_lon", "lat"))
    best = pairs.groupBy(within, sector).agg(F.min(F.struct("_km", "_p")).alias("_b"))
    return best.select(within, sector, F.col("_b._p").alias(place), F.col("_b._km").alias("km"))


def place_covariates(sectors: DataFrame, assigned: DataFrame, by: Sequence[str], counts: Sequence[str], population: str) -> DataFrame:
    """Sums of the sectors of each place, and their parts of the population (null where that is 0)."""
    j = sectors.join(assigned, list(by))
    sums = j.groupBy("place").agg(F.coalesce(F.sum(population), F.lit(0)).alias(population), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    return sums.select("*", *[share(F.col(c), F.col(population)).alias(f"{c}_share") for c in counts])


def mean_distance(pairs: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Weighted mean great-circle distance of sectors to their place."""
    km = haversine_km("lat", "lon", "place_lat", "place_lon")
    return pairs.withColumn("_km", km).groupBy(*by).agg(share(F.sum(F.col("_km") * F.col(weight)), F.sum(weight)).alias("mean_km"))


def polygon_cells(edges: DataFrame, cell: float, polygon: str = "polygon") -> tuple[DataFrame, DataFrame]:
    """A grid over closed rings: ``(inside, cut)``, the cells that lie wholly inside a polygon and those that its edges cut.

    ``cut`` has a row per cell and edge that may touch it, and one without an
    edge where the parity at the cell's lower border, of what lies to the right
    of the cell, is odd.  ``cell`` is rounded down to a power of two, so that
    cells have exact borders.
    """
    size = F.lit(2.0 ** floor(log2(cell)))
    at = lambda v: F.floor(v / size).cast("long")
    e = edges.dropna(subset=["x1", "y1", "x2", "y2"]).withColumn("lo", F.least("y1", "y2")).withColumn("hi", F.greatest("y1", "y2"))
    e = e.withColumn("cy", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))))
    x_at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    lower, upper = F.greatest("lo", F.col("cy") * size), F.least("hi", (F.col("cy") + 1) * size)
    own = F.array(x_at(lower), x_at(upper), *[F.when(F.col("y1") == F.col("y2"), F.col(c)) for c in ("x1", "x2")])
    slack = lambda x: F.lit(1e-9) * (F.abs(x) + size)  # noqa: E731  more than rounding can move a crossing
    e = e.withColumn("first", at(F.array_min(F.transform(own, lambda x: x - slack(x))))).withColumn("last", at(F.array_max(F.transform(own, lambda x: x + slack(x)))))
    e = e.withColumn("cx", F.explode(F.sequence("first", "last")))
    crosses = (F.col("cx") == F.col("first")) & (F.col("lo") <= F.col("cy") * size) & (F.col("hi") > F.col("cy") * size)
    row = Window.partitionBy(polygon, "cy").orderBy(F.desc("cx"))
    c = e.groupBy(polygon, "cy", "cx").agg(F.count_if(crosses).alias("n"))
    c = c.withColumn("odd", (F.sum("n").over(row) - F.col("n")) % 2 == 1).withColumn("next", F.lag("cx").over(row)).where("odd")
    inside = c.where("next > cx + 1").select(polygon, "cy", F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"))
    cut = e.select(polygon, "cy", "cx", "x1", "y1", "x2", "y2", "lo", "hi").unionByName(c.select(polygon, "cy", "cx"), allowMissingColumns=True)
    return inside, cut


def point_in_polygon(points: DataFrame, edges: DataFrame, cell: float = 1.0, point: str = "point", polygon: str = "polygon") -> DataFrame:
    """``(point, polygon)`` pairs by crossing parity: an odd number of edges to the right of the point.

    ``edges`` has (polygon, x1, y1, x2, y2) of closed rings, holes among them.
    An edge holds its lower end, not its upper one.  A point in a cell that no
    edge cuts meets the polygons around it only, one in a cut cell that cell's
    edges: those to the right of it at its height, and, to the parity of all
    that lies farther right at the cell's lower border, a change for each end
    of these edges that lies farther right and between the border and the
    point.  Rows without coordinates are in no polygon.
    """
    size = F.lit(2.0 ** floor(log2(cell)))
    at = lambda v: F.floor(v / size).cast("long")
    inside, cut = polygon_cells(edges, cell, polygon)
    p = points.select(point, "x", "y").dropna(subset=["x", "y"]).withColumn("cx", at(F.col("x"))).withColumn("cy", at(F.col("y")))
    x_at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    right = F.when((F.col("y1") != F.col("y2")) & (F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")), (F.col("x") < x_at).cast("int")).otherwise(0)
    ends = [((at(F.col(x)) > F.col("cx")) & (at(F.col(y)) == F.col("cy")) & (F.col(y) > F.col("cy") * size) & (F.col(y) <= F.col("y"))).cast("int") for x, y in (("x1", "y1"), ("x2", "y2"))]
    flips = F.when(F.col("lo").isNull(), 1).otherwise(right + ends[0] + ends[1])
    near = p.join(cut, ["cx", "cy"]).groupBy(point, polygon).agg((F.sum(flips) % 2).alias("_odd")).where("_odd = 1").select(point, polygon)
    return p.join(inside, ["cx", "cy"]).select(point, polygon).unionByName(near)


def unit_zones(places: DataFrame, assigned: DataFrame, unit: str, zone: str, weight: str) -> DataFrame:
    """Each unit's zone by its assignment, else the zone with most weight in its parent unit; ties to the smaller zone."""
    mass = places.groupBy(unit, zone).agg(F.sum(weight).alias("_w"))
    main = mass.groupBy(unit).agg(F.max_by(zone, F.struct("_w", F.negative(F.xxhash64(zone)))).alias("_main"))
    return assigned.join(F.broadcast(main), unit, "left").withColumn("zone", F.coalesce(zone, "_main")).drop("_main")


def outliers(sections: DataFrame, place: Sequence[str], votes: str, valid: str, limit: float = 5.0, least: int = 3) -> DataFrame:
    """Sections against the rest of their place: ``z`` over binomial and extra variance, of those beyond ``limit``.

    The extra variance comes from medians over all sections: that of squared
    residuals over 0.455 (the median of a chi-square of 1) less that of the
    binomial variance, 0 at least; both are selected by rank in one job.
    """
    w = Window.partitionBy(*place)
    s = sections.where(F.col(valid) > 0).withColumn("_n", F.sum(valid).over(w)).withColumn("_v", F.sum(votes).over(w)).withColumn("_k", F.count("*").over(w)).where(F.col("_k") >= least)
    rest = share(F.col("_v") - F.col(votes), F.col("_n") - F.col(valid))
    s = s.withColumn("p", share(F.col(votes), F.col(valid))).withColumn("p_rest", rest).withColumn("_var", F.col("p_rest") * (1 - F.col("p_rest")) / F.col(valid))
    s = written(s, "sections")  # read for the medians and for the result
    middle = quantiles_of(s, {"_sq": F.pow(F.col("p") - F.col("p_rest"), 2), "_own": F.col("_var")}, [0.5])
    t = middle.select(F.greatest(F.col("_sq")[0] / 0.455 - F.col("_own")[0], F.lit(0.0)).alias("tau2"))
    z = s.crossJoin(F.broadcast(t)).withColumn("z", share(F.col("p") - F.col("p_rest"), F.sqrt(F.col("_var") + F.col("tau2"))))
    return z.where(F.abs("z") > limit).select(*sections.columns, "p", "p_rest", "z")


def _scaled(values: DataFrame, node: str, x: str) -> DataFrame:
    m = values.where(F.col(x).isNotNull()).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.count(x).alias("_n"))
    return values.where(F.col(x).isNotNull()).crossJoin(F.broadcast(m)).select(node, (F.col(x) - F.col("_m")).alias("d"), F.try_divide(F.col(x) - F.col("_m"), F.col("_s")).alias("z"), "_n")


def moran(values: DataFrame, edges: DataFrame, node: str = "node", x: str = "x") -> DataFrame:
    """Moran's I over row-standardised neighbours; nodes without any are left out of the lag."""
    s = _scaled(values, node, x)
    lag = edges.join(s.select(F.col(node).alias("dst"), "d"), "dst").groupBy("src").agg(F.avg("d").alias("lag"))
    j = s.join(lag.withColumnRenamed("src", node), node, "left")
    n_lag = F.count("lag")
    return j.agg(share(F.sum(F.col("d") * F.col("lag")) * F.count("*"), F.sum(F.col("d") * F.col("d")) * n_lag).alias("moran_i"), F.count("*").alias("n"))


def _counts_in_tasks(base: DataFrame, placed: DataFrame, size: int, permutations: int, seed: int, star: bool) -> DataFrame:
    """``(src, above, below)``: permuted statistics at least as large, at least as small, each node's all in one task."""
    spark = base.sparkSession
    table = placed.toPandas()  # at most BROADCAST_NODES rows of two numbers
    z_at = np.empty(size)
    z_at[table["pos"].to_numpy()] = table["z"].to_numpy(float)
    shared = spark.sparkContext.broadcast(z_at)
    tasks = max(1, min(10_000, size * permutations // TASK_DRAWS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["src"].astype(str)
            above, below = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for (deg, _), at in batch.groupby([batch["deg"], texts.str.len()]).indices.items():
                step = max(1, ABREAST // permutations)
                for low in range(0, len(at), step):
                    own = at[low : low + step]
                    rows = batch.iloc[own]
                    above[own], below[own] = _permuted(shared.value, permutations, seed, star, list(texts.iloc[own]), rows["z"].to_numpy(), rows["statistic"].to_numpy(), deg)
            yield pd.DataFrame({"src": batch["src"], "above": above, "below": below})

    light = base.select("src", F.col("z").cast("double").alias("z"), F.col("statistic").cast("double").alias("statistic"), F.col("deg").cast("int").alias("deg"))
    return light.repartition(tasks, "src").mapInPandas(run, f"src {dict(base.dtypes)['src']}, above long, below long")


def _permuted(values: np.ndarray, permutations: int, seed: int, star: bool, src: list[str], z: np.ndarray, statistic: np.ndarray, deg: int) -> tuple[np.ndarray, np.ndarray]:
    """How many permuted statistics of each node are at least as large, and at least as small, as its own; ids of one length, nodes of one degree."""
    fours = (deg + 3) // 4
    step = max(1, HELD_DRAWS // (4 * fours * len(src)))
    names = np.array([list(s.encode()) for s in src], np.uint8)
    bytes_of = lambda s: np.frombuffer(s.encode(), np.uint8)
    above, below = np.zeros(len(src), np.int64), np.zeros(len(src), np.int64)
    cuts = sorted({permutations, *range(0, permutations, step), *(10**e for e in range(1, len(str(permutations))))})
    for low, high in zip(cuts, cuts[1:]):  # permutations whose numbers have as many digits
        if low >= permutations:
            break
        perms = np.array([list(f"{seed}|{perm}|".encode()) for perm in range(low, high)], np.uint8)
        head, size = perms.shape[1], perms.shape[1] + names.shape[1]
        parts = []
        for four in range(fours):
            tail = bytes_of(f"|{four}")
            text = np.empty((len(src), len(perms), size + len(tail)), np.uint8)
            text[:, :, :head], text[:, :, head:size], text[:, :, size:] = perms[None], names[:, None], tail
            parts.append(digests(text.reshape(-1, text.shape[2])).reshape(len(src), len(perms), 4))
        uniform = (np.concatenate(parts, 2)[:, :, :deg] + 0.5) / 2.0**32
        drawn = values[np.floor(uniform * len(values)).astype(np.int64)]
        if star:
            drawn[:, :, 0] = z[:, None]
        lag = drawn.sum(axis=2) / deg
        made = lag if star else z[:, None] * lag
        above += (made >= statistic[:, None]).sum(axis=1)
        below += (made <= statistic[:, None]).sum(axis=1)
    return above, below


def _counts_by_join(base: DataFrame, placed: DataFrame, permutations: int, seed: int, star: bool) -> DataFrame:
    """The same with a row per draw, for more nodes than a task can hold the values of."""
    pos = placed.select("pos", F.col("z").alias("zp"))
    reps = base.sparkSession.range(permutations).select(F.col("id").cast("int").alias("perm"))
    deg = F.col("deg").cast("int")
    fan = base.crossJoin(F.broadcast(reps)).withColumn("_four", F.explode(F.sequence(F.lit(0), F.floor((deg - 1) / 4).cast("int"))))  # a digest gives four draws
    fan = fan.withColumn("_digest", digest(seed, "perm", "src", "_four")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.least(deg - F.col("_four") * 4, F.lit(4)) - 1)))
    fan = fan.withColumn("slot", F.col("_four") * 4 + F.col("_q") + 1)
    drawn = fan.withColumn("pos", F.floor(uniform_part("_digest", "_q") * F.col("_n")).cast("long")).join(pos, "pos")
    value = F.when((F.col("slot") == 1) & F.lit(star), F.col("z")).otherwise(F.col("zp"))
    lags = drawn.groupBy("src", "perm").agg(F.avg(value).alias("plag"), F.max("z").alias("z"), F.max("statistic").alias("statistic"))
    stat = F.col("plag") if star else F.col("z") * F.col("plag")
    return lags.groupBy("src").agg(F.sum((stat >= F.col("statistic")).cast("int")).alias("above"), F.sum((stat <= F.col("statistic")).cast("int")).alias("below"))


def local_clusters(values: DataFrame, edges: DataFrame, permutations: int, seed: int, significance: float = 0.01, star: bool = False, node: str = "node", x: str = "x") -> DataFrame:
    """``(node, z, lag, statistic, p, cluster)``: local Moran, or with ``star`` the Gi* hot spots, with conditional permutation.

    A permutation draws as many other nodes' values as the node has neighbours:
    each draw takes the position that a digest of (seed, permutation, node,
    neighbour) gives; node ids are numbers.  A task makes all draws of its
    nodes in numpy, from one array of values in the order of ids, and emits two
    counts a node.  Above BROADCAST_NODES nodes the draws are rows that are
    joined with the values instead.  ``p`` is the part of statistics at least
    as extreme on the smaller side.
    """
    s = _scaled(values, node, x)
    e = edges.select("src", "dst").distinct().where("src <> dst")
    if star:
        e = e.unionByName(s.select(F.col(node).alias("src"), F.col(node).alias("dst")))
    own = s.select(F.col(node).alias("src"), "z", "_n")
    seen = e.join(s.select(F.col(node).alias("dst"), F.col("z").alias("zd")), "dst").groupBy("src").agg(F.avg("zd").alias("lag"), F.count("*").alias("deg"))
    base = own.join(seen, "src").withColumn("statistic", F.col("lag") if star else F.col("z") * F.col("lag"))
    placed = rollup.numbered(s.select(node, "z"), node).select("pos", "z")
    size = placed.count()
    if size <= BROADCAST_NODES:
        n = _counts_in_tasks(base, placed, size, permutations, seed, star)
    else:
        n = _counts_by_join(base, placed, permutations, seed, star)
    p = (F.least("above", "below") + 1) / F.lit(permutations + 1)
    label = F.when(p > significance, "none")
    label = label.when(F.col("lag") > 0, "high").otherwise("low") if star else label.when((F.col("z") > 0) & (F.col("lag") > 0), "high-high").when((F.col("z") <= 0) & (F.col("lag") <= 0), "low-low").when(F.col("z") > 0, "high-low").otherwise("low-high")
    return base.join(n, "src").select(F.col("src").alias(node), "z", "lag", "statistic", p.alias("p"), label.alias("cluster"))


#: Cells along a block whose points and neighbours meet in one task, and distances that it holds at a time.
BLOCK, HELD_PAIRS = 8, 1 << 20


def _from_neighbours(p: DataFrame, values: Sequence[str], k: int, cell: float, node: str, extra: Sequence[Column], fit: Callable[[np.ndarray, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fit(distances, values, focus)`` of every place with its ``k`` nearest points, those at the place included, in the order of distance and node.

    Points at one place have the same neighbours, so a place is looked at once
    (``extra``: aggregates over its points, columns of ``focus``), and of its
    points only the first ``k`` can be anybody's neighbours.  Places use grids
    as ``near_candidates`` does; a task gets a block of cells with those of the
    two rings around cells that it uses, each point once, and emits what ``fit``
    makes, never pairs.
    """
    at = ["_l", "_bx", "_by"]
    first = F.row_number().over(Window.partitionBy("px", "py").orderBy(node))
    targets = written(p.select(node, "px", "py", *[F.col(v).cast("double").alias(v) for v in values]).withColumn("_r", first).where(F.col("_r") <= k).drop("_r"), "targets")
    places = p.groupBy("px", "py").agg(F.count("*").alias("_n"), *extra)
    grid = _grid(targets, targets, "px", "py", "px", "py", k, cell)
    focus = written(_finest(places, targets, ["px", "py"], "px", "py", "px", "py", k, grid), "places")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    ring = lambda: F.explode(F.sequence(F.lit(-2), F.lit(2)))
    cells = focus.select("_l", "_cx", "_cy").distinct().withColumn("_bx", block("_cx")).withColumn("_by", block("_cy"))
    cells = cells.withColumn("_d", ring()).withColumn("_cx", F.col("_cx") + F.col("_d")).withColumn("_d", ring()).withColumn("_cy", F.col("_cy") + F.col("_d")).drop("_d").distinct()
    used = sorted(r[0] for r in focus.select("_l").distinct().collect())  # at most a number per halving
    t = targets.withColumn("_l", F.explode(F.array(*[F.lit(u) for u in used]) if used else F.array().cast("array<int>")))
    t = _placed(t, "px", "py", *grid[:3]).join(cells, ["_l", "_cx", "_cy"])

    def run(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values(node, kind="stable", na_position="first")
        xy, table = near[["px", "py"]].to_numpy(float), near[list(values)].to_numpy(float)
        members = near.reset_index(drop=True).groupby(["_cx", "_cy"]).indices
        out = []
        for (cx, cy), group in own.groupby(["_cx", "_cy"]):
            around = [members[c] for c in ((cx + i, cy + j) for i in range(-2, 3) for j in range(-2, 3)) if c in members]
            some = np.sort(np.concatenate(around))
            n, step = min(k, len(some)), max(1, HELD_PAIRS // len(some))
            for low in range(0, len(group), step):
                rows = group.iloc[low : low + step]
                d = np.sqrt((xy[some, 0] - rows["px"].to_numpy()[:, None]) ** 2 + (xy[some, 1] - rows["py"].to_numpy()[:, None]) ** 2)
                i, j = np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n])
                order = np.lexsort((j, d[i, j], i))
                i, j = i[order], j[order]
                begin = np.searchsorted(i, np.arange(len(rows)))
                j = j[begin[:, None] + np.arange(n)]
                out.append(fit(np.take_along_axis(d, j, 1), table[some[j]], rows))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    tasks = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are small but cost much work
    dealt = lambda df: df.repartition(tasks, *at).groupBy(*at)
    return dealt(focus.withColumn("_bx", block("_cx")).withColumn("_by", block("_cy"))).cogroup(dealt(t)).applyInPandas(run, schema)


def local_regression(points: DataFrame, xs: Sequence[str], y: str, k: int, cell: float, node: str = "node") -> DataFrame:
    """Geographically weighted regression: per point, bisquare weights over its k nearest, itself included, and their own least squares.

    Neighbours come from the cells around a point, on a grid as fine as k of
    them need (``cell`` is where the search for it begins); ties go to the
    smaller node.  Returns (node, term, coef, local_r2, n, hat, residual).
    """
    p = points.dropna(subset=["px", "py", *xs, y])
    terms, m = ["intercept", *xs], len(xs) + 1

    def fit(d: np.ndarray, table: np.ndarray, focus: pd.DataFrame) -> pd.DataFrame:
        b = d[:, -1:]
        w = (1 - np.divide(d, b, out=np.zeros_like(d), where=b > 0) ** 2) ** 2
        x, v = np.concatenate((np.ones((*d.shape, 1)), table[:, :, :-1]), 2), table[:, :, -1]
        wx = x * w[:, :, None]
        inverse = np.linalg.pinv(np.swapaxes(wx, 1, 2) @ x)
        xy = np.einsum("nki,nk->ni", wx, v)
        beta = np.einsum("nij,nj->ni", inverse, xy)
        yy, sw, sy = (w * v * v).sum(1), w.sum(1), (w * v).sum(1)
        tss = yy - np.divide(sy**2, sw, out=np.array(yy), where=sw > 0)
        r2 = [1 - r / t if t > 0 else None for r, t in zip(yy - (beta * xy).sum(1), tss)]
        return pd.DataFrame({"px": focus["px"].to_numpy(), "py": focus["py"].to_numpy(), "beta": list(beta), "inverse": list(inverse.reshape(len(d), -1)), "local_r2": pd.Series(r2, dtype=object), "n": d.shape[1]})

    fits = _from_neighbours(p, [*xs, y], k, cell, node, [], fit, "px double, py double, beta array<double>, inverse array<double>, local_r2 double, n long")
    own = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    hat = sum((F.col("inverse")[i * m + j] * a * b for i, a in enumerate(own) for j, b in enumerate(own)), F.lit(0.0))
    rest = F.col(y).cast("double") - sum((F.col("beta")[i] * a for i, a in enumerate(own)), F.lit(0.0))
    cells = F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), F.col("beta").alias("coef"))
    j = p.select(node, "px", "py", *xs, y).join(fits, ["px", "py"]).select(node, F.explode(cells).alias("c"), "local_r2", "n", hat.alias("hat"), rest.alias("residual"))
    return j.select(node, F.col("c")["term"].alias("term"), F.col("c")["coef"].alias("coef"), "local_r2", "n", "hat", "residual")


def bandwidths(points: DataFrame, xs: Sequence[str], y: str, ks: Sequence[int], cell: float, node: str = "node") -> DataFrame:
    """``(k, aicc, chosen)``: the corrected Akaike criterion of a local regression for every number of neighbours, and the smallest one's mark.

    Each place has one list of neighbours, up to the largest ``k``.  A bisquare
    weight is a polynomial of the squared distance, so running sums of products
    with 1, d^2 and d^4 along the list give the normal equations of every ``k``
    at once; the points at a place come in by their sums of products.  What
    leaves a cell is three sums per ``k``.  Ties: the smaller ``k``.
    """
    grid = np.array(sorted(set(ks)))
    m = len(xs) + 1
    p = points.dropna(subset=["px", "py", *xs, y])
    each = [F.lit(1.0), *[F.col(c).cast("double") for c in [*xs, y]]]
    sums = F.array(*[F.sum(a * b) for a in each for b in each]).alias("_q")

    def fit(d: np.ndarray, table: np.ndarray, focus: pd.DataFrame) -> pd.DataFrame:
        at = np.minimum(grid, d.shape[1]) - 1
        out = np.zeros((len(grid), 3))
        for row, values, moments in zip(d, table, focus["_q"]):
            full = np.concatenate((np.ones((len(row), 1)), values), 1)
            x = full[:, :m]
            products = x[:, :, None] * full[:, None, :]
            upto = [np.cumsum(products * (row**e)[:, None, None], axis=0) for e in (0, 2, 4)]
            scale = np.divide(1.0, row[at] ** 2, out=np.zeros(len(at)), where=row[at] > 0)[:, None, None]
            normal = upto[0][at] - 2 * scale * upto[1][at] + scale**2 * upto[2][at]
            inverse = np.linalg.pinv(normal[:, :, :m])
            beta = (inverse @ normal[:, :, m:])[:, :, 0]
            q = np.asarray(moments, float).reshape(m + 1, m + 1)
            error = np.concatenate((-beta, np.ones((len(grid), 1))), 1)  # of a row with its y
            out += np.stack((np.full(len(grid), q[0, 0]), np.einsum("kij,ij->k", inverse, q[:m, :m]), np.einsum("ki,ij,kj->k", error, q, error)), 1)
        return pd.DataFrame({"k": grid, "n": out[:, 0], "h": out[:, 1], "rss": out[:, 2]})

    parts = _from_neighbours(p, [*xs, y], int(grid[-1]), cell, node, [sums], fit, "k int, n double, h double, rss double")
    s = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("rss").alias("rss")).where("n > 0")
    per = s.select("k", _aicc(F.col("n"), F.col("h"), F.col("rss")).alias("aicc"))
    best = per.agg(F.min(F.struct("aicc", "k")).alias("_best"))
    return per.crossJoin(F.broadcast(best)).select("k", "aicc", (F.col("k") == F.col("_best.k")).alias("chosen"))  # one row


def _aicc(n: Column, h: Column, rss: Column) -> Column:
    return n * F.log(rss / n) + n * F.log(F.lit(2 * np.pi)) + n * (n + h) / (n - 2 - h)


def aicc(fit: DataFrame) -> DataFrame:
    """Corrected Akaike criterion of a local regression, to choose among numbers of neighbours."""
    one = fit.where("term = 'intercept'").agg(F.count("*").alias("n"), F.sum("hat").alias("h"), F.sum(F.col("residual") * F.col("residual")).alias("rss"))
    return one.select(_aicc(F.col("n").cast("double"), F.col("h"), F.col("rss")).alias("aicc"))
