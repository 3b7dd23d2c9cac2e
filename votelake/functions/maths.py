"""Numeric column functions: shares, bands, decay, distances, and draws that depend on nothing but their key."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share(a: Column | str, b: Column | str) -> Column:
    """``a / b``; null where ``b`` is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col(c).isNotNull(), out)


def band(c: Column | str, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """The label of the interval between neighbouring ``edges``: left-closed, or right-closed with ``right``.  Outside: null."""
    x, out = col(c), F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        out = F.when(inside, label).otherwise(out)
    return out


def half_life(days: Column | str, half: float) -> Column:
    """0.5 ** (days / half)."""
    return F.pow(F.lit(0.5), col(days) / F.lit(float(half)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar_km(lat1, lon1, lat2, lon2, reference_lat) -> Column:
    """Distance on the plane whose longitudes are scaled by the cosine of a reference latitude."""
    dy = (col(lat1) - col(lat2)) * F.lit(111.32)
    dx = (col(lon1) - col(lon2)) * F.lit(111.32) * F.cos(F.radians(col(reference_lat)))
    return F.sqrt(dx * dx + dy * dy)


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function by a rational approximation of erfc, error below 2e-7."""
    x = F.abs(col(z)) / F.lit(2**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    # Coefficients of the published Chebyshev fit of erfc.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    tail = F.lit(0.5) * t * F.exp(-x * x + poly)
    return F.when(col(z) >= 0, F.lit(1.0) - tail).otherwise(tail)


def uniform(seed: int, *key: Column | str) -> Column:
    """A draw in (0, 1) from the MD5 digest of seed and key: equal on any partitioning and in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def digest(seed: int, *key: Column | str) -> Column:
    """The MD5 digest of seed and key, of which ``uniform_part`` takes up to four draws."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]).cast("binary"))


def uniform_part(digest_: Column | str, part: Column | str) -> Column:
    """The draw in (0, 1) of a quarter of a digest, 0 to 3."""
    return (F.conv(F.substring(col(digest_), (col(part) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))


def normal(seed: int, *key: Column | str) -> Column:
    """A standard normal draw, Box-Muller over two uniform ones."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(seed, *key, F.lit("u")))) * F.cos(F.lit(2 * pi) * uniform(seed, *key, F.lit("v")))


def student_t(seed: int, nu: int, *key: Column | str) -> Column:
    """A draw of Student's t with ``nu`` degrees of freedom: normal over the root of a mean of ``nu`` squared normals."""
    square = F.lit(0.0)
    for i in range(nu):
        square = square + F.pow(normal(seed, *key, F.lit(f"chi{i}")), 2)
    return normal(seed, *key, F.lit("t")) / F.sqrt(square / nu)


def poisson_one(seed: int, *key: Column | str, most: int = 8) -> Column:
    """A Poisson draw of mean 1 by inversion, the resampling weight of a row in a bootstrap replicate; at most ``most``."""
    u, total, p, out = uniform(seed, *key), 0.0, 0.36787944117144233, F.lit(0)
    for k in range(most):
        total += p
        p /= k + 1
        out = out + F.when(u > F.lit(total), 1).otherwise(0)
    return out


def normal_sql(seed: int, *key: str) -> str:
    """The DuckDB expression of ``normal``."""

    def u(last: str) -> str:
        parts = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key], f"'{last}'"])
        return f"((CAST(('0x' || left(md5({parts}), 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"

    return f"(sqrt(-2.0::DOUBLE * ln({u('u')})) * cos({2 * pi!r}::DOUBLE * {u('v')}))"


def student_t_sql(seed: int, nu: int, *key: str) -> str:
    """The DuckDB expression of ``student_t``."""
    square = " + ".join(f"({normal_sql(seed, *key, chr(39) + f'chi{i}' + chr(39))}) ** 2" for i in range(nu))
    return f"({normal_sql(seed, *key, chr(39) + 't' + chr(39))} / sqrt(({square}) / {nu}.0::DOUBLE))"


def uniform_part_sql(seed: int, part: str, *key: str) -> str:
    """The DuckDB expression of ``uniform_part`` of ``digest``."""
    parts = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"((CAST(('0x' || substr(md5({parts}), CAST(({part}) * 8 + 1 AS BIGINT), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def uniform_sql(seed: int, *key: str) -> str:
    """The DuckDB expression of ``uniform``."""
    parts = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"((CAST(('0x' || left(md5({parts}), 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"
