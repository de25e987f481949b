"""Expression macros: guarded arithmetic, interval errors, hashes, text forms. All stay in whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero: what two engines agree on."""
    return F.round(col(c), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six decimals."""
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def no_nan(c: Column | str) -> Column:
    """Missing is NULL only."""
    return F.when(~F.isnan(col(c)), col(c))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*(no_nan(c).alias(c) if c in floats else F.col(c) for c in df.columns)) if floats else df


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def all_finite(*cs: Column | str) -> Column:
    return reduce(lambda a, b: a & b, map(finite, cs))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double; NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: Column | str, low=None, high=None) -> Column:
    """NULL stays NULL, though greatest and least skip it."""
    c = col(c)
    out = c if low is None else F.greatest(c, F.lit(low) if not isinstance(low, Column) else low)
    out = out if high is None else F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(c.isNotNull(), out)


def interval_excess(p: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """Distance of p from [lower, upper]."""
    p = col(p)
    return clip(p - col(upper), 0.0) + clip(col(lower) - p, 0.0)


def close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def pearson(x: Column | str, y: Column | str, least: int = 3) -> Column:
    """Aggregate: NULL for fewer than `least` complete pairs or a constant side. Spark's corr would raise."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    sd = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.when((F.count(xs) >= least) & (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys)), F.try_divide(F.covar_pop(xs, ys), sd))


def skew_g1(c: Column | str) -> Column:
    """Aggregate: bias-corrected skewness, from three values on; NULL for constants."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.min(c) < F.max(c)), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def bucket(text: Column | str, n: int, salt: str = "") -> Column:
    """Portable hash bucket: the first 32 bits of md5, modulo n."""
    text = col(text).cast("string")
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(salt)) if salt else text), 1, 8), 16, 10).cast("long") % n


def stable_seed(text: Column | str) -> Column:
    """31 bits of the first four bytes of SHA-256, little-endian; 0 becomes 1."""
    h = F.sha2(col(text), 256)
    swapped = F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    seed = F.conv(swapped, 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    return F.when(seed == 0, F.lit(1).cast("long")).otherwise(seed)


def crc_seed(text: Column | str, seed: int) -> Column:
    return F.crc32(col(text).cast("binary")).bitwiseXOR(F.lit(seed).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def potency(molar: Column | str) -> Column:
    """-log10 of a concentration; NULL unless it is positive."""
    return F.when(col(molar) > 0, -F.log10(col(molar)))


def cut(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label of the band [edges[k], edges[k + 1]) that holds c; NULL outside."""
    c = col(c)
    out = F.when(c < edges[0], F.lit(None))
    for high, label in zip(edges[1:], labels):
        out = out.when(c < high, F.lit(label))
    return out


def words(text: Column | str) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.filter(F.array_distinct(F.split(F.lower(col(text)), "[^a-z0-9]+")), lambda w: w != "")


IDENTITY_LEVELS = ("raw", "trimmed", "lowered", "collapsed", "bare")


def identity_levels(text: Column | str) -> dict[str, Column]:
    """Coarser and coarser forms of a text identity."""
    raw = col(text)
    trimmed = F.trim(raw)
    lowered = F.lower(trimmed)
    collapsed = F.regexp_replace(lowered, "[ \\t\\n\\r]+", " ")
    return dict(zip(IDENTITY_LEVELS, (raw, trimmed, lowered, collapsed, F.regexp_replace(collapsed, "[^a-z0-9 ]", ""))))
