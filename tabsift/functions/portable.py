"""Column expressions that give the same numbers in Spark and in plain SQL engines.

* Random draws come from ``md5`` of (key, seed, purpose) so that a retried task,
  another partitioning or an SQL engine reproduces them exactly.
* Correlation is built from moments with ``try_divide`` so that a constant
  column yields NULL instead of raising under ANSI mode.
* ``erf`` has no built-in in Spark; we use a rational approximation that is
  also expressible in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**52: hash prefixes of 13 hex digits are exact in a double.
HASH_BITS = 52
HASH_SPAN = float(2 ** HASH_BITS)


def _to_str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def hash_key(*parts) -> Column:
    """md5 of the '|'-joined parts (strings or Columns) as a string."""
    cols = [F.lit(p) if not isinstance(p, (Column, str)) else _to_str(p) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def hash52(*parts) -> Column:
    """Non-negative 52-bit integer from the first 13 hex digits of md5(parts).

    Same value in SQL: ``CAST(('0x' || substr(md5(...), 1, 13)) AS BIGINT)``.
    """
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform draw in [0, 1) from md5 of parts."""
    return hash52(*parts).cast("double") / F.lit(HASH_SPAN)


def lit_part(v) -> Column:
    """Literal key part for hash_key (so plain strings are not read as column names)."""
    return F.lit(str(v))


def r6(c) -> Column:
    """Round a double to 6 places (last-digit noise differs between engines)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def rhalf(c, digits: int = 6) -> Column:
    """Round half up on the binary value: floor(x·10^d + 0.5) / 10^d.

    Engines disagree on ``round`` at exact decimal ties (one rounds the printed
    decimal, the other the binary value); this form is the same IEEE arithmetic
    everywhere. SQL: ``floor(x * 1e6 + 0.5) / 1e6``.
    """
    c = F.col(c) if isinstance(c, str) else c
    k = float(10 ** digits)
    return F.floor(c.cast("double") * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def rhalf_sql(x: str, digits: int = 6) -> str:
    return f"(CAST(floor(({x}) * {float(10 ** digits)!r} + 0.5) AS DOUBLE) / {float(10 ** digits)!r})"


def corr_from_moments(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson r from sums of (nearly) centred values, held to [-1, 1]; NULL when a side is constant."""
    cov = sxy - sx * sy / n
    vx = F.greatest(sxx - sx * sx / n, F.lit(0.0))
    vy = F.greatest(syy - sy * sy / n, F.lit(0.0))
    den = F.sqrt(vx) * F.sqrt(vy)
    return F.when(den > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, den))))


def sigmoid(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


# Abramowitz & Stegun formula 7.1.26 coefficients for erf(x), x >= 0.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(c) -> Column:
    """erf(x) with absolute error below 1.5e-7 (A&S 7.1.26)."""
    c = F.col(c) if isinstance(c, str) else c
    ax = F.abs(c)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * ax)
    a1, a2, a3, a4, a5 = ERF_A
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.signum(c) * y


def erf_sql(x: str) -> str:
    """The same approximation as SQL text (for oracles)."""
    a1, a2, a3, a4, a5 = ERF_A
    t = f"(1.0 / (1.0 + {ERF_P} * abs({x})))"
    poly = f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))))"
    return f"(sign({x}) * (1.0 - {poly} * exp(-abs({x}) * abs({x}))))"


def norm_sf_two_sided(z) -> Column:
    """Two-sided p value of a standard normal z: 1 - erf(|z|/sqrt 2)."""
    z = F.col(z) if isinstance(z, str) else z
    return F.lit(1.0) - erf(F.abs(z) / F.lit(math.sqrt(2.0)))
