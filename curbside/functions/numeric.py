"""Rounding, IEEE arithmetic, clipping and null/NaN repair as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row.

    The optimizer would otherwise copy the expression into a lambda and run it per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def round_half_up(c, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d. Null, NaN and infinities pass through unchanged."""
    x = _col(c).cast("double")
    scale = float(10**digits)
    # NaN sorts above every number, so the guard sends it, like +-inf, to `otherwise`
    return F.when(F.abs(x) * scale < 9e15, F.floor(x * scale + F.lit(0.5)) / F.lit(scale)).otherwise(x)


def r2(c) -> Column:
    return round_half_up(c, 2)


def shown(c, digits: int) -> Column:
    """Rounding for reported values: half up, with halves that float noise left a hair low included."""
    x = _col(c).cast("double")
    scale = float(10**digits)
    return F.when(F.abs(x) * scale < 9e15, F.floor(x * scale + F.lit(0.500001)) / F.lit(scale)).otherwise(x)


def r4(c) -> Column:
    return shown(c, 4)


def r6(c) -> Column:
    return shown(c, 6)


def ieee_div(n, d) -> Column:
    """Float division that yields +-inf or NaN for a zero divisor, where ANSI mode would raise."""
    n, d = _col(n).cast("double"), _col(d).cast("double")
    # anything times infinity has the sign, the NaN and the null that division by zero asks for
    return F.when(d != 0.0, n / d).when(d.isNotNull(), n * F.lit(INF))


def clip_low(c, low: float) -> Column:
    """Raise values below `low`; null and NaN stay as they are (`greatest` would lose them)."""
    x = _col(c)
    return F.when(x < F.lit(low), F.lit(low)).otherwise(x)


def clip(c, low: float, high: float) -> Column:
    x = _col(c)
    return F.when(x < F.lit(low), F.lit(low)).when((x > F.lit(high)) & ~F.isnan(x), F.lit(high)).otherwise(x)


def first_number(*cols, default: float = 0.0) -> Column:
    """First argument that is neither null nor NaN, else `default`."""
    nothing = F.lit(None).cast("double")
    return F.coalesce(*[F.nanvl(_col(c).cast("double"), nothing) for c in cols], F.lit(default))


def mean_cents_rounded(c, when: Column | None = None) -> Column:
    """Mean of an amount already in whole cents, rounded half up to cents.

    Amounts are added as whole cents, so the result does not depend on the order in which partial sums
    meet. A group with an amount whose cents a double cannot hold exactly (9e13 and above, infinite or
    NaN) gets the ordinary mean of all its amounts.
    """
    x = _col(c).cast("double")
    if when is not None:
        x = F.when(when, x)
    whole = F.abs(x) < 9e13
    cents = F.sum(F.when(whole, F.round(x * 100.0).cast("bigint")))
    n = F.count(x)
    exact = F.floor(cents / n + F.lit(0.5)) / 100.0
    return F.when(F.count(F.when(~whole, x)) > 0, F.avg(x)).when(n > 0, exact)
