"""Column expressions shared by the operators (no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from panelspark.constants import AGE_BANDS

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """NaN to NULL: inside the library a missing number is always NULL."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def open_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b where x/0 is infinite with the sign of x and 0/0 is NULL."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = b == 0
    return F.when(b != 0, F.try_divide(a, b)).when(zero & (a > 0), F.lit(INF)).when(zero & (a < 0), F.lit(-INF))


def growth_rate(first: Column | str, last: Column | str, years: int) -> Column:
    """Average yearly rate of change ln(last / first) / years.

    Growth from zero is +inf and growth to zero is -inf, so that a clamp decides;
    0/0 and negative ratios are NULL.
    """
    q = open_ratio(last, first)
    return F.when(q > 0, F.log(q) / F.lit(float(years))).when(q == 0, F.lit(-INF))


def clamp(
    c: Column | str,
    low: float | None = None,
    high: float | None = None,
    low_value: float | None = None,
    high_value: float | None = None,
    null_value: float | None = None,
) -> Column:
    """Replace values outside [low, high]; the replacement may differ from the limit."""
    x = no_nan(c)
    out = F.when(x.isNull(), F.lit(null_value).cast("double"))
    if low is not None:
        out = out.when(x < low, F.lit(float(low if low_value is None else low_value)))
    if high is not None:
        out = out.when(x > high, F.lit(float(high if high_value is None else high_value)))
    return out.otherwise(x)


def signif(c: Column | str, digits: int = 3) -> Column:
    """Round to a number of significant digits; zero and NULL stay as they are."""
    x = col(c).cast("double")
    e = F.floor(F.log10(F.abs(x))) - F.lit(digits - 1)
    up = F.pow(F.lit(10.0), e.cast("double"))
    down = F.pow(F.lit(10.0), (-e).cast("double"))
    return (
        F.when((x == 0) | x.isNull(), x)
        .when(e >= 0, F.round(x / up) * up)
        .otherwise(F.round(x * down) / down)
    )


def leading_number(c: Column | str, start: int = 1, length: int = 2) -> Column:
    """Digits at a place of a text as an integer, NULL when they are no number."""
    return F.substring(col(c), start, length).try_cast("int")


def band_start(label: Column | str) -> Column:
    """First age of a band label such as '<5 years', '5-9 years', '80-84', '95+ years'."""
    c = col(label)
    return F.when(c.startswith("<"), F.lit(0)).otherwise(F.regexp_extract(c, r"^(\d+)", 1).try_cast("int"))


def band_stop(label: Column | str, open_width: int = 5) -> Column:
    """Last age of a band label; an open band 'n+' is ``open_width`` years wide."""
    c = col(label)
    return (
        F.when(c.startswith("<"), F.regexp_extract(c, r"^<(\d+)", 1).try_cast("int") - 1)
        .when(c.rlike(r"^\d+\+"), F.regexp_extract(c, r"^(\d+)", 1).try_cast("int") + open_width - 1)
        .otherwise(F.regexp_extract(c, r"^\d+-(\d+)", 1).try_cast("int"))
    )


def band_midpoint(label: Column | str) -> Column:
    return ((band_start(label) + band_stop(label)) / 2).cast("double")


def band_index(age: Column | str, width: int = 5, last: int | None = None, first_age: int = 0) -> Column:
    """Number of the band of an age; ages past the last band fall into the last."""
    k = F.floor((col(age) - F.lit(first_age)) / F.lit(width)).cast("int")
    return F.least(k, F.lit(last)) if last is not None else k


def band_label(age: Column | str, labels: list[str] = AGE_BANDS, width: int = 5) -> Column:
    """Label of the band of an age (one array lookup)."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.when(col(age) >= 0, F.get(names, band_index(age, width, len(labels) - 1)))


def case_map(c: Column | str, groups: dict[str, list], default: Column | str | None = None) -> Column:
    """Value to group name; ``default`` for the rest."""
    x = col(c)
    out = reduce(
        lambda acc, item: acc.when(x.isin(item[1]), F.lit(item[0])), groups.items(), F.when(F.lit(False), F.lit(""))
    )
    return out.otherwise(F.lit(default) if default is None or isinstance(default, str) else default)


def recode(c: Column | str, mapping: dict) -> Column:
    """Replace single values and keep the rest."""
    x = col(c)
    out = reduce(lambda acc, kv: acc.when(x == F.lit(kv[0]), F.lit(kv[1])), mapping.items(), F.when(F.lit(False), x))
    return out.otherwise(x)


def piecewise_scale(c: Column | str, axis: Column | str, cut: float, below: float, above: float) -> Column:
    """Scale a column by one factor up to ``cut`` on the axis and by another beyond."""
    return col(c) * F.when(col(axis) > cut, F.lit(float(above))).otherwise(F.lit(float(below)))


def mean_of(terms: list[Column]) -> Column:
    """Row-wise mean of the terms that are numbers."""
    clean = [no_nan(t) for t in terms]
    total = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in clean])
    count = reduce(lambda a, b: a + b, [t.isNotNull().cast("int") for t in clean])
    return F.try_divide(total, count.cast("double"))


def product(c: Column | str) -> Column:
    """Group product, 1 for a group without values."""
    return F.coalesce(F.product(col(c)), F.lit(1.0))


def complement_product(c: Column | str) -> Column:
    """1 - prod(1 - x) over the group: independent effects taken together."""
    return F.lit(1.0) - product(F.lit(1.0) - col(c))


def grid_key(i: Column | str, j: Column | str) -> Column:
    """Text key of a grid cell, e.g. 'IR0.93CF1.02'."""
    return F.concat(F.lit("IR"), col(i).cast("string"), F.lit("CF"), col(j).cast("string"))


def grid_key_parts(key: Column | str) -> tuple[Column, Column]:
    """The two numbers of a grid key."""
    return (
        F.regexp_extract(col(key), r"IR(.+)CF", 1).try_cast("double"),
        F.regexp_extract(col(key), r"CF(.+)$", 1).try_cast("double"),
    )


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda body.

    A fold over nothing: the start value goes straight to the finishing lambda.
    """
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def floor0(x: Column) -> Column:
    """max(0, x) that keeps NULL, for use inside lambdas."""
    return bind(x, lambda v: F.when(v < 0, F.lit(0.0)).otherwise(v))


def civil_micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    c = col(c)
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return day * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second
