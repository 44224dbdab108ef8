"""Numeric column expressions: ratios, bands, flags, rounding rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

MACHINE_EPSILON = 2.220446049250313e-16


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that yields null on a zero denominator instead of an ANSI error."""
    return column(numerator) / F.nullif(column(denominator), F.lit(0))


def relative_change(value: Column | str, reference: Column | str, scale: int = 8) -> Column:
    """``value / reference - 1`` rounded half away from zero."""
    return F.round(safe_ratio(value, reference) - F.lit(1), scale)


def half_even(value: Column | str, digits: int) -> Column:
    """Round a double half to even after scaling it, as array libraries do."""
    power = F.lit(float(10**digits))
    return F.rint(column(value).cast("double") * power) / power


def decimal_mean(value: Column | str, scale: int = 0) -> Column:
    """Average of an exact number, kept at ``scale + 4`` digits and rounded half away from zero.

    The sum is exact, so the result does not depend on how rows are partitioned.
    """
    return F.avg(column(value).cast(f"decimal(18,{scale})"))


def bucketize(
    value: Column | str,
    edges: list[float],
    labels: list[str],
    right: bool = True,
    null_label: str | None = None,
) -> Column:
    """Label a number by ascending edges; ``right`` puts an edge value in the lower bucket."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    source = column(value)
    chain = F.when(source.isNull(), F.lit(null_label))
    for edge, label in zip(edges, labels):
        inside = source <= F.lit(edge) if right else source < F.lit(edge)
        chain = chain.when(inside, F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def label_position(value: Column | str, ordered_labels: list[str]) -> Column:
    """Ordinal of a label in its documented order; labels outside the order come last."""
    spot = F.array_position(F.array(*[F.lit(label) for label in ordered_labels]), column(value))
    return F.when(spot > 0, spot).otherwise(F.lit(len(ordered_labels) + 1)).cast("int")


def clip_lower(value: Column | str, bound: float = 0) -> Column:
    """Raise values below ``bound`` to it; null stays null."""
    source = column(value)
    return F.when(source < F.lit(bound), F.lit(bound)).otherwise(source)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def any_of(names: list[str], predicate) -> Column:
    """Whether any named column satisfies the predicate; an unknown comparison counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(predicate(F.col(n)), F.lit(False)) for n in names])


def outside(value: Column | str, low, high) -> Column:
    """Not within ``[low, high]``; null counts as outside."""
    return ~F.coalesce(column(value).between(low, high), F.lit(False))


def outside_band(value: Column | str, names: list[str], tolerance) -> Column:
    """Not within the row-wise min..max of ``names`` widened by ``tolerance``."""
    columns = [F.col(n) for n in names]
    return outside(value, F.least(*columns) - F.lit(tolerance), F.greatest(*columns) + F.lit(tolerance))


def is_finite(value: Column | str) -> Column:
    source = column(value).cast("double")
    return F.coalesce(~F.isnan(source) & (F.abs(source) < F.lit(float("inf"))), F.lit(False))


def period_label(period: Column | str, train_until: int, validate_until: int) -> Column:
    """train / validation / test by inclusive last period; an unknown period falls through to test."""
    source = column(period)
    return (
        F.when(source <= train_until, F.lit("train"))
        .when(source <= validate_until, F.lit("validation"))
        .otherwise(F.lit("test"))
    )


def floored_percentage_error(error: Column | str, actual: Column | str) -> Column:
    """Absolute error over the absolute actual value, floored at machine epsilon."""
    size = F.greatest(F.abs(column(actual).cast("double")), F.lit(MACHINE_EPSILON))
    return F.abs(column(error).cast("double")) / size
