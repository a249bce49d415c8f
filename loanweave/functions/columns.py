"""Column builders shared by the operators. All stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanweave.fixed import REGIONS, Bands


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- weighted aggregates -----------------------------------------------------------------


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of failing on zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def total(value: Column | str, where: Column | None = None) -> Column:
    """Sum that is 0.0 for no rows, optionally restricted to ``where``."""
    value = as_column(value).cast("double")
    if where is not None:
        value = F.when(where, value)
    return F.coalesce(F.sum(value), F.lit(0.0))


def weighted_average(value: Column | str, weight: Column | str = "current_upb") -> Column:
    """Mean of ``value`` weighted by positive weights; null when no row qualifies."""
    value, weight = as_column(value).cast("double"), as_column(weight).cast("double")
    usable = value.isNotNull() & (weight > 0)
    return ratio(F.sum(F.when(usable, value * weight)), F.sum(F.when(usable, weight)))


def weighted_mean(value: Column | str, weight: Column | str = "current_upb") -> Column:
    """Mean weighted by the balance of the rows where ``value`` is present."""
    value, weight = as_column(value).cast("double"), as_column(weight).cast("double")
    return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def over_total(value: Column | str, weight: Column | str = "current_upb") -> Column:
    """Weighted sum over the balance of all rows, rows without a value included."""
    value, weight = as_column(value).cast("double"), as_column(weight).cast("double")
    return ratio(F.sum(value * weight), F.sum(weight))


def share_pct(predicate: Column, weight: Column | str = "current_upb") -> Column:
    """Percentage of the balance where ``predicate`` holds (null counts as false)."""
    weight = as_column(weight).cast("double")
    return 100.0 * ratio(F.sum(F.when(predicate, weight).otherwise(F.lit(0.0))), F.sum(weight))


# --- labels ------------------------------------------------------------------------------


def band(value: Column | str, bands: Bands) -> Column:
    """Label of the half-open interval holding ``value``; ``Other`` outside all and for null."""
    value = as_column(value)
    inside = F.when(value < bands.edges[0], F.lit("Other"))
    for upper, label in zip(bands.edges[1:], bands.labels, strict=True):
        inside = inside.when(value < upper, F.lit(label))
    return inside.otherwise(F.lit("Other"))


def open_band(
    value: Column | str, limits: Sequence[float], labels: Sequence[str], inclusive: bool = False
) -> Column:
    """Label by upper limits; everything above the last limit, and null, gets the last label."""
    value = as_column(value)
    tests = [value <= x if inclusive else value < x for x in limits]
    chain = reduce(
        lambda acc, pair: acc.when(pair[0], F.lit(pair[1])),
        list(zip(tests[1:], labels[1:-1], strict=True)),
        F.when(tests[0], F.lit(labels[0])),
    )
    return chain.otherwise(F.lit(labels[-1]))


def lookup(value: Column | str, table: Mapping, default) -> Column:
    """Value of a small literal mapping, ``default`` for unknown keys and null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_column(value)), F.lit(default))


def region(state: Column | str, rename: Mapping[str, str] | None = None) -> Column:
    """Region of a state code, ``Other`` when unknown."""
    rename = rename or {}
    table = {s: rename.get(name, name) for name, states in REGIONS.items() for s in states.split()}
    return lookup(state, table, "Other")


def is_true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def yes_flag(value: Column | str) -> Column:
    """'Y' -> true, anything else and null -> false."""
    return is_true(as_column(value) == "Y")


# --- dates -------------------------------------------------------------------------------


def parse_month(value: Column | str) -> Column:
    """First of the month from ``YYYYMM`` or ``MMYYYY`` text; null when neither parses."""
    value = as_column(value)
    year_first = F.substring(value, 1, 4).between("1900", "2100")
    read = F.when(year_first, F.try_to_date(value, "yyyyMM")).otherwise(
        F.try_to_date(value, "MMyyyy")
    )
    # Six digits need no date parser, which takes longer than the rest of a row.
    number = value.try_cast("int")
    year = F.when(year_first, F.floor(number / 100)).otherwise(number % 10000).cast("int")
    month = F.when(year_first, number % 100).otherwise(F.floor(number / 10000)).cast("int")
    plain = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.when(value.rlike(r"^[0-9]{6}\z"), plain).otherwise(read)


def month_number(value: Column | str) -> Column:
    """Months since year 0, so that month arithmetic is integer arithmetic."""
    value = as_column(value)
    return F.year(value) * 12 + F.month(value) - 1


# --- cash flow ---------------------------------------------------------------------------


def scheduled_principal(upb: Column | str, rate: Column | str, term: Column | str) -> Column:
    """Principal of a level payment: UPB * r / ((1+r)^n - 1), r a monthly rate; never negative."""
    upb, rate, term = (as_column(c).cast("double") for c in (upb, rate, term))
    monthly = rate / 1200.0
    growth = F.pow(1.0 + monthly, term) - 1.0
    amount = upb * monthly / F.when(growth > 0, growth).otherwise(F.lit(1.0))
    return F.greatest(F.coalesce(amount, F.lit(0.0)), F.lit(0.0))


def annualised_pct(monthly: Column) -> Column:
    """Annual percentage of a monthly rate: (1 - (1 - m)^12) * 100."""
    return (1.0 - F.pow(1.0 - monthly, F.lit(12.0))) * 100.0


# --- sampling ----------------------------------------------------------------------------


def hash_bucket(buckets: int, *keys: Column | str) -> Column:
    """Bucket 0..buckets-1 from an MD5 of the keys: the same in every engine and every run."""
    text = F.concat_ws("|", *[as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets
