"""Column -> Column helpers. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The season names used by stored records, and the names we normalise to.
SEASON_NAMES = {
    "Зима": "winter",
    "Весна": "spring",
    "Лето": "summer",
    "Осень": "autumn",
}

# Fixed value: where the front end finds the picture made from a payer's initials.
AVATAR_URL = "https://api.dicebear.com/7.x/initials/svg?seed="


def season(month: Column) -> Column:
    """Season name of a month number; anything that is not winter to summer is autumn."""
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.between(3, 5), "spring")
        .when(month.between(6, 8), "summer")
        .otherwise("autumn")
    )


def season_normalize(label: Column) -> Column:
    """Bring stored labels of either vocabulary to one set; unknown labels stay as they are."""
    pairs = [F.lit(text) for item in SEASON_NAMES.items() for text in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def clip_low(value: Column, low: float = 0) -> Column:
    """Raise to ``low``; a null stays null (``greatest`` alone would turn it into ``low``)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def clip_range(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def percent_of(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; null when ``whole`` is zero."""
    return F.try_divide(part, whole) * 100


def null_to_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def sentinel_to_null(text: Column, sentinel: str = "..") -> Column:
    """Numeric text with a placeholder for 'no value', as a double."""
    return F.nullif(F.trim(text), F.lit(sentinel)).try_cast("double")


def ceil_div(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size)).cast("long")


def avatar_url(full_name: Column) -> Column:
    return F.concat(F.lit(AVATAR_URL), full_name)


def tax_type_or_payer_type(tax_type: Column, taxpayer_type: Column) -> Column:
    return F.coalesce(tax_type, taxpayer_type)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def stable_digest(seed: int, *keys: str) -> Column:
    """A hex digest of a row's key: the same on every run, plan and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
