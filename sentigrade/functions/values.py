"""Numeric, date and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Revenue limits of the success tiers, lowest first.
TIERS = ("Flop", "Moderate", "Hit", "Blockbuster")
TIER_LIMITS = (100_000, 1_000_000, 10_000_000)
# Upper limits of price tiers 1, 2 and 3; 0 is free, 4 is everything above.
PRICE_LIMITS = (10, 20, 30)
# Fixed value: buyers per review in the revenue estimate.
BUYERS_PER_REVIEW = 30.0
# Fixed value: end date of a game still in early access.
STILL_OPEN = 9999999999

DATE_FORMATS = ("MMM d, yyyy", "d MMM, yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy", "MMM yyyy", "yyyy")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c) -> Column:
    value = _col(c)
    return F.when(~F.isnan(value), value)


def to_numeric(c, kind: str = "double") -> Column:
    """Number in a text column; anything unparseable is NULL."""
    return F.trim(_col(c).cast("string")).try_cast(kind)


def blank_to_null(c) -> Column:
    text = F.trim(_col(c))
    return F.when(text != "", text)


def is_true(c) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c))) == "true", F.lit(False))


def parse_range(c) -> Column:
    """``'1,000 .. 2,000'`` as struct(low, high); one number is both ends; '0' and blank are NULL."""
    text = F.trim(F.regexp_replace(_col(c), ",", ""))
    spaced = r"(\d+)\s*\.\.\s*(\d+)"
    single = text.try_cast("bigint")
    usable = text.isNotNull() & ~text.isin("", "0")
    low = F.coalesce(F.regexp_extract(text, spaced, 1).try_cast("bigint"), single)
    high = F.coalesce(F.regexp_extract(text, spaced, 2).try_cast("bigint"), single)
    return F.struct(F.when(usable, low).alias("low"), F.when(usable, high).alias("high"))


def floor_midpoint(low, high) -> Column:
    return F.floor((_col(low) + _col(high)) / F.lit(2)).cast("bigint")


def midpoint(low, high) -> Column:
    return (_col(low) + _col(high)) / F.lit(2.0)


def review_score(positive, negative) -> Column:
    return F.try_divide(_col(positive).cast("double"), (_col(positive) + _col(negative)))


def estimated_revenue(total_reviews, price, multiplier: float = BUYERS_PER_REVIEW) -> Column:
    """Reviews x buyers per review x price; unknown without reviews or without a price."""
    total = _col(total_reviews)
    return F.when(total != 0, total * F.lit(float(multiplier)) * _col(price))


def success_tier(revenue) -> Column:
    value = _col(revenue)
    tier = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, limit in zip(TIERS, TIER_LIMITS):
        tier = tier.when(value < limit, F.lit(name))
    return tier.otherwise(F.lit(TIERS[-1]))


def tier_index(tier) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), _col(tier)).cast("int") - 1


def price_tier(price) -> Column:
    value = _col(price)
    tier = F.when(value.isNull(), F.lit(None).cast("int")).when(value <= 0, F.lit(0))
    for step, limit in enumerate(PRICE_LIMITS, start=1):
        tier = tier.when(value < limit, F.lit(step))
    return tier.otherwise(F.lit(len(PRICE_LIMITS) + 1))


def parse_date(c, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; NULL when none does."""
    text = F.trim(_col(c))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def release_features(release_date, as_of_year) -> dict[str, Column]:
    """Calendar features of a DATE column; ``as_of_year`` makes the age reproducible."""
    day = _col(release_date)
    year, month = F.year(day), F.month(day)
    return {
        "release_year": year,
        "release_month": month,
        "release_is_q4": (month >= 10).cast("int"),
        "ea_cohort_post_2020": (year >= 2020).cast("int"),
        "years_since_release": F.lit(as_of_year) - year,
    }


def is_before_release(content_time, release_time) -> Column:
    """ISO time strings compared as instants; NULL when either is missing or no ISO date."""

    def instant(c):
        text = F.trim(_col(c))
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))

    return instant(content_time) < instant(release_time)


def data_complete(owners_min, total_reviews, critic_score) -> Column:
    known = _col(total_reviews).isNotNull() | _col(critic_score).isNotNull()
    return _col(owners_min).isNotNull() & known


def confidence(ratio) -> Column:
    """Distance of a ratio from an even split."""
    return F.abs(_col(ratio) - 0.5)


def guarded_ratio(numerator, denominator) -> Column:
    bottom = _col(denominator)
    return F.when(bottom > 0, _col(numerator) / bottom)


def effect_size(r) -> Column:
    size = F.abs(_col(r))
    return (
        F.when(size.isNull(), F.lit(None).cast("string"))
        .when(size < 0.1, "Negligible")
        .when(size < 0.3, "Small")
        .when(size < 0.5, "Medium")
        .otherwise("Large")
    )


def stars(p) -> Column:
    value = _col(p)
    return F.when(value < 0.001, "***").when(value < 0.01, "**").when(value < 0.05, "*").otherwise("")


def verdict(r, p) -> Column:
    """Support by significance and strength; the sign of ``r`` is reported beside it, not here."""
    significant = F.coalesce(_col(p) < 0.05, F.lit(False))
    return (
        F.when(significant & (F.abs(_col(r)) > 0.3), "SUPPORTED")
        .when(significant, "PARTIALLY SUPPORTED")
        .otherwise("NOT SUPPORTED")
    )
