"""Column functions: sanity ranges, ladders, verdict words, rounding, calendar, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plausible ranges of swing and checklist inputs.
RANGES = {
    "ret3m": (-0.95, 10.0),
    "relvol": (0.0, 50.0),
    "revenueGrowth": (-0.99, 49.0),
    "grossMarginAbs": (-0.5, 1.0),
    "grossMarginDelta": (-0.5, 0.5),
    "debtToEquity": (0.0, 50.0),
    "interestCoverage": (-100.0, 5000.0),
    "peRatio": (0.5, 500.0),
    "psRatio": (0.05, 200.0),
    "fwdPE": (1.0, 500.0),
}


def sane(x: Column, lo: float, hi: float) -> Column:
    """x inside [lo, hi], else null; NaN and infinities are null."""
    return F.when(~F.isnan(x) & x.between(lo, hi), x)


def in_range(x: Column, field: str) -> Column:
    return sane(x, *RANGES[field])


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves toward plus infinity."""
    k = 10.0**digits
    return F.floor(x * k + F.lit(0.5)) / k


def up(x: Column, *cuts: float) -> Column:
    """Points by how many of the rising cuts x reaches; null for null."""
    return F.when(x.isNotNull(), sum(((x >= c).cast("int") for c in cuts), F.lit(0)))


def down(x: Column, *cuts: float) -> Column:
    """Points by how many of the falling cuts x stays within; null for null."""
    return F.when(x.isNotNull(), sum(((x <= c).cast("int") for c in cuts), F.lit(0)))


def verdict_word(points: Column) -> Column:
    return F.when(points.isNull(), "na").when(points >= 3, "good").when(points >= 2, "ok").when(points >= 1, "weak").otherwise("bad")


def money(x: Column) -> Column:
    """K, M, B or T label."""
    a = F.abs(x)
    return (
        F.when(a >= 1e12, F.format_string("%.2fT", x / 1e12)).when(a >= 1e9, F.format_string("%.2fB", x / 1e9))
        .when(a >= 1e6, F.format_string("%.1fM", x / 1e6)).when(a >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%.0f", x))
    )


#: Words that say nothing about a company's identity.
GENERIC_WORDS = ("corp", "corporation", "company", "group", "holdings", "limited", "international", "technologies", "customer", "supplier")


def name_words(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS)))


def name_mismatch(known: Column, fresh: Column) -> Column:
    """True if no distinctive word of the known name is in the fresh one; false if there is none to look for."""
    words = name_words(known)
    return (F.size(words) > 0) & ~F.arrays_overlap(words, name_words(fresh))


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date).isin(1, 7)


def eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "America/New_York")


def good_friday(day: Column) -> Column:
    """Good Friday of the date's year (1900 to 2099), two days before Easter by Gauss's rule."""
    y = F.year(day)
    d = (19 * (y % 19) + 24) % 30
    e = (2 * (y % 4) + 4 * (y % 7) + 6 * d + 5) % 7
    late = (d + e == 35) | ((d == 28) & (e == 6) & (y % 19 > 10))
    return F.date_add(F.make_date(y, F.lit(3), F.lit(20)), (d + e - F.when(late, 7).otherwise(0)).cast("int"))


def is_market_holiday(day: Column) -> Column:
    """Full closures of the New York exchange by rule. A Saturday's holiday is kept on Friday, but for New Year's Day; a
    Sunday's on Monday. Juneteenth counts from 2022, Martin Luther King's birthday from 1998. Null stays null."""
    y, month, dom, dow = F.year(day), F.month(day), F.dayofmonth(day), F.dayofweek(day)  # 1 is Sunday
    nth = lambda m, weekday, first: (month == m) & (dow == weekday) & dom.between(first, first + 6)
    kept = lambda m, on: (month == m) & (((dom == on) & dow.between(2, 6)) | ((dom == on - 1) & (dow == 6)) | ((dom == on + 1) & (dow == 2)))
    new_year = (month == 1) & (((dom == 1) & dow.between(2, 6)) | ((dom == 2) & (dow == 2)))
    floating = (nth(1, 2, 15) & (y >= 1998)) | nth(2, 2, 15) | nth(5, 2, 25) | nth(9, 2, 1) | nth(11, 5, 22)
    return new_year | floating | (day == good_friday(day)) | (kept(6, 19) & (y >= 2022)) | kept(7, 4) | kept(12, 25)


def is_half_day(day: Column) -> Column:
    """Early closes: the day after Thanksgiving, and the days before Independence Day and Christmas from Monday to Thursday."""
    month, dom, dow = F.month(day), F.dayofmonth(day), F.dayofweek(day)
    eve = ((month == 7) & (dom == 3)) | ((month == 12) & (dom == 24))
    return ((month == 11) & (dow == 6) & dom.between(23, 29)) | (eve & dow.between(2, 5))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


#: Session bounds in minutes of the day.
OPEN, CLOSE, HALF_CLOSE, LATE_CLOSE = 570, 960, 780, 1200


def session_of(ts: Column, holiday: Column, half_day: Column) -> Column:
    """regular, after_hours (quarter hours after a full day's close) or none, for a local time."""
    m, closed = minute_of_day(ts), is_weekend(F.to_date(ts)) | holiday
    end = F.when(half_day, HALF_CLOSE).otherwise(CLOSE)
    return (
        F.when(closed, "none").when((m >= OPEN) & (m < end), "regular")
        .when(~half_day & (m >= CLOSE) & (m < LATE_CLOSE) & (m % 15 == 0), "after_hours").otherwise("none")
    )


def session_complete(bar_date: Column, now: Column, half_day: Column) -> Column:
    """Earlier days are complete, later ones not, the present one after its close."""
    today = F.to_date(now)
    return F.when(bar_date < today, True).when(bar_date > today, False).otherwise(minute_of_day(now) >= F.when(half_day, HALF_CLOSE).otherwise(CLOSE))


def summary_slot(ts: Column, half_day: Column) -> Column:
    """Top of the hours 10 to 16 (13 on half days), else null."""
    h = F.hour(ts)
    return F.when((F.minute(ts) == 0) & (h >= 10) & (h <= F.when(half_day, 13).otherwise(16)), h)
