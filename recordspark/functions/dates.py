"""Dates and times. Texts are read leniently; time zones are the session's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.functions.base import col, let, number, text, verb

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Letters of date patterns and Spark's.
TOKENS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}


def moment(v) -> Column:
    return F.try_to_timestamp(text(v))


def day(v) -> Column:
    return moment(v).cast("date")


def pattern(p: str) -> str:
    """A pattern of TOKENS in Spark's letters, all others quoted."""
    parts = re.split("(" + "|".join(TOKENS) + ")", p)
    return "".join(TOKENS.get(x) or ("'" + x.replace("'", "''") + "'" if x else "") for x in parts)


verb("today")(lambda: F.current_date())
verb("now")(lambda: F.current_timestamp())
verb("formatDate")(lambda d, p: F.date_format(moment(d), pattern(p)))
verb("formatTime")(lambda t, p="HH:mm:ss": F.date_format(moment(t), pattern(p)))
verb("formatTimestamp")(lambda t, p=None: F.date_format(moment(t), pattern(p) if p else ISO))
verb("parseDate")(lambda s, p: F.coalesce(F.try_to_timestamp(text(s), F.lit(pattern(p))), moment(s)).cast("date"))
verb("parseTimestamp")(lambda s, *ignored: moment(s))
verb("addDays")(lambda d, n: F.date_add(day(d), col(n).cast("int")))
verb("addMonths")(lambda d, n: F.add_months(day(d), col(n).cast("int")))
verb("addYears")(lambda d, n: F.add_months(day(d), col(n).cast("int") * 12))
verb("addHours")(lambda t, n: moment(t) + F.make_dt_interval(hours=col(n).cast("int")))
verb("addMinutes")(lambda t, n: moment(t) + F.make_dt_interval(mins=col(n).cast("int")))
verb("addSeconds")(lambda t, n: moment(t) + F.make_dt_interval(secs=col(n).cast("decimal(18,6)")))
verb("startOfDay")(lambda t: F.date_trunc("day", moment(t)))
verb("endOfDay")(lambda t: F.date_trunc("day", moment(t)) + F.expr("interval '23:59:59.999' hour to second"))
verb("startOfMonth")(lambda d: F.trunc(day(d), "month"))
verb("endOfMonth")(lambda d: F.last_day(day(d)))
verb("startOfYear")(lambda d: F.trunc(day(d), "year"))
verb("endOfYear")(lambda d: F.make_date(F.year(day(d)), F.lit(12), F.lit(31)))
verb("dayOfWeek")(lambda d: F.dayofweek(day(d)) - 1)
verb("quarter")(lambda d: F.quarter(day(d)))
verb("isBefore")(lambda a, b: moment(a) < moment(b))
verb("isAfter")(lambda a, b: moment(a) > moment(b))
verb("isBetween")(lambda d, a, b: moment(d).between(moment(a), moment(b)))
verb("toUnix")(lambda t: F.unix_seconds(moment(t)))
verb("fromUnix")(lambda n: F.timestamp_seconds(number(n).cast("bigint")))
verb("daysBetweenDates")(lambda a, b: F.abs(F.datediff(day(b), day(a))))
verb("isValidDate")(lambda s, *ignored: F.coalesce(text(s).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False)) & F.try_to_date(F.substring(text(s), 1, 10)).isNotNull())


@verb("weekOfYear")
def week_of_year(d):
    """ISO weeks, but days of late December stay in the old year's last week."""
    week = F.weekofyear(day(d))
    return F.when((F.month(day(d)) == 12) & (week == 1), 53).otherwise(week)


@verb("isLeapYear")
def is_leap_year(v):
    y = F.coalesce(text(v).try_cast("int"), F.year(day(v)))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


@verb("dateDiff")
def date_diff(a, b, unit: str = "days"):
    """From a to b: days, or differences of calendar months or years."""
    x, y = day(a), day(b)
    if unit == "days":
        return F.datediff(y, x)
    years = F.year(y) - F.year(x)
    if unit not in ("months", "years"):
        raise ValueError(f"unit {unit!r}; known: days, months, years")
    return years if unit == "years" else years * 12 + F.month(y) - F.month(x)


@verb("ageFromDate")
def age_from_date(d, on=None):
    """Whole years until today, or until another day."""
    now = F.current_date() if on is None else day(on)
    early = F.date_format(now, "MMdd") < F.date_format(day(d), "MMdd")
    return F.year(now) - F.year(day(d)) - F.when(early, 1).otherwise(0)


@verb("nextBusinessDay")
def next_business_day(d):
    w = F.dayofweek(day(d))
    return F.date_add(day(d), F.when(w == 7, 2).when(w == 1, 1).otherwise(0))


@verb("businessDays")
def business_days(d, n: int):
    """n days from Monday to Friday on, or back."""
    d = day(d)
    if n == 0:
        return d
    at = F.weekday(d)  # Monday is 0
    if n > 0:
        start = F.least(at, F.lit(4))  # a weekend counts from its Friday
        steps = start + n
        return F.date_add(F.date_sub(d, at), (F.floor(steps / 5) * 7 + steps % 5).cast("int"))
    start = F.when(at > 4, F.lit(5)).otherwise(at)
    steps = start + n
    return F.date_add(F.date_sub(d, at), (F.floor(steps / 5) * 7 + F.pmod(steps, F.lit(5))).cast("int"))


#: Language -> short and long pattern.
LOCALES = {
    "en-US": ("M/d/yyyy", "EEEE, MMMM d, yyyy"), "en-GB": ("dd/MM/yyyy", "EEEE, d MMMM yyyy"), "de-DE": ("dd.MM.yyyy", "EEEE, d. MMMM yyyy"),
    "fr-FR": ("dd/MM/yyyy", "EEEE d MMMM yyyy"), "es-ES": ("d/M/yyyy", "EEEE, d 'de' MMMM 'de' yyyy"), "ja-JP": ("yyyy/MM/dd", "yyyy年M月d日"),
}


@verb("formatLocaleDate")
def format_locale_date(d, locale: str, form: str = "short"):
    """Names of days and months are English: Spark's date_format has the session's language alone."""
    short, long = LOCALES.get(locale, ("MM/dd/yyyy", "EEEE, dd MMMM yyyy"))
    return F.date_format(day(d), {"short": short, "long": long}.get(form, form))


DURATION = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


@verb("formatDuration")
def format_duration(s):
    """An ISO duration in words. One match gives all its numbers; each is read once."""
    units = F.array(*map(F.lit, ("year", "month", "day", "hour", "minute", "second")))

    def words(n: Column, unit: Column) -> Column:
        whole = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(F.format_string("%.1f", n))
        return F.when(n > 0, F.concat(whole, F.lit(" "), unit, F.when(n == 1, F.lit("")).otherwise(F.lit("s"))))

    def written(s: Column) -> Column:
        # a number that is not there is empty; what may follow a match is the end of a line
        numbers = F.split(F.regexp_replace(s, DURATION + r"[\s\S]*", "$1,$2,$3,$4,$5,$6"), ",")
        joined = F.concat_ws(", ", F.zip_with(numbers, units, lambda x, unit: F.when(x != "", let(x.try_cast("double"), lambda n: words(n, unit)))))
        return let(joined, lambda x: F.when(x == "", F.lit("0 seconds")).otherwise(x))

    s = text(s)
    return F.when(s.rlike(DURATION), written(s))
