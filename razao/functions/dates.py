"""Calendar days: parsing, month arithmetic, holidays and the banking calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from razao.functions.money import let, trimmed

BUSINESS_ZONE = "America/Sao_Paulo"


def day(value: str | dt.date | Column) -> Column:
    """A date literal, or the column as it is."""
    if isinstance(value, Column):
        return value
    return F.lit(value.isoformat() if isinstance(value, dt.date) else value).cast("date")


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` to a date; null for another shape or an impossible day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def ofx_date(text: Column) -> Column:
    """First eight digits only: the time zone suffix must not move the day."""
    digits = F.regexp_extract(trimmed(text), r"^\[?(?!0000)(\d{8})", 1)
    return F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")


def csv_date(text: Column) -> Column:
    """ISO, or day/month/year with ``/ . -``; two-digit years split at 69/70."""
    br = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})"

    def full_year(year: Column) -> Column:
        return (
            F.when(F.length(year) == 4, year)
            .when(year.try_cast("int") <= 69, F.concat(F.lit("20"), F.lpad(year, 2, "0")))
            .otherwise(F.concat(F.lit("19"), year))
        )

    def parts(raw: Column) -> Column:
        joined = F.concat_ws(
            "-",
            let(F.regexp_extract(raw, br, 3), full_year),
            F.lpad(F.regexp_extract(raw, br, 2), 2, "0"),
            F.lpad(F.regexp_extract(raw, br, 1), 2, "0"),
        )
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10)).when(
            raw.rlike(br), joined
        )

    common = text.rlike(r"^\d{2}/\d{2}/(?!0000)\d{4}\z")
    plain = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2))
    return F.when(common, plain.try_cast("date")).otherwise(let(let(trimmed(text), parts), iso_date))


def nfse_date(text: Column) -> Column:
    """ISO prefix or dd/mm/yyyy prefix."""
    raw = trimmed(text)
    iso = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1)
    br = F.regexp_extract(raw, r"^(\d{2}/\d{2}/\d{4})", 1)
    return F.when(iso != "", iso_date(iso)).when(br != "", F.try_to_date(br, "dd/MM/yyyy"))


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def month_end(date: Column) -> Column:
    return F.last_day(date)


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def today_brazil(instant: Column) -> Column:
    """Calendar day in São Paulo of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, BUSINESS_ZONE))


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous (Meeus/Jones/Butcher) computus."""

    def div(left: Column, right: int) -> Column:
        return F.floor(left / right)  # operands are small and positive: exact in doubles

    golden = year % 19
    century, within = div(year, 100), year % 100
    moon_shift = div(century - div(century + 8, 25) + 1, 3)
    epact = (19 * golden + century - div(century, 4) - moon_shift + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * div(within, 4) - epact - within % 4) % 7
    late = div(golden + 11 * epact + 22 * weekday, 451)
    index = epact + weekday - 7 * late + 114
    return F.make_date(year.cast("int"), div(index, 31).cast("int"), (index % 31 + 1).cast("int"))


# National holidays with a fixed month and day, and days from Easter Sunday.
FIXED_HOLIDAYS = ("01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "11-20", "12-25")
EASTER_OFFSETS = (-48, -47, -2, 60)


def is_national_holiday(date: Column) -> Column:
    fixed = F.date_format(date, "MM-dd").isin(*FIXED_HOLIDAYS)
    return fixed | F.datediff(date, easter_sunday(F.year(date))).isin(*EASTER_OFFSETS)


def is_business_day(date: Column) -> Column:
    """Neither weekend nor national holiday."""
    return ~is_weekend(date) & ~is_national_holiday(date)


def national_holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """One row per holiday of each year in ``years``; days that coincide appear once."""
    fixed = [
        F.make_date(F.col(year).cast("int"), F.lit(int(d[:2])), F.lit(int(d[3:])))
        for d in FIXED_HOLIDAYS
    ]
    movable = [F.date_add(easter_sunday(F.col(year)), offset) for offset in EASTER_OFFSETS]
    return years.select(
        F.col(year), F.explode(F.array_distinct(F.array(*fixed, *movable))).alias("holiday")
    )


def calendar_of(rows: DataFrame, date: str) -> DataFrame:
    """The calendar from the earliest to the latest ``date`` of ``rows``."""
    return _calendar(rows.agg(F.min(date).alias("first"), F.max(date).alias("last")).where("first IS NOT NULL"))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day: weekend, national holiday, business day, next and previous one.

    The table has as many rows as days between the bounds (some thousands for ten years), so
    it is safe to broadcast whatever the size of the ledger.
    """
    return _calendar(spark.sql(f"SELECT date'{first}' AS first, date'{last}' AS last"))


def _calendar(bounds: DataFrame) -> DataFrame:
    """``bounds`` is one row (first, last). The span is widened by 60 days for its edges."""
    span = F.sequence(F.date_sub("first", 60), F.date_add("last", 60))
    days = bounds.select("first", "last", F.explode(span).alias("date")).select(
        "first",
        "last",
        "date",
        is_weekend(F.col("date")).alias("is_weekend"),
        is_national_holiday(F.col("date")).alias("is_holiday"),
    )
    business = F.when(~F.col("is_weekend") & ~F.col("is_holiday"), F.col("date"))
    earlier = W.partitionBy("first").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("first").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, 0)
    return (
        days.withColumn("is_business_day", business.isNotNull())
        .withColumn("next_business_day", F.min(business).over(later))
        .withColumn("previous_business_day", F.max(business).over(earlier))
        .where(F.col("date").between(F.col("first"), F.col("last")))
        .drop("first", "last")
    )


def with_extra_holidays(
    entries: DataFrame, extra: DataFrame, date: str, key: str = "company_id"
) -> DataFrame:
    """Add ``is_business_day`` counting extra holidays ``(key, holiday)`` of each company."""
    marks = extra.select(
        F.col(key), F.col("holiday").alias(date), F.lit(True).alias("_extra")
    ).dropDuplicates([key, date])
    return (
        entries.join(marks, [key, date], "left")
        .withColumn("is_business_day", is_business_day(F.col(date)) & F.col("_extra").isNull())
        .drop("_extra")
    )


# Month names as the reports print them.
MONTH_NAMES = (
    "janeiro", "fevereiro", "marco", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)


def format_date(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def format_month(date: Column) -> Column:
    """``marco de 2025``"""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.concat(F.element_at(names, F.month(date)), F.lit(" de "), F.year(date).cast("string"))


def format_datetime(instant: Column) -> Column:
    """Local (São Paulo) day and time, short form."""
    return F.date_format(F.from_utc_timestamp(instant, BUSINESS_ZONE), "dd/MM/yyyy, HH:mm")
