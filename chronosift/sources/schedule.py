"""Scheduled releases: committee statements from a fixed list, payrolls by rule, and both as a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .macro import merge_calendars, nfp_date

# Days of scheduled committee statements (official schedule), one line a year.
STATEMENT_DAYS = """
2012-01-25 2012-03-13 2012-04-25 2012-06-20 2012-08-01 2012-09-13 2012-10-24 2012-12-12
2013-01-30 2013-03-20 2013-05-01 2013-06-19 2013-07-31 2013-09-18 2013-10-30 2013-12-18
2014-01-29 2014-03-19 2014-04-30 2014-06-18 2014-07-30 2014-09-17 2014-10-29 2014-12-17
2015-01-28 2015-03-18 2015-04-29 2015-06-17 2015-07-29 2015-09-17 2015-10-28 2015-12-16
2016-01-27 2016-03-16 2016-04-27 2016-06-15 2016-07-27 2016-09-21 2016-11-02 2016-12-14
2017-02-01 2017-03-15 2017-05-03 2017-06-14 2017-07-26 2017-09-20 2017-11-01 2017-12-13
2018-01-31 2018-03-21 2018-05-02 2018-06-13 2018-08-01 2018-09-26 2018-11-08 2018-12-19
2019-01-30 2019-03-20 2019-05-01 2019-06-19 2019-07-31 2019-09-18 2019-10-30 2019-12-11
2020-01-29 2020-03-18 2020-04-29 2020-06-10 2020-07-29 2020-09-16 2020-11-05 2020-12-16
2021-01-27 2021-03-17 2021-04-28 2021-06-16 2021-07-28 2021-09-22 2021-11-03 2021-12-15
2022-01-26 2022-03-16 2022-05-04 2022-06-15 2022-07-27 2022-09-21 2022-11-02 2022-12-14
2023-02-01 2023-03-22 2023-05-03 2023-06-14 2023-07-26 2023-09-20 2023-11-01 2023-12-13
2024-01-31 2024-03-20 2024-05-01 2024-06-12 2024-07-31 2024-09-18 2024-11-07 2024-12-18
2025-01-29 2025-03-19 2025-05-07 2025-06-18 2025-07-30 2025-09-17 2025-10-29 2025-12-10
2026-01-28 2026-03-18 2026-04-29 2026-06-17 2026-07-29 2026-09-16 2026-10-28 2026-12-09
2027-01-27 2027-03-17 2027-04-28 2027-06-09 2027-07-28 2027-09-15 2027-10-27 2027-12-08
"""
# New York times; 14:00 since 2013, in 2012 12:30 but for these days at 14:15.
LATE_2012 = "2012-03-13 2012-08-01 2012-10-24"

EVENTS = "time timestamp_ntz, name string, currency string, importance long, source string, approximate boolean"


def new_york(day: Column, clock: Column) -> Column:
    """A New York wall time as UTC, daylight saving included."""
    local = F.to_timestamp(F.concat_ws(" ", day.cast("string"), clock))
    return F.to_utc_timestamp(local, "America/New_York").cast("timestamp_ntz")


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENTS)


def _within(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Events from start to end; a bare end date means its whole day."""
    out = events if start is None else events.filter(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is None:
        return out
    last = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return out.filter(F.col("time") < last if len(end) == 10 else F.col("time") <= F.lit(end).cast("timestamp_ntz"))


def statements(spark: SparkSession, start: str | None = None, end: str | None = None) -> DataFrame:
    """Committee statements; what is before 2016 or after September 2026 has times by practice, and so is approximate."""
    days = spark.createDataFrame([(d,) for d in STATEMENT_DAYS.split()], "d string").select(F.to_date("d").alias("d"))
    clock = F.when(F.col("d").cast("string").isin(LATE_2012.split()), "14:15").when(F.year("d") == 2012, "12:30").otherwise("14:00")
    rough = (F.year("d") < 2016) | (F.col("d") > F.lit("2026-09-16").cast("date")) | (F.col("d") == F.lit("2020-03-18").cast("date"))
    rows = days.select(new_york(F.col("d"), clock).alias("time"), F.lit("FOMC").alias("name"), F.lit("USD").alias("currency"), F.lit(3).cast("long").alias("importance"), F.lit("schedule").alias("source"), rough.alias("approximate"))
    return _within(rows, start, end)


def payroll_day(month_start: Column, rule: str = "first_friday") -> Column:
    """The day of a month's payrolls: its first Friday, or the third after the week of the former month's 12th.

    New Year's Day moves a week on; the third and fourth of July a day back.
    """
    if rule == "first_friday":
        day = nfp_date(month_start)
    elif rule == "bls":
        twelfth = F.date_add(F.add_months(month_start, -1), 11)
        saturday = F.date_add(twelfth, F.pmod(5 - F.weekday(twelfth), F.lit(7)))
        day = F.date_add(saturday, 20)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    first = (F.month(day) == 1) & (F.dayofmonth(day) == 1)
    july = (F.month(day) == 7) & F.dayofmonth(day).isin(3, 4)
    return F.when(first, F.date_add(day, 7)).when(july, F.date_sub(day, 1)).otherwise(day)


def calendar(spark: SparkSession, start: str, end: str, *, include: tuple[str, ...] = ("NFP", "FOMC"), rule: str = "first_friday") -> DataFrame:
    """Payrolls at 08:30 New York by rule, and committee statements, from start to end."""
    unknown = set(include) - {"NFP", "FOMC"}
    if unknown:
        raise ValueError(f"no schedule for {sorted(unknown)}")
    parts = []
    if "NFP" in include:
        months = spark.sql(f"SELECT explode(sequence(trunc(DATE '{start[:10]}', 'MM'), DATE '{end[:10]}', INTERVAL 1 MONTH)) AS m")
        parts.append(months.select(new_york(payroll_day(F.col("m"), rule), F.lit("08:30")).alias("time"), F.lit("NFP").alias("name"), F.lit("USD").alias("currency"), F.lit(3).cast("long").alias("importance"), F.lit("rule").alias("source"), F.lit(True).alias("approximate")))
    if "FOMC" in include:
        parts.append(statements(spark))
    return _within(merge_calendars(*parts), start, end) if parts else empty_events(spark)


def important(events: DataFrame, least: int = 3) -> DataFrame:
    """Events of at least this importance; an unknown one counts as high. Outcomes are left out."""
    hidden = {"actual", "forecast", "previous", "surprise"}
    return events.filter(F.coalesce("importance", F.lit(3)) >= least).select(*[c for c in events.columns if c.lower() not in hidden]).orderBy("time")
