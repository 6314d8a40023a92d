"""Holiday calendar from rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "holiday_name string, kind string, month int, day int, weekday int, shift int, observed boolean, "
    "first_year int, last_year int"
)

# Public holidays of the United States and of New York State.
# kind "date": month and day; "nth": the day-th weekday (0 = Monday) of the month; "last": the last
# one. ``shift`` days are added. ``observed`` holidays get a second day when they fall on a weekend.
# The last two are the first and last year in which a holiday is kept, where there is one.
US_NY_RULES = [
    ("New Year's Day", "date", 1, 1, None, 0, True, None, None),
    ("Martin Luther King Jr. Day", "nth", 1, 3, 0, 0, False, 1986, None),
    ("Lincoln's Birthday", "date", 2, 12, None, 0, True, None, None),
    ("Susan B. Anthony Day", "date", 2, 15, None, 0, False, 2004, None),
    ("Washington's Birthday", "nth", 2, 3, 0, 0, False, None, None),
    ("Memorial Day", "last", 5, None, 0, 0, False, None, None),
    ("Juneteenth National Independence Day", "date", 6, 19, None, 0, True, 2021, None),
    ("Independence Day", "date", 7, 4, None, 0, True, None, None),
    ("Labor Day", "nth", 9, 1, 0, 0, False, None, None),
    ("Columbus Day", "nth", 10, 2, 0, 0, False, None, None),
    ("Election Day", "nth", 11, 1, 0, 1, False, None, None),
    ("Veterans Day", "date", 11, 11, None, 0, True, None, None),
    ("Thanksgiving", "nth", 11, 4, 3, 0, False, None, None),
    ("Christmas Day", "date", 12, 25, None, 0, True, None, None),
]


def rules_table(spark: SparkSession, rules: list[tuple] = US_NY_RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def holiday_calendar(rules: DataFrame, first_year: Column | int, last_year: Column | int) -> DataFrame:
    """Dates and names of the holidays of the years, both ends included."""
    lo, hi = (y if isinstance(y, Column) else F.lit(y) for y in (first_year, last_year))
    # One year more at each end: an observed day may fall into the neighbouring year.
    years = F.explode(F.sequence(lo - 1, hi + 1)).alias("year")
    first = F.make_date("year", "month", F.lit(1))
    end = F.last_day(first)
    nth = F.date_add(first, F.pmod(F.col("weekday") - F.weekday(first), F.lit(7)) + 7 * (F.col("day") - 1))
    last = F.date_sub(end, F.pmod(F.weekday(end) - F.col("weekday"), F.lit(7)))
    day = (
        F.when(F.col("kind") == "date", F.make_date("year", "month", "day"))
        .when(F.col("kind") == "nth", nth)
        .when(F.col("kind") == "last", last)
    )
    kept = F.col("year").between(F.coalesce("first_year", "year"), F.coalesce("last_year", "year"))
    dated = rules.select("*", years).where(kept).withColumn("date", F.date_add(day, F.col("shift")))
    off = F.when(F.weekday("date") == 5, -1).when(F.weekday("date") == 6, 1)
    moved = (
        dated.where(F.col("observed") & off.isNotNull())
        .withColumn("date", F.date_add("date", off))
        .withColumn("holiday_name", F.concat("holiday_name", F.lit(" (observed)")))
    )
    return (
        dated.unionByName(moved)
        .where(F.year("date").between(lo, hi))
        .select("date", "holiday_name")
    )
