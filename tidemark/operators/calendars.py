"""Exchange calendars from rule tables: holidays, early closes, opening hours in UTC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import eastern_to_utc

#: Days of a week, Monday 0, that stand where a rule's day falls: moved by so many days, or dropped (null).
Moves = tuple[int | None, int | None, int | None, int | None, int | None, int | None, int | None]
STAYS: Moves = (0, 0, 0, 0, 0, 0, 0)
#: A Saturday's holiday is kept on Friday, a Sunday's on Monday.
NEAREST: Moves = (0, 0, 0, 0, 0, -1, 1)
#: A Sunday's holiday is kept on Monday, a Saturday's isn't kept.
SUNDAY_ONLY: Moves = (0, 0, 0, 0, 0, None, 1)
#: Days before a holiday that close early only from Monday to Thursday.
TO_THURSDAY: Moves = (0, 0, 0, 0, None, None, None)


@dataclass(frozen=True)
class Rule:
    """A yearly day: a fixed (month, day), the n-th weekday of a month (n = -1: the last), or days from Easter Sunday; then `plus` days, and moved."""

    name: str
    month: int = 0
    day: int = 0
    weekday: int | None = None
    n: int = 0
    easter: int | None = None
    plus: int = 0
    since: int = 0
    until: int = 9999
    moves: Moves = STAYS


# The New York exchange's yearly holidays, early closes at 13:00, and single days without trade.
HOLIDAYS = (
    Rule("new_year", 1, 1, moves=SUNDAY_ONLY),
    Rule("martin_luther_king", 1, weekday=0, n=3, since=1998),
    Rule("presidents", 2, weekday=0, n=3),
    Rule("good_friday", easter=-2),
    Rule("memorial", 5, weekday=0, n=-1),
    Rule("juneteenth", 6, 19, since=2022, moves=NEAREST),
    Rule("independence", 7, 4, moves=NEAREST),
    Rule("labor", 9, weekday=0, n=1),
    Rule("thanksgiving", 11, weekday=3, n=4),
    Rule("christmas", 12, 25, moves=NEAREST),
)
EARLY_CLOSES = (
    Rule("before_independence", 7, 3, moves=TO_THURSDAY),
    Rule("after_thanksgiving", 11, weekday=3, n=4, plus=1),
    Rule("christmas_eve", 12, 24, moves=TO_THURSDAY),
)
CLOSED_DAYS = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def easter_sunday(year: Column) -> Column:
    """The Gregorian Easter Sunday of a year (from 1583), by the golden number, century corrections and the epact."""
    golden, century = year % 19, F.floor(year / 100)
    leap, lunar = century - F.floor(century / 4), F.floor((8 * century + 13) / 25)
    epact = F.pmod(leap - lunar + 19 * golden + 15, F.lit(30))  # days from 21 March to the full moon
    full_moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    march_21 = F.make_date(year, F.lit(3), F.lit(21))
    moon = F.date_add(march_21, full_moon.cast("int"))
    return F.date_add(moon, 7 - (F.weekday(moon) + 1) % 7)  # the Sunday after it


def day_of(rule: Rule, year: Column) -> Column:
    """The rule's day in a year; null if it isn't kept then."""
    if rule.easter is not None:
        day = F.date_add(easter_sunday(year), rule.easter)
    elif rule.weekday is None:
        day = F.make_date(year, F.lit(rule.month), F.lit(rule.day))
    elif rule.n > 0:
        first = F.make_date(year, F.lit(rule.month), F.lit(1))
        day = F.date_add(first, F.pmod(rule.weekday - F.weekday(first), F.lit(7)) + 7 * (rule.n - 1))
    else:
        last = F.last_day(F.make_date(year, F.lit(rule.month), F.lit(1)))
        day = F.date_sub(last, F.pmod(F.weekday(last) - rule.weekday, F.lit(7)) + 7 * (-rule.n - 1))
    day = F.date_add(day, rule.plus)
    moves = F.array(*(F.lit(m).cast("int") for m in rule.moves))
    return F.when(year.between(rule.since, rule.until), F.date_add(day, F.get(moves, F.weekday(day))))


def rule_days(days: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """date, name: the days of the rules in the years of `days` and those next to them, whose rules may move into them. A few rows a year."""
    years = days.select(F.year("date").alias("y")).distinct().select(F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y")).distinct()
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("name"), day_of(r, F.col("y")).alias("date")) for r in rules))).alias("r")
    return years.select(each).select("r.date", "r.name").where("date IS NOT NULL").dropDuplicates(["date"])


def exchange_calendar(
    days: DataFrame, holidays: tuple[Rule, ...] = HOLIDAYS, early: tuple[Rule, ...] = EARLY_CLOSES, closed: tuple[str, ...] = CLOSED_DAYS, opens: str = "093000", closes: str = "160000", closes_early: str = "130000"
) -> DataFrame:
    """SRC-17: date, market_open, market_close, is_early_close, is_holiday, session_idx of every date of `days`.

    Sessions are the weekdays that are no holiday; opening hours are wall-clock times of New York as UTC times without zone,
    summer time heeded; both are null, and so is session_idx, on days without a session. is_holiday says that a weekday
    isn't a session. session_idx numbers the sessions of `days` from 0. One row a day.
    """
    days = days.select("date").distinct()
    off = rule_days(days, holidays).select("date").unionByName(days.sparkSession.createDataFrame([(c,) for c in closed], "date string").select(F.col("date").cast("date"))).distinct()
    x = days.join(off.withColumn("_off", F.lit(True)), "date", "left").join(rule_days(days, early).select("date", F.lit(True).alias("_early")), "date", "left")
    weekday = F.weekday("date") < 5
    session = weekday & F.col("_off").isNull()
    short = F.coalesce(session & F.col("_early"), F.lit(False))
    at = lambda clock: eastern_to_utc(F.concat(F.date_format("date", "yyyyMMdd"), clock))
    x = x.select(
        "date", F.when(session, at(F.lit(opens))).alias("market_open"), F.when(session, at(F.when(short, F.lit(closes_early)).otherwise(F.lit(closes)))).alias("market_close"), short.alias("is_early_close"), (weekday & ~session).alias("is_holiday")
    )
    number = F.count("market_open").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - 1  # one row a day
    return x.withColumn("session_idx", F.when(F.col("market_open").isNotNull(), number))


def trading_hours(calendar: DataFrame) -> DataFrame:
    """session_idx, date, open_at, close_at of the sessions, as first_tradable() takes them."""
    return calendar.where("session_idx IS NOT NULL").select("session_idx", "date", F.col("market_open").alias("open_at"), F.col("market_close").alias("close_at"))


def days_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every date from first to last (yyyy-MM-dd)."""
    return spark.sql("SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE))) AS date", {"a": first, "b": last})
