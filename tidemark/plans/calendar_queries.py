"""Exchange calendars over the tables' dates, with an oracle that writes the holidays out on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars
from ..operators import filing_events as ev
from . import tables as t
from .tables import query

# US daylight saving time by the rules of 1987 (first Sunday of April to last of October) and 2007 (second of March to first of November); Easter by the anonymous Gregorian method
_CALENDAR = """
y AS (SELECT unnest(generate_series(CAST(min(year(date)) AS INTEGER) - 1, CAST(max(year(date)) AS INTEGER) + 1)) AS y FROM days0),
ea AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
eb AS (SELECT y, a, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h, b % 4 AS e, c // 4 AS i, c % 4 AS k FROM ea),
ec AS (SELECT y, a, h, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM eb),
ed AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM ec),
easter AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS d FROM ed),
mondays AS (SELECT y, m, d, row_number() OVER (PARTITION BY y, m, isodow(d) ORDER BY d) AS nth, row_number() OVER (PARTITION BY y, m, isodow(d) ORDER BY d DESC) AS nth_last, isodow(d) AS wd
  FROM (SELECT y, month(d) AS m, d FROM (SELECT y, CAST(unnest(generate_series(make_date(y, 1, 1)::TIMESTAMP, make_date(y, 12, 31)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM y))),
fixed AS (SELECT make_date(y, 7, 4) AS d FROM y UNION ALL SELECT make_date(y, 12, 25) FROM y UNION ALL SELECT make_date(y, 6, 19) FROM y WHERE y >= 2022),
hol AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS d FROM fixed
  UNION ALL SELECT CASE isodow(d) WHEN 7 THEN d + 1 ELSE d END FROM (SELECT make_date(y, 1, 1) AS d FROM y) WHERE isodow(d) <> 6
  UNION ALL SELECT d - 2 FROM easter UNION ALL SELECT d FROM mondays WHERE (m = 1 AND wd = 1 AND nth = 3 AND y >= 1998) OR (m = 2 AND wd = 1 AND nth = 3) OR (m = 5 AND wd = 1 AND nth_last = 1) OR (m = 9 AND wd = 1 AND nth = 1) OR (m = 11 AND wd = 4 AND nth = 4)
  UNION ALL SELECT CAST(unnest(['1994-04-27', '2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14', '2004-06-11', '2007-01-02', '2012-10-29', '2012-10-30', '2018-12-05', '2025-01-09']) AS DATE)),
early AS (SELECT d FROM mondays WHERE (m = 7 AND day(d) = 3 AND wd < 5) OR (m = 12 AND day(d) = 24 AND wd < 5) UNION ALL SELECT d + 1 FROM mondays WHERE m = 11 AND wd = 4 AND nth = 4),
dst AS (SELECT y, max(CASE WHEN y >= 2007 AND m = 3 AND nth = 2 OR y < 2007 AND m = 4 AND nth = 1 THEN d END) AS a, max(CASE WHEN y >= 2007 AND m = 11 AND nth = 1 OR y < 2007 AND m = 10 AND nth_last = 1 THEN d END) AS b FROM mondays WHERE wd = 7 GROUP BY y),
c0 AS (SELECT date, isodow(date) < 6 AS weekday, date IN (SELECT d FROM hol) AS off, date IN (SELECT d FROM early) AS short, CASE WHEN date >= a AND date < b THEN 4 ELSE 5 END AS shift FROM days0 JOIN dst ON y = year(date)),
calendar AS (SELECT date, CASE WHEN weekday AND NOT off THEN CAST(date AS TIMESTAMP) + to_minutes(570 + 60 * shift) END AS market_open, CASE WHEN weekday AND NOT off THEN CAST(date AS TIMESTAMP) + to_minutes(CASE WHEN short THEN 780 ELSE 960 END + 60 * shift) END AS market_close,
  weekday AND NOT off AND short AS is_early_close, weekday AND off AS is_holiday, CASE WHEN weekday AND NOT off THEN count(CASE WHEN weekday AND NOT off THEN 1 END) OVER (ORDER BY date) - 1 END AS session_idx FROM c0)
"""
_DAYS = "days0 AS (SELECT CAST(unnest(generate_series(min(x)::TIMESTAMP, max(x)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT CAST({} AS DATE) AS x FROM {}))"


def _days(spark, d, table, column):
    return t.table(spark, d, table).agg(F.min(F.to_date(column)).alias("a"), F.max(F.to_date(column)).alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))


@query(f"WITH {_DAYS.format('l_shipdate', 'lineitem')}, {_CALENDAR} SELECT * FROM calendar")
def src_17_exchange_calendar(spark, d):
    """SRC-17: every day from the first to the last shipment with opening hours in UTC, early closes and holidays."""
    return calendars.exchange_calendar(_days(spark, d, "lineitem", "l_shipdate"))


@query(f"""WITH {_DAYS.format('ts', 'events')}, {_CALENDAR},
cal AS (SELECT session_idx, date, market_open AS open_at, market_close AS close_at FROM calendar WHERE session_idx IS NOT NULL),
e AS (SELECT event_id, ts, (SELECT min(session_idx) FROM cal WHERE date >= CAST(ts AS DATE)) AS i FROM events),
x AS (SELECT e.*, c.open_at, c.close_at, c.date, n.open_at AS next_open, n.date AS next_date, CASE WHEN date_trunc('minute', ts + INTERVAL 5 MINUTE) < ts + INTERVAL 5 MINUTE THEN date_trunc('minute', ts + INTERVAL 5 MINUTE) + INTERVAL 1 MINUTE ELSE ts + INTERVAL 5 MINUTE END AS m
  FROM e LEFT JOIN cal c ON c.session_idx = e.i LEFT JOIN cal n ON n.session_idx = e.i + 1)
SELECT event_id, CASE WHEN ts < open_at THEN open_at + INTERVAL 5 MINUTE WHEN ts >= close_at THEN next_open + INTERVAL 5 MINUTE WHEN m <= close_at THEN m ELSE next_open END AS tradable_at,
  CASE WHEN ts < open_at OR (ts < close_at AND m <= close_at) THEN date ELSE next_date END AS entry_session FROM x""")
def win_29_src_17_tradable_hours(spark, d):
    """WIN-29 by the exchange's own hours."""
    cal = calendars.trading_hours(calendars.exchange_calendar(_days(spark, d, "events", "ts")))
    return ev.first_tradable(t.table(spark, d, "events").select("event_id", "ts"), cal, "ts").select("event_id", "tradable_at", "entry_session")
