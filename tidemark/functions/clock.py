"""Civil days, months and exchange wall time as column expressions.

Nothing here depends on the session time zone. New York wall time is checked by
round trip: an instant belongs to a wall time when converting it forward gives
that wall time back. No candidate means the wall time was skipped, two mean it
occurred twice; both are reported rather than guessed.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def floor_div(x: Column, by: int) -> Column:
    """Floor division of BIGINT; ``div`` truncates toward zero instead."""
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("bigint")


def _ny_wall(utc_ms: Column) -> Column:
    shifted = F.from_utc_timestamp(F.timestamp_millis(utc_ms), fixed.NEW_YORK)
    return F.unix_millis(shifted)


def _shows(utc: Column, wall_ms: Column) -> Column:
    """True when the instant is in the known table and shows this wall time."""
    known = (utc >= 0) & (utc < fixed.NEW_YORK_TABLE_END_MS)
    return F.coalesce(known & (_ny_wall(utc) == wall_ms), F.lit(False))


def _supported(wall_ms: Column) -> Column:
    return (wall_ms > 0) & (wall_ms <= fixed.MAX_INSTANT_MS)


def wall_matches(wall_ms: Column) -> Column:
    """Number of instants showing this wall time: 1 is normal."""
    found = [_shows(wall_ms - o, wall_ms).cast("int") for o in fixed.NEW_YORK_OFFSETS_MS]
    return F.when(_supported(wall_ms), found[0] + found[1]).otherwise(0)


def wall_to_utc(wall_ms: Column) -> Column:
    """The one instant of a wall time, NULL when skipped or ambiguous."""
    first, second = [wall_ms - o for o in fixed.NEW_YORK_OFFSETS_MS]
    in_first, in_second = _shows(first, wall_ms), _shows(second, wall_ms)
    one = F.when(in_first, F.when(~in_second, first)).when(in_second, second)
    return F.when(_supported(wall_ms), one)


def utc_to_wall(utc_ms: Column) -> Column:
    """Wall time of an instant, NULL when it would not convert back.

    Only an instant one hour off can show the same wall time.
    """
    known = (utc_ms >= 0) & (utc_ms < fixed.NEW_YORK_TABLE_END_MS)
    wall = _ny_wall(utc_ms)
    hour = 3600000
    twice = _shows(utc_ms + hour, wall) | _shows(utc_ms - hour, wall)
    return F.when(known & _supported(wall) & ~twice, wall)


def stored_ms(utc_ms: Column, market: Column) -> Column:
    """Time axis on which a market is stored: wall time for US, UTC otherwise."""
    return F.when(market == "US", utc_to_wall(utc_ms)).otherwise(utc_ms)


def served_ms(stored: Column, market: Column) -> Column:
    return F.when(market == "US", wall_to_utc(stored)).otherwise(stored)


def stored_day(stored: Column, market: Column) -> Column:
    """Exchange-local civil day of a stored time."""
    shift = F.when(market == "US", 0).otherwise(fixed.CN_OFFSET_MS)
    return floor_div(stored + shift, fixed.DAY_MS).cast("int")


def local_civil_day(utc_ms: Column, market: Column) -> Column:
    return stored_day(stored_ms(utc_ms, market), market)


def day_date(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))


def months_of(start_stored: Column, end_stored: Column, market: Column) -> Column:
    """Array of yyyyMM touched by the half-open range, in exchange-local time."""
    first = F.trunc(day_date(stored_day(start_stored, market)), "MM")
    last = F.trunc(day_date(stored_day(end_stored - 1, market)), "MM")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.date_format(m, "yyyyMM"))


def month_of(stored: Column, market: Column) -> Column:
    return F.date_format(day_date(stored_day(stored, market)), "yyyyMM")


def strict_date(text: Column) -> Column:
    """DATE of canonical YYYY-MM-DD text, NULL for anything else."""
    shaped = F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text)
    parsed = F.try_to_date(shaped, "yyyy-MM-dd")
    return F.when(F.date_format(parsed, "yyyy-MM-dd") == text, parsed)


def request_bounds(start_ms: Column, end_ms: Column) -> Column:
    """True for a half-open range inside the clock and at most a leap year long."""
    ok = (
        (start_ms > 0)
        & (end_ms > start_ms)
        & (end_ms <= fixed.MAX_INSTANT_MS)
        & (end_ms - start_ms <= fixed.MAX_SPAN_DAYS * fixed.DAY_MS)
    )
    return F.coalesce(ok, F.lit(False))


def check_deadline(
    market: Column, policy: Column, next_day: Column, check_minute: Column
) -> Column:
    """UTC instant at which a factor set has to be checked again, NULL if none."""
    wall = next_day.cast("bigint") * fixed.DAY_MS + check_minute.cast("bigint") * 60000
    source = F.when(market == "US", wall_to_utc(wall)).otherwise(wall - fixed.CN_OFFSET_MS)
    end_of_day = wall + fixed.DAY_MS - fixed.CN_OFFSET_MS
    return F.when(policy == fixed.POLICY_END_OF_DAY, end_of_day).when(
        policy == fixed.POLICY_SOURCE, source
    )


def check_problem(check: Callable[[str], Column], market: Column, observed_ms: Column, until_ms: Column) -> Column:
    """First reason a factor check does not vouch for its set until ``until_ms``, NULL if it does.

    ``check`` gives the columns policy, exchange, trading_day, next_day, check_minute,
    source_revision and completed_ms of the check. At the end of a trading day it waits until the
    market has closed; at the source it follows a fixed minute of the day.
    """
    day, next_day, minute = (check(n).cast("bigint") for n in ("trading_day", "next_day", "check_minute"))
    end_of_day = check("policy") == fixed.POLICY_END_OF_DAY
    abroad = market == "US"
    codes = F.create_map(*[F.lit(x) for pair in fixed.EXCHANGES.items() for x in pair])

    def instant(of_day: Column, at: Column) -> Column:
        wall = of_day * fixed.DAY_MS + at * 60000
        return F.when(abroad, wall_to_utc(wall)).otherwise(wall - fixed.CN_OFFSET_MS)

    closed = day * fixed.DAY_MS + F.when(abroad, fixed.DAY_MS).otherwise(15 * 3600000)
    usual_minute = F.when(abroad, 600).otherwise(60)
    last_minute = F.when(abroad, 239).otherwise(554)
    deadline = check_deadline(market, check("policy"), next_day, minute)
    earliest = F.when(end_of_day, closed).otherwise(instant(day, F.lit(0)))
    rules = {
        "policy": end_of_day | (check("policy") == fixed.POLICY_SOURCE),
        "exchange": F.try_element_at(codes, market) == check("exchange"),
        "calendar": (day >= 0) & (next_day > day) & (next_day - day <= fixed.MAX_CHECK_GAP_DAYS)
        & (next_day <= fixed.LAST_CIVIL_DAY),
        "minute": F.when(end_of_day, minute == usual_minute).otherwise(minute.between(0, last_minute)),
        "revision": check("source_revision") > 0,
        "deadline": deadline == until_ms,
        "completion": check("completed_ms").between(earliest, observed_ms)
        & (end_of_day | (instant(day, minute) <= observed_ms)),
        "validity": (observed_ms < until_ms)
        & (until_ms - observed_ms <= fixed.MAX_CHECK_GAP_DAYS * fixed.DAY_MS),
    }
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])


def check_status(observed_ms: Column, next_check_ms: Column, now_ms: Column) -> Column:
    return (
        F.when(observed_ms > now_ms, "future-dated")
        .when(now_ms < next_check_ms, "current")
        .otherwise("overdue")
    )
