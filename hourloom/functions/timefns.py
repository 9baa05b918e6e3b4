"""Time expressions. All inputs are TIMESTAMP_NTZ columns holding UTC wall time unless said otherwise.

Nothing here depends on the session time zone: unix_timestamp, hour, minute and casts to DATE read an NTZ value as it
stands, while date_trunc would first turn it into an instant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Berlin"
HOUR = 3600


def hours(n: Column | int) -> Column:
    """Interval of n hours (elapsed time)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def days(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def ntz(text: str) -> Column:
    """Wall-time literal."""
    return F.lit(text).cast("timestamp_ntz")


def to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def to_utc(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local wall time to UTC wall time."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def unix_seconds(ts: Column, zone: str = "UTC") -> Column:
    """Seconds since the epoch of a wall time in the given zone."""
    return F.unix_timestamp(ts if zone == "UTC" else to_utc(ts, zone))


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch, as BIGINT."""
    return F.floor(F.unix_timestamp(ts) / F.lit(HOUR))


def from_hour_number(n: Column) -> Column:
    return ntz("1970-01-01 00:00:00") + hours(n)


def floor_hour(ts: Column) -> Column:
    return from_hour_number(hour_number(ts))


def midnight(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(ts) + F.lit(1)


def traffic_hour(ts: Column, first: int = 5, last: int = 21, zone: str = LOCAL_ZONE) -> Column:
    """True where the local hour lies in first..last: the hours whose traffic a scenario may change."""
    return F.hour(to_local(ts, zone)).between(first, last)


def closed_right_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local day of the bin (00:00, 24:00]: midnight counts to the day that ends with it."""
    return F.to_date(to_local(ts, zone) - F.expr("INTERVAL '0.000001' SECOND"))


def model_start(now: Column, twice_daily: bool = True, zone: str = LOCAL_ZONE) -> Column:
    """Local start time of the run `now` belongs to: 05:00 or 15:00, or the full hour for hourly models."""
    local = to_local(now, zone)
    if not twice_daily:
        return floor_hour(local)
    day = midnight(local)
    return (
        F.when(F.hour(local) >= 15, day + hours(15))
        .when(F.hour(local) < 5, day - hours(9))
        .otherwise(day + hours(5))
    )


def horizon_end(now: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local midnight ending the forecast: 5 elapsed days ahead from noon on, else 4."""
    ahead = F.when(F.hour(to_local(now, zone)) >= 12, 5).otherwise(4)
    return midnight(to_local(now + days(ahead), zone))


def align_prediction_hour(last: Column, window_hours: int, local_hour: int, zone: str = LOCAL_ZONE) -> Column:
    """Move `last` back by less than a day so that a window ending there starts at the given local hour."""
    first_hour = F.hour(to_local(last - hours(window_hours), zone))
    return last - hours(F.pmod(first_hour - F.lit(local_hour), F.lit(24)))


def clamp_start(start: Column, latest: Column) -> Column:
    """A forecast cannot start later than one hour after the latest observation."""
    return F.when(start - hours(1) > latest, latest + hours(1)).otherwise(start)


def bounds(lo: Column | None, hi: Column | None, now: Column, include_future: bool = True) -> tuple[Column, Column]:
    """Fill missing range bounds: 2015-01-01 and five days after `now` (or `now` itself)."""
    default_lo = ntz("2015-01-01 00:00:00")
    default_hi = now + days(5) if include_future else now
    return (
        default_lo if lo is None else F.coalesce(lo, default_lo),
        default_hi if hi is None else F.coalesce(hi, default_hi),
    )
