"""Instants are UTC. A column without zone is read as UTC; one with zone is converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_ZONE = "America/Sao_Paulo"  # fixed value: calendar used for campaign windows
MICROS_PER_DAY = 86_400_000_000


def as_utc(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as zone-less UTC timestamps, whatever the session zone is."""
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.TimestampType):
            local = F.col(c).cast("timestamp_ntz")
            df = df.withColumn(
                c, F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
            )
        elif not isinstance(kind, T.TimestampNTZType):
            raise ValueError(f"{c} must be a timestamp, is {kind.simpleString()}")
    return df


def local_day(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    """EXP-19. Calendar day of a UTC instant in the local zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))


def day_start_utc(day: str, zone: str = LOCAL_ZONE) -> Column:
    """Midnight of a local day as a UTC instant."""
    midnight = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight)


def days_between(later: Column, earlier: Column) -> Column:
    """EXP-20. Fractional days, with microsecond resolution."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(float(MICROS_PER_DAY))
