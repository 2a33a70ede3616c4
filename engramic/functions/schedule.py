"""Daily schedules and dates in a zone of a fixed number of hours from UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramic.functions.text import trim

DAY, HOUR = 86_400_000, 3_600_000


def minute_of_day(cron: Column) -> Column:
    """Of ``m h * * *`` and ``@daily``; null for all else."""
    raw = trim(cron)
    part = lambda g: F.regexp_extract(raw, r"^([0-9]{1,2})\s+([0-9]{1,2})\s+\*\s+\*\s+\*$", g).try_cast("int")
    return F.when(raw == "@daily", 0).when((part(1) <= 59) & (part(2) <= 23), part(2) * 60 + part(1))


def wait_ms(cron: Column, now: Column, hours: int) -> Column:
    """Milliseconds to the next run, at least a second; a day without a schedule."""
    left = minute_of_day(cron).cast("long") * 60_000 - F.pmod(now + hours * HOUR, F.lit(DAY))
    return F.when(left.isNull(), F.lit(DAY)).otherwise(F.greatest(F.lit(1000), F.when(left <= 500, left + DAY).otherwise(left))).cast("long")


def date_stamp(at: Column, hours: int) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((at + hours * HOUR) / DAY).cast("int")).cast("string")
