"""Durations for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000
# Fixed value: a duration above this many milliseconds is told in years.
YEARS_ABOVE = 31_104_000_000


def format_duration(col: Column | str) -> Column:
    """Milliseconds as the two or three largest units: `1y 2d 3h`, `2d 3h`, `3h 4m`, `4m 5s`, `5s 6ms`.

    A zero in a smaller unit is left out; the blank after the unit before it stays.
    """
    ms = (F.col(col) if isinstance(col, str) else col).cast("long")

    def whole(unit: int, modulo: int | None = None) -> Column:
        amount = F.floor(ms / unit)
        return amount if modulo is None else amount % modulo

    def lead(amount: Column, unit: str) -> Column:
        return F.concat(amount.cast("string"), F.lit(unit + " "))

    def rest(amount: Column, unit: str, blank: str = "") -> Column:
        return F.when(amount > 0, F.concat(amount.cast("string"), F.lit(unit + blank))).otherwise("")

    days = whole(DAY)
    years = F.floor(days / 365)
    return (
        F.when(ms > YEARS_ABOVE,
               F.concat(lead(years, "y"), rest(days % 365, "d", " "), rest(whole(HOUR, 24), "h")))
        .when(ms > DAY, F.concat(lead(days, "d"), rest(whole(HOUR, 24), "h")))
        .when(ms > HOUR, F.concat(lead(whole(HOUR), "h"), rest(whole(MINUTE, 60), "m")))
        .when(ms > MINUTE, F.concat(lead(whole(MINUTE), "m"), rest(whole(SECOND, 60), "s")))
        .otherwise(F.concat(lead(whole(SECOND), "s"), rest(ms % 1000, "ms")))
    )
