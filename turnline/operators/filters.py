"""The one filter set that narrows flights and links alike."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.schema import MONTH_COLUMNS


def _as_date(value: str | dt.date | None) -> dt.date | None:
    return dt.date.fromisoformat(value) if isinstance(value, str) and value else (value or None)


@dataclass(frozen=True)
class FlightFilter:
    """Date range, airline, origin airport and route (``"ATL-JFK"``); unset parts do not narrow.

    Links are filtered by their current leg, after linking: filtering flights
    first would change which leg comes before which.
    """

    start_date: str | dt.date | None = None
    end_date: str | dt.date | None = None
    airline: str | None = None
    airport: str | None = None
    route: str | None = None

    @classmethod
    def of(cls, values: "FlightFilter | Mapping | None") -> "FlightFilter":
        if isinstance(values, cls):
            return values
        known = {field.name for field in fields(cls)}
        return cls(**{name: value for name, value in (values or {}).items() if name in known})

    def _parts(self, columns: list[str]) -> list[Column]:
        start, end = _as_date(self.start_date), _as_date(self.end_date)
        by_month = all(name in columns for name in MONTH_COLUMNS)
        month = F.col(MONTH_COLUMNS[0]) * 100 + F.col(MONTH_COLUMNS[1]) if by_month else None
        parts = []
        if start:
            parts.append(F.col("flight_date") >= F.lit(start))
            if by_month:  # prunes the month folders of a stored table
                parts.append(month >= start.year * 100 + start.month)
        if end:
            parts.append(F.col("flight_date") <= F.lit(end))
            if by_month:
                parts.append(month <= end.year * 100 + end.month)
        if self.airline:
            parts.append(F.col("reporting_airline") == F.lit(self.airline))
        if self.airport:
            parts.append(F.col("origin") == F.lit(self.airport))
        if self.route:
            origin, dest = self.route.split("-")
            parts += [F.col("origin") == F.lit(origin), F.col("dest") == F.lit(dest)]
        return parts

    def predicate(self, columns: list[str] | None = None) -> Column:
        """All set parts together; true when nothing is set."""
        condition = F.lit(True)
        for part in self._parts(columns or []):
            condition = condition & part
        return condition

    def apply(self, table: DataFrame) -> DataFrame:
        return table.where(self.predicate(table.columns))

    def is_default(self, min_date: str | dt.date, max_date: str | dt.date) -> bool:
        """True when the filter leaves the whole table in."""
        return (
            (_as_date(self.start_date) or _as_date(min_date)) == _as_date(min_date)
            and (_as_date(self.end_date) or _as_date(max_date)) == _as_date(max_date)
            and not (self.airline or self.airport or self.route)
        )


def is_default(values: FlightFilter | Mapping, min_date: str | dt.date, max_date: str | dt.date) -> bool:
    return FlightFilter.of(values).is_default(min_date, max_date)


def narrowed(table: DataFrame, flt: FlightFilter | Mapping | None) -> DataFrame:
    return table if flt is None else FlightFilter.of(flt).apply(table)
