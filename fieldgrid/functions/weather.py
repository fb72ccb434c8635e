"""Risk of flying at an hour's weather."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .geo import clamp
from .text import to_fixed


@dataclass(frozen=True)
class Limits:
    wind: float = 8.0
    gust: float = 12.0
    precipitation: float = 40.0
    coldest: float = 5.0
    warmest: float = 35.0


def _share(value: Column, limit: float) -> Column:
    return value / limit if limit > 0 else F.lit(0.0)


def raw_score(wind: Column, gust: Column, precipitation: Column, temperature: Column, limits: Limits = Limits()) -> Column:
    """Weighted shares of the limits, 0 to 1.5."""
    outside = F.when(temperature < limits.coldest, limits.coldest - temperature).when(temperature > limits.warmest, temperature - limits.warmest).otherwise(0.0)
    return clamp(_share(wind, limits.wind) * 0.35 + _share(gust, limits.gust) * 0.35 + _share(precipitation, limits.precipitation) * 0.2 + clamp(outside / 8, 0.0, 1.5) * 0.1, 0.0, 1.5)


def severity(wind: Column, gust: Column, precipitation: Column, temperature: Column, limits: Limits = Limits()) -> Column:
    """2 not to fly, 1 with caution, 0 to fly."""
    score = raw_score(wind, gust, precipitation, temperature, limits)
    never = (wind > limits.wind * 1.1) | (gust > limits.gust * 1.1) | (precipitation > limits.precipitation + 20) | (temperature < limits.coldest - 2) | (temperature > limits.warmest + 2)
    careful = (score >= 0.75) | (wind > limits.wind) | (gust > limits.gust) | (precipitation > limits.precipitation)
    return F.when(never | (score >= 1), 2).when(careful, 1).otherwise(0)


def decision(severity: Column) -> Column:
    return F.when(severity == 2, "NO_GO").when(severity == 1, "CAUTION").otherwise("GO")


def reasons(wind: Column, gust: Column, precipitation: Column, temperature: Column, limits: Limits = Limits()) -> Column:
    """What exceeds or comes near its limit, in a fixed order."""

    def over(value: Column, limit: float, share: float, digits: int, high: str, near: str) -> Column:
        at = to_fixed(value, digits)
        return F.when(value > limit, F.format_string(high, at, F.lit(f"{limit:.{digits}f}"))).when(value > limit * share, F.format_string(near, at))

    cold = F.when(temperature < limits.coldest, F.format_string("Temperature %s°C is below minimum %s°C", to_fixed(temperature, 1), F.lit(f"{limits.coldest:.1f}")))
    warm = F.when(temperature > limits.warmest, F.format_string("Temperature %s°C is above maximum %s°C", to_fixed(temperature, 1), F.lit(f"{limits.warmest:.1f}")))
    listed = F.array(
        over(wind, limits.wind, 0.8, 1, "Wind %s m/s exceeds limit %s m/s", "Wind near limit (%s m/s)"),
        over(gust, limits.gust, 0.8, 1, "Gusts %s m/s exceed limit %s m/s", "Gusts near limit (%s m/s)"),
        over(precipitation, limits.precipitation, 0.75, 0, "Precipitation probability %s%% exceeds limit %s%%", "Elevated precipitation risk (%s%%)"),
        F.coalesce(cold, warm),
    )
    return F.filter(listed, lambda r: r.isNotNull())
