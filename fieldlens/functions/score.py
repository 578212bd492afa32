"""Small scored judgements: thermals, advice, weather words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.constants import SIT_ADVICE, THERMAL_BANDS
from fieldlens.functions.num import wrap360


def thermal_strength(slope: Column) -> Column:
    out = F.lit("none")
    for low, name, _ in reversed(THERMAL_BANDS):
        out = F.when(slope >= low, name).otherwise(out)
    return out


def thermal(slope: Column, aspect: Column, window: Column) -> Column:
    """{strength, weight, from_deg}: air sinks downhill in the morning and rises in the evening."""
    weight = F.lit(0.0)
    for low, _, w in reversed(THERMAL_BANDS):
        weight = F.when(slope >= low, w).otherwise(weight)
    known = slope.isNotNull() & aspect.isNotNull()
    weight = F.when(known, weight).otherwise(0.0)
    came = F.when(weight > 0, F.when(window == "AM", wrap360(aspect + 180.0)).otherwise(aspect))
    return F.struct(F.when(known, thermal_strength(slope)).otherwise("none").alias("strength"),
                    weight.alias("weight"), came.alias("from_deg"))


def sit_advice(phase: Column) -> Column:
    """Advice for a season phase: that of the first known word in it."""
    known = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(advice).alias("advice")) for word, advice in SIT_ADVICE])
    return F.get(F.filter(known, lambda k: F.contains(phase, k["word"])), F.lit(0))["advice"]


# fixed values: weather codes to words
WEATHER_WORDS = [((0, 0), "clear"), ((1, 1), "mostly clear"), ((2, 2), "partly cloudy"), ((3, 3), "overcast"),
                 ((45, 45), "fog"), ((48, 48), "fog"), ((51, 57), "drizzle"), ((61, 61), "light rain"),
                 ((63, 63), "rain"), ((65, 65), "heavy rain"), ((66, 67), "freezing rain"), ((71, 71), "light snow"),
                 ((73, 73), "snow"), ((75, 75), "heavy snow"), ((77, 77), "heavy snow"), ((80, 80), "light rain"),
                 ((81, 81), "rain"), ((82, 82), "heavy rain"), ((85, 85), "light snow"), ((86, 86), "heavy snow")]


def weather_word(code: Column) -> Column:
    out = F.when(code >= 95, "thunderstorm")
    for (low, high), name in WEATHER_WORDS:
        out = out.when(code.between(low, high), name)
    return out
