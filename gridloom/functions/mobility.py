"""Static wheel-soil assessment as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: representative soil and vehicle -----------------------------------
SOIL = {"kc": 1400.0, "kphi": 820_000.0, "n": 1.0, "cohesion": 170.0, "friction_deg": 35.0}
VEHICLE = {"mass": 450.0, "wheels": 4.0, "width": 0.2, "radius": 0.25, "gravity": 1.62}
GO_SHARE = 0.2
NO_GO_SINKAGE_SHARE = 0.5
# -------------------------------------------------------------------------------------


def sinkage_modulus(width: Column) -> Column:
    return F.lit(SOIL["kc"]) / width + SOIL["kphi"]


def pressure_sinkage(pressure: Column, width: Column) -> Column:
    return F.when(pressure <= 0, 0.0).otherwise(
        F.pow(pressure / sinkage_modulus(width), F.lit(1 / SOIL["n"])))


def static_sinkage(load: Column, width: Column, radius: Column) -> Column:
    z = F.pow(load / (sinkage_modulus(width) * width * F.sqrt(radius * 2)), F.lit(2 / (2 * SOIL["n"] + 1)))
    return F.when(load <= 0, 0.0).otherwise(z)


def contact_area(sinkage: Column, width: Column, radius: Column) -> Column:
    return width * F.sqrt(radius * 2 * sinkage)


def compaction_resistance(sinkage: Column, width: Column) -> Column:
    n = SOIL["n"]
    return F.when(sinkage <= 0, 0.0).otherwise(
        width * sinkage_modulus(width) * F.pow(sinkage, F.lit(n + 1)) / (n + 1))


def drawbar(slope_deg: Column, v: dict[str, Column]) -> dict[str, Column]:
    """Sinkage, thrust, resistances and net pull of a vehicle on a slope."""
    weight = v["mass"] * v["gravity"]
    load = weight / v["wheels"] * F.cos(F.radians(slope_deg))
    z = static_sinkage(load, v["width"], v["radius"])
    grip = contact_area(z, v["width"], v["radius"]) * SOIL["cohesion"]
    thrust = v["wheels"] * (grip + load * math.tan(math.radians(SOIL["friction_deg"])))
    compaction = v["wheels"] * compaction_resistance(z, v["width"])
    gradient = weight * F.sin(F.radians(slope_deg))
    return {"sinkage": z, "thrust": thrust, "compaction": compaction, "gradient": gradient,
            "pull": thrust - compaction - gradient}


def mobility_class(pull: Column, thrust: Column, sinkage: Column, radius: Column) -> Column:
    return (F.when((pull <= 0) | (sinkage > radius * NO_GO_SINKAGE_SHARE), "no-go")
            .when(pull > thrust * GO_SHARE, "go").otherwise("marginal"))


def slope_margin(v: dict[str, Column], steps: int = 60) -> Column:
    """Slope of zero net pull, by bisection over a bounded bracket."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(90.0).alias("hi"))

    def halve(acc: Column, _i: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = drawbar(mid, v)["pull"] > 0
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    margin = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.when(drawbar(F.lit(0.0), v)["pull"] <= 0, 0.0).otherwise(margin)


def heuristic_score(slope_deg: Column, roughness: Column, res: Column) -> Column:
    slope_part = F.greatest(F.lit(0.0), F.lit(1.0) - slope_deg / 25.0)
    rough_part = F.greatest(F.lit(0.0), F.lit(1.0) - roughness / (res * 2))
    return slope_part * 0.65 + rough_part * 0.35


def heuristic_class(slope_deg: Column, score: Column) -> Column:
    return (F.when(slope_deg > 25, "unsafe_slope").when(score < 0.4, "difficult")
            .when(score < 0.7, "moderate").otherwise("traversable"))
