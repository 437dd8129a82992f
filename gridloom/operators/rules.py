"""Rule tables: every rule yields rows, so a report is a union and an empty union means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.codes import FEATURE_KINDS, SPARSE_SAMPLE_CAP

c = F.col


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``violations``, the names of the broken rules; an undecidable rule counts as broken."""
    return df.withColumn("violations", F.array_compact(F.array(
        *[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])))


def floating() -> Column:
    """The lowest point of the rock is above the ground."""
    return c("y") - c("scale_y") > c("ground") + 1e-3


def burial_wrong() -> Column:
    """The rock sits above its nominal seat; deeper is legitimate."""
    return c("y") - (c("ground") + c("scale_y") * (F.lit(1.0) - c("buried") * 2)) > F.greatest(F.lit(0.05), c("scale_y") * 0.5)


def crater_rules() -> list[tuple[str, Column]]:
    return [
        ("diameter", ~(c("diameter") > 0)), ("depth", ~(c("depth") >= 0)), ("rim_height", ~(c("rim_height") >= 0)),
        ("rim_width", ~(c("rim_width") > 0)), ("floor_ratio", ~c("floor_ratio").between(0, 1)),
        ("ellipticity", ~((c("ellipticity") > 0) & (c("ellipticity") <= 1))), ("degradation", ~c("degradation").between(0, 1)),
        ("ejecta", ~((c("ejecta_extent") >= 0) & (c("ejecta_amplitude") >= 0))),
        ("finite", ~(finite(c("cx")) & finite(c("cz")) & finite(c("rotation")))),
    ]


def bad_rotation(tolerance: float = 1e-6) -> Column:
    """The quaternion has not four finite components of norm one."""
    q = c("quaternion")
    norm = F.sqrt(F.aggregate(q, F.lit(0.0), lambda t, v: t + v * v))
    return ~F.coalesce((F.size(q) == 4) & finite(norm) & (F.abs(norm - 1) <= tolerance), F.lit(False))


def rock_rules(quaternion_tolerance: float = 1e-6) -> list[tuple[str, Column]]:
    return [
        ("position", ~(finite(c("x")) & finite(c("y")) & finite(c("z")))),
        ("scale", ~((c("scale_x") > 0) & (c("scale_y") > 0) & (c("scale_z") > 0))),
        ("buried", ~c("buried").between(0, 1)), ("quaternion", bad_rotation(quaternion_tolerance)),
    ]


def balance_rules() -> list[tuple[str, Column]]:
    """Volume identities of a delta or a construction feature."""
    scale = F.greatest("removed", "deposited")
    expected = F.when(scale > 0, F.abs(c("net")) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)
    return [
        ("negative_volume", (c("removed") < 0) | (c("deposited") < 0)), ("net", c("net") != c("deposited") - c("removed")),
        ("relative_error", (c("rel_err") != expected) | (c("rel_err") < 0) | (c("rel_err") > 1)),
    ]


def delta_rules() -> list[tuple[str, Column]]:
    sha = lambda n: ~F.coalesce(c(n).rlike("^[0-9a-f]{64}$"), F.lit(False))
    return [
        ("revision", ~(c("revision") >= 1)), ("sequence", ~(c("seq") >= 0)), ("checksum", sha("previous") | sha("resulting")),
        *balance_rules(), ("counts", ~(c("changed_count") >= 0)),
        ("payload", (c("changed_count") <= SPARSE_SAMPLE_CAP) != c("has_payload")),
        ("rock_digest", (c("rocks_reseated") == 0) != (c("rock_before") == c("rock_after"))),
    ]


def construction_rules(bulk: str = "bulk_density") -> list[tuple[str, Column]]:
    return [("kind", ~c("kind").isin(*FEATURE_KINDS)), *balance_rules(), ("bulk_density", ~(c(bulk) > 0)),
            ("net_mass", c("net_mass") != c("net") * c(bulk))]
