"""Activity units and derived figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to nanomolar by lower-case unit name.
TO_NM = {
    "nm": 1.0, "nanomolar": 1.0,
    "um": 1e3, "μm": 1e3, "micromolar": 1e3,
    "mm": 1e6, "millimolar": 1e6,
    "m": 1e9, "molar": 1e9,
}


def to_nm(value: Column, unit: Column) -> Column:
    """A value in nanomolar; picomolar is divided, unknown units are taken as nanomolar."""
    low, out = F.lower(unit), F.when(F.lower(unit).isin("pm", "picomolar"), value / 1000.0)
    for name, factor in TO_NM.items():
        out = out.when(low == name, value * factor)
    return out.otherwise(value)


def client_nm(value: Column, unit: Column) -> Column:
    """The client's conversion, which minds case and knows fewer units."""
    return F.when(unit.isin("uM", "μM"), value * 1000.0).when(unit == "mM", value * 1e6).otherwise(value)


def p_activity(nm: Column) -> Column:
    """9 - log10 of a positive nanomolar value, else null."""
    return F.when(nm > 0, 9 - F.log10(nm))


def colour(p: Column) -> Column:
    """Red, green and blue of an activity between 0 and 12; null is transparent."""
    t = F.least(F.greatest(p, F.lit(0.0)), F.lit(12.0)) / 12
    part = lambda a, b, bend: F.floor(a + t * (b - a) * F.least(F.lit(1.0), bend) + 0.5).cast("int").cast("string")
    rgb = F.concat(F.lit("rgb("), F.concat_ws(", ", part(220, 34, t * 2), part(38, 197, F.lit(1.0)), part(38, 94, (1 - t) * 2)), F.lit(")"))
    return F.when(p.isNull(), F.lit("transparent")).otherwise(rgb)
