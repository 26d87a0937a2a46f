"""Text rules of names, metrics, goals and notes, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d*\.?\d+"


def normal_name(name: Column) -> Column:
    """Trimmed, inner white space as one space, upper case."""
    return F.upper(F.trim(F.regexp_replace(name, r"\s+", " ")))


def metric_key(metric: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(metric), " ", ""))


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


GOAL = rf"^\s*([<>]=?|=)?\s*({NUMBER})\s*([A-Za-z%]+)?\s*$"
RANGE = rf"^\s*({NUMBER})\s*-\s*({NUMBER})\s*([A-Za-z%]+)?\s*$"


def goal_value(text: Column) -> Column:
    """struct(value, unit): an optional comparator, a number, an optional unit of letters or %. Else a null value and the text.
    A unit with a digit in it (cm3) does not parse."""
    t = F.trim(text)
    ok = F.regexp_like(t, F.lit(GOAL))
    return F.struct(F.when(ok, _number(t, GOAL, 2)).alias("value"), F.when(ok, F.upper(F.regexp_extract(t, GOAL, 3))).otherwise(t).alias("unit"))


def goal_range(text: Column) -> Column:
    """struct(first, second, unit) of `a - b unit`; nulls and an empty unit otherwise."""
    t = F.trim(text)
    ok = F.regexp_like(t, F.lit(RANGE))
    return F.struct(F.when(ok, _number(t, RANGE, 1)).alias("first"), F.when(ok, _number(t, RANGE, 2)).alias("second"), F.when(ok, F.upper(F.regexp_extract(t, RANGE, 3))).otherwise("").alias("unit"))


def v_threshold(key: Column) -> Column:
    """The dose in V20 or V20GY, else null."""
    return F.when(F.regexp_like(key, F.lit(rf"^V({NUMBER})(GY)?$")), _number(key, rf"^V({NUMBER})(GY)?$", 1))


def d_volume(key: Column) -> Column:
    """struct(value, unit) of D95% or D2CC, else nulls."""
    pattern = rf"^D({NUMBER})(CC|%)$"
    ok = F.regexp_like(key, F.lit(pattern))
    return F.struct(F.when(ok, _number(key, pattern, 1)).alias("value"), F.when(ok, F.regexp_extract(key, pattern, 2)).alias("unit"))


def goal_input(text: Column) -> Column:
    """struct(comparator, value) of what a reviewer types, the longest comparator first; nulls where there is none."""
    pattern = r"^\s*(<=|>=|<|>|==|=)\s*(.+?)\s*$"
    ok = F.regexp_like(text, F.lit(pattern))
    return F.struct(F.when(ok, F.regexp_extract(text, pattern, 1)).alias("comparator"), F.when(ok, F.regexp_extract(text, pattern, 2)).alias("value"))


def metric_text(value: Column, unit: Column) -> Column:
    """% with one decimal, cc and Gy with two; n/a for null or not finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    u = F.upper(unit)
    return (
        F.when(~finite, "n/a")
        .when(u == "%", F.format_string("%.1f%%", value))
        .when(u == "CC", F.format_string("%.2f cc", value))
        .when(u == "GY", F.format_string("%.2f Gy", value))
        .otherwise(F.trim(F.concat(F.format_string("%.2f ", value), unit)))
    )


def relative_dose_text(dose: Column, rx: Column) -> Column:
    """Dose in % of the prescription with one decimal; blank without one."""
    return F.when(dose.isNull() | rx.isNull() | (rx <= 0), "").otherwise(F.format_string("%.1f%%", dose / rx * 100))


def number_text(value: Column, tolerance: float = 1e-8) -> Column:
    """Whole numbers without decimals, others with six significant digits and no trailing zeros."""
    near = F.rint(value)
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(value))).cast("int"))
    fixed = F.round(value * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits)
    return F.when(F.abs(value - near) <= tolerance + 1e-5 * F.abs(near), near.cast("bigint").cast("string")).otherwise(fixed.cast("string"))


def script_goal(text: Column) -> Column:
    """The first number with its unit, written `12%`, `3 cc`, `20 Gy`; cm3 is cc; without a unit the first number; else the text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    pattern = rf"(?i)({NUMBER})\s*(%|CC|CM3|GY)"
    n, unit = number_text(_number(t, pattern, 1), 1e-9), F.upper(F.regexp_extract(t, pattern, 2))
    bare = _number(t, f"({NUMBER})", 1)
    return F.when(unit == "%", F.concat(n, F.lit("%"))).when(unit.isin("CC", "CM3"), F.concat(n, F.lit(" cc"))).when(unit == "GY", F.concat(n, F.lit(" Gy"))).when(bare.isNotNull(), number_text(bare, 1e-9)).otherwise(t)


def script_clause(text: Column) -> Column:
    """struct(metric, comparator) of a clause that ends in a comparator; nulls otherwise."""
    t = F.trim(F.regexp_replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">=")), r"\s+", " "))
    pattern = r"^(.*?)(<=|>=|==|=|<|>)\s*$"
    metric = F.replace(F.regexp_extract(t, pattern, 1), F.lit(" "), F.lit(""))
    ok = F.regexp_like(t, F.lit(pattern)) & (metric != "")
    return F.struct(F.when(ok, metric).alias("metric"), F.when(ok, F.regexp_extract(t, pattern, 2)).alias("comparator"))


def block_label(text: Column) -> Column:
    """X11: struct(kind, value) of a constraint block's label: na, dose_per_fraction x (D/F x), fraction_count n (F n)."""
    per, count = r"(?i)\bD\s*/\s*F\b\s*([0-9]+(?:\.[0-9]+)?)", r"(?i)\bF\b\s*([0-9]+(?:\.[0-9]+)?)"
    t = F.trim(text)
    na = normal_name(t).isin("NA", "N/A")
    a, b = _number(t, per, 1), _number(t, count, 1)
    return F.struct(F.when(na, "na").when(a.isNotNull(), "dose_per_fraction").when(b.isNotNull(), "fraction_count").otherwise("").alias("kind"), F.when(~na, F.coalesce(a, b)).alias("value"))


def note_key(structure: Column, metric: Column, comparator: Column, value_text: Column) -> Column:
    """X12."""
    return F.concat_ws("||", structure, F.trim(metric), F.trim(comparator), F.trim(value_text))


def target_note_key(name: Column, parent: Column) -> Column:
    """X12, for targets: the parent stands in between where there is one."""
    return F.concat_ws("||", F.lit("TARGET"), F.when(F.coalesce(parent, F.lit("")) != "", parent), name)


def compose_notes(computed: Column, stored: Column, separator: str = "    ") -> Column:
    """Computed and stored note; a stored note that is, or begins with, the computed one stands alone."""
    c, s = F.trim(F.coalesce(computed, F.lit(""))), F.trim(F.coalesce(stored, F.lit("")))
    return F.when(c == "", s).when(s == "", c).when((s == c) | F.startswith(s, F.concat(c, F.lit(separator))), s).otherwise(F.concat(c, F.lit(separator), s))


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership that rises from a to b, is 1 to c, and falls to d; equal ends are shoulders."""
    rise = F.lit(1.0) if a == b else (x - a) / (b - a)
    fall = F.lit(1.0) if c == d else (d - x) / (d - c)
    inside = F.when((x >= b) & (x <= c), F.lit(1.0)).when(x < b, rise if a != b else F.lit(1.0)).otherwise(fall if c != d else F.lit(1.0))
    low = (x < a) if a != b else F.lit(False)
    high = (x > d) if c != d else F.lit(False)
    return F.when(low | high, F.lit(0.0)).otherwise(inside)


def ptv_rx(name: Column) -> Column:
    """P5: all digits of a PTV name, in hundredths of Gy; else null."""
    n = normal_name(name)
    return F.when(n.startswith("PTV"), F.regexp_replace(n, "[^0-9]", "").try_cast("double") / 100)
