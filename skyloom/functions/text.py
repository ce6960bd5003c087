"""Names, identifiers and formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules for survey names, first match wins (kind, text, survey).
SURVEY_RULES = (
    ("prefix", "D33", "GAIA"), ("prefix", "D125", "GAIA"), ("contains", "GAIA", "GAIA"), ("contains", "APOGEE", "APOGEE"), ("contains", "GALAH", "GALAH"),
    ("contains", "LAMOST", "LAMOST"), ("contains", "RAVEL", "OTHER"), ("contains", "RAVE", "RAVE"), ("contains", "GES", "GES"), ("contains", "DESI", "DESI"), ("contains", "SDSS", "SDSS"),
)


def resolve(x: Column, rules=SURVEY_RULES, default: str = "OTHER") -> Column:
    up, out = F.upper(F.trim(x)), F.lit(default)
    for kind, text, name in reversed(rules):
        hit = up.startswith(text) if kind == "prefix" else up.contains(text)
        out = F.when(hit, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def resolve_regex(x: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(x.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def plain_name(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]", "")


def name_variants(x: Column) -> Column:
    """Array of struct(priority, name): normalised, as given, lower, upper, without blanks, without underscores."""
    forms = [plain_name(x), x, F.lower(x), F.upper(x), F.replace(x, F.lit(" "), F.lit("")), F.replace(x, F.lit("_"), F.lit(""))]
    return F.array(*(F.struct(F.lit(i).alias("priority"), f.alias("name")) for i, f in enumerate(forms)))


def extract_id(x: Column, label: str) -> Column:
    found = F.regexp_extract(x, label + r":(\d+)", 1)
    return F.when(found != "", found.try_cast("long"))


def sexagesimal(x: Column, hours: bool = False) -> Column:
    """Degrees from 'a b c' or 'a:b:c'; a leading minus holds for all parts."""
    part = F.split(F.trim(F.regexp_replace(x, "^\\s*[+-]", "")), r"[:\s]+")
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)).try_cast("double"), F.lit(0.0))
    value = at(1) + at(2) / 60 + at(3) / 3600
    value = F.when(F.trim(x).startswith("-"), -value).otherwise(value)
    return F.when(F.trim(x) != "", value * (15 if hours else 1))


def whole_number_text(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("double").cast("long").cast("string")


def short_float_text(x: Column) -> Column:
    """Six significant digits without trailing zeros."""
    text = F.format_string("%.6g", x)
    return F.when(text.contains("e"), text).when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def given_text(x: Column) -> Column:
    """Trimmed text, null for blanks and for nan."""
    t = F.trim(x)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"[^A-Za-z0-9._-]+", "_")
