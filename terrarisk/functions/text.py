"""Lenient parsing and normalisation of text fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes, ordered status patterns, name patterns and street suffixes.
HAZARD_CLASSES = {"moderate": "Moderate", "mod": "Moderate", "medium": "Moderate", "high": "High", "very high": "Very High", "very_high": "Very High", "veryhigh": "Very High", "vhigh": "Very High", "1": "Moderate", "2": "High", "3": "Very High"}
FAULT_TYPES = {"strike-slip": "strike-slip", "strike slip": "strike-slip", "ss": "strike-slip", "right lateral": "strike-slip", "left lateral": "strike-slip", "right-lateral": "strike-slip", "left-lateral": "strike-slip", "thrust": "thrust", "reverse": "thrust", "normal": "normal", "detachment": "normal", "oblique": "oblique"}
SITE_TYPES = {"Federal Superfund": "superfund", "State Response": "state_response", "Voluntary Cleanup": "voluntary", "School Investigation": "school", "Corrective Action": "corrective_action", "Tiered Permit": "tiered_permit", "Military": "military", "Evaluation": "evaluation", "LUST Cleanup Site": "lust", "Cleanup Program Site": "cleanup", "Military UST": "military_ust", "Military Cleanup Site": "military", "Land Disposal Site": "land_disposal", "WDR Site": "wdr"}
STATUS_PATTERNS = [
    ("land use restrict", "closed_restricted"), ("deed restrict", "closed_restricted"), ("use restriction", "closed_restricted"),
    ("open", "active"), ("active", "active"), ("action required", "active"), ("remediat", "active"), ("assessment", "active"), ("site assess", "active"), ("interim", "active"), ("eligible for closure", "active"),
    ("inactive", "monitoring"), ("needs evaluation", "monitoring"), ("certified", "monitoring"), ("o&m", "monitoring"), ("verification monitoring", "monitoring"), ("refer", "monitoring"),
    ("completed", "closed_restricted"), ("closed", "closed_restricted"),
]
FAULT_PROBABILITIES = [
    (r"Hayward\b", 33), (r"Calaveras\b", 18), (r"San Gregorio\b", 10), (r"Concord\b", 6), (r"Green Valley\b", 6), (r"Greenville\b", 6),
    (r"San Andreas\b", 22), (r"San Jacinto\b", 19), (r"Elsinore\b", 5), (r"Newport.Inglewood\b", 10), (r"Puente Hills\b", 3), (r"^Hollywood fault\b", 5),
]
SUFFIXES = [("St", "Street"), ("Ave", "Avenue"), ("Blvd", "Boulevard"), ("Dr", "Drive"), ("Ln", "Lane"), ("Rd", "Road"), ("Ct", "Court"), ("Pl", "Place"), ("Cir", "Circle"), ("Ter", "Terrace"), ("Trl", "Trail"), ("Pkwy", "Parkway"), ("Hwy", "Highway")]


def number(c: Column) -> Column:
    """NULL for blanks, what isn't a number, and NaN."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def first_number(*columns: Column) -> Column:
    return F.coalesce(*[number(c) for c in columns])


def first_text(*columns: Column, default: str) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(default))


def classify_status(c: Column, strict: bool = False) -> Column:
    """The first pattern that the text holds; strict: as whole words, so that inactive isn't active."""
    text, out = F.lower(F.trim(c)), None
    for pattern, category in STATUS_PATTERNS:
        hit = F.regexp_like(text, F.lit(rf"\b{pattern}")) if strict else text.contains(pattern)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.when(c.isNull(), "unknown").otherwise(out.otherwise("unknown"))


def parse_slip_rate(c: Column) -> Column:
    text = F.lower(F.trim(c))
    num = lambda pattern, group: F.regexp_extract(text, pattern, group).try_cast("double")
    n = r"([\d.]+)"
    between = rf"between\s+{n}\s+and\s+{n}"
    return F.coalesce(num(rf"less\s+than\s+{n}", 1) / 2, num(rf"greater\s+than\s+{n}", 1) * 1.5, (num(between, 1) + num(between, 2)) / 2, num(n, 1))


def assign_by_pattern(c: Column, rules: list[tuple[str, float]] = FAULT_PROBABILITIES) -> Column:
    """The value of the last rule that matches."""
    out = F.lit(None).cast("double")
    for pattern, value in rules:
        out = F.when(F.regexp_like(c, F.lit(f"(?i){pattern}")), float(value)).otherwise(out)
    return out


def shrink_swell(lep: Column) -> Column:
    return F.when((lep >= 0) & (lep < 3), "Low").when((lep >= 3) & (lep < 6), "Moderate").when((lep >= 6) & (lep < 9), "High").when(lep >= 9, "Very High").otherwise("Unknown")


def title_case(c: Column) -> Column:
    """A capital after everything that isn't a letter."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def normalize_street(c: Column) -> Column:
    s = title_case(F.trim(c))
    out = None
    for short, full in SUFFIXES:
        hit, value = s.endswith(f" {short}"), F.concat(F.substring(s, F.lit(1), F.length(s) - len(short)), F.lit(full))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.when(c.isNull(), "").otherwise(out.otherwise(s))


def normalize_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def extract_zip(c: Column, first: bool = False) -> Column:
    """The last word of five digits, or the first."""
    found = F.regexp_extract_all(c, F.lit(r"\b(\d{5})\b"), 1)
    return F.try_element_at(found, F.lit(1 if first else -1))


def parse_increment(name: Column) -> Column:
    """Feet in a layer name such as slr_1_0ft or slr_3ft, among the known steps."""
    whole, part = F.regexp_extract(name, r"slr_(\d+)_?(\d*)ft", 1), F.regexp_extract(name, r"slr_(\d+)_?(\d*)ft", 2)
    v = F.concat_ws(".", whole, F.when(part == "", "0").otherwise(part)).try_cast("double")
    return F.when(v.isin(1.0, 2.0, 3.0, 4.0, 6.0, 10.0) & ~F.lower(name).contains("low"), v)
