"""Hazard scores as Column expressions: annual probabilities of major damage and what they are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEARS = 30
# Ground-motion, intensity and fragility coefficients, zone rates and the rates by susceptibility class.
GROUND = {"e0": 0.4473, "e1": 0.4856, "e5": -0.1091, "mh": 5.5, "c1": -1.243, "c2": 0.1489, "c3": -0.00344, "h": 5.3, "mref": 4.5, "rref": 1.0, "clin": -0.6, "vref": 760.0, "vc": 1500.0}
FRAGILITY = [(5, 0.01), (6, 0.05), (7, 0.15), (8, 0.35), (9, 0.60), (10, 0.80)]
VS30_VALUES = [180, 259, 360, 537, 760, 1150, 2000]
FLOOD_GROUPS = {"V": "V/VE", "VE": "V/VE", "AE": "AE", "A": "A", "AH": "A", "AO": "A", "A99": "A", "AR": "A", "D": "D", "X": "X"}
FLOOD_RATES = {"V/VE": 0.01 * 0.60, "AE": 0.01 * 0.40, "A": 0.01 * 0.40, "D": 0.005 * 0.30, "X": 0.0002 * 0.10}
FLOOD_UNMAPPED = 0.0001 * 0.05
ACTIVE_DEPOSIT, DORMANT_DEPOSIT, DAM_RATE = 0.0230, 0.00277, 0.0001 * 0.90
VELOCITY_LIMIT = 3.5
RATE_BY_N10 = [
    0.00000049, 0.00000100, 0.00000150, 0.00000200, 0.00000300, 0.00000450, 0.00000600, 0.00000770, 0.00000770, 0.00000770,
    0.00000770, 0.00000900, 0.00001050, 0.00001260, 0.00001260, 0.00001260, 0.00001400, 0.00001576, 0.00001576, 0.00001576,
    0.00001260, 0.00001400, 0.00001576, 0.00001576, 0.00001750, 0.00001950, 0.00002100, 0.00002300, 0.00002450, 0.00002588,
    0.00001576, 0.00001750, 0.00001950, 0.00002100, 0.00002300, 0.00002450, 0.00002588, 0.00002800, 0.00003100, 0.00003500,
    0.00002588, 0.00002800, 0.00003100, 0.00003500, 0.00003800, 0.00003959, 0.00004200, 0.00004700, 0.00005200, 0.00005800,
    0.00003959, 0.00004500, 0.00005200, 0.00006000, 0.00006500, 0.00007448, 0.00007448, 0.00008000, 0.00009000, 0.00010000,
    0.00007448, 0.00008500, 0.00010000, 0.00011500, 0.00013000, 0.00016499, 0.00016499, 0.00018000, 0.00020000, 0.00023000,
    0.00016499, 0.00020000, 0.00024000, 0.00028000, 0.00030705, 0.00030705, 0.00040000, 0.00050000, 0.00060000, 0.00072447,
    0.00072447, 0.00276627,
]


def lookup(col: Column, values: dict) -> Column:
    """A literal map; NULL for what it doesn't have."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col)


def half_up(v: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(v * 10**digits + 0.5) / 10**digits


def p_horizon(annual: Column, years: float = YEARS) -> Column:
    return 1 - F.pow(1 - annual, F.lit(float(years)))


def annual_from(p: Column, years: float = YEARS) -> Column:
    return 1 - F.pow(1 - p, F.lit(1.0 / years))


def ground_motion(magnitude: Column, distance_km: Column, vs30: Column) -> Column:
    """Median peak acceleration in g."""
    k = GROUND
    source = F.when(magnitude <= k["mh"], k["e0"] + k["e1"] * (magnitude - k["mh"])).otherwise(k["e0"] + k["e5"] * (magnitude - k["mh"]))
    r = F.sqrt(distance_km * distance_km + k["h"] ** 2)
    path = (k["c1"] + k["c2"] * (magnitude - k["mref"])) * F.ln(r / k["rref"]) + k["c3"] * (r - k["rref"])
    return F.exp(source + path + k["clin"] * F.ln(F.least(vs30, F.lit(k["vc"])) / k["vref"]))


def pga_to_mmi(pga: Column) -> Column:
    cms = pga * 980.665
    log = F.log10(cms)
    return F.when(cms <= 0, 1.0).when(log < 1.57, 1.78 + 1.55 * log).otherwise(-1.60 + 3.70 * log)


def interpolate(x: Column, points: list[tuple[float, float]], below: float) -> Column:
    """Piecewise linear through points; `below` under the first, the last value above."""
    out = F.when(x < points[0][0], F.lit(float(below)))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(F.lit(float(points[-1][1])))


def fragility(mmi: Column) -> Column:
    """Probability of extensive damage to a wood frame."""
    return interpolate(mmi, FRAGILITY, 0.0)


def magnitude(ucerf_pct: Column, length_km: Column) -> Column:
    estimate = F.least(F.greatest(5.16 + 1.12 * F.log10(length_km), F.lit(5.0)), F.lit(8.5))
    return F.when(ucerf_pct.isNotNull(), 6.7).when(length_km > 0, estimate).otherwise(6.0)


def fault_rate(ucerf_pct: Column, slip_mm: Column) -> Column:
    return F.when(ucerf_pct > 0, annual_from(ucerf_pct / 100)).when(slip_mm > 0, slip_mm * 0.0001).otherwise(0.0001)


def flood_annual(zone: Column) -> Column:
    return F.coalesce(lookup(lookup(zone, FLOOD_GROUPS), FLOOD_RATES), F.lit(FLOOD_UNMAPPED))


def tsunami_annual(in_zone: Column, elevation_m: Column, coast_km: Column) -> Column:
    by_distance = F.when(coast_km < 0.2, 0.5).when(coast_km < 1.0, 0.5 * (1 - (coast_km - 0.2) / 0.8)).otherwise(0.01)
    by_elevation = F.when(elevation_m < 5, 0.5).when(elevation_m < 15, 0.5 * (1 - (elevation_m - 5) / 10)).otherwise(0.01)
    return F.when(F.coalesce(in_zone, F.lit(False)), 0.001 * F.when(elevation_m.isNull() | (elevation_m <= 0), by_distance).otherwise(by_elevation)).otherwise(0.0)


def landslide_tier(on_deposit: Column, confidence: Column, velocity: Column, in_zone: Column, n10: Column) -> Column:
    return F.when(velocity > VELOCITY_LIMIT, 1).when(on_deposit & (F.coalesce(confidence, F.lit(0)) >= 3), 2).when(in_zone & (n10 > 0), 3).otherwise(4)


def landslide_annual(tier: Column, n10: Column, tract_rate: Column) -> Column:
    by_class = F.get(F.array(*[F.lit(x) for x in RATE_BY_N10]), F.least(n10, F.lit(81)).cast("int"))
    return F.when(tier == 1, ACTIVE_DEPOSIT).when(tier == 2, DORMANT_DEPOSIT).when(tier == 3, by_class).when(tract_rate > 0, tract_rate).otherwise(0.0)


def erosion_annual(distance_km: Column, rate: Column) -> Column:
    """Nothing beyond 2 km or where the shore grows; not clipped, as fast erosion next to a site passes 1."""
    m, speed = distance_km * 1000, F.abs(rate)
    far = 1 / (1 + F.exp(0.05 * (m / speed - 100)))
    value = F.when(m < 50, 0.02 * (speed / 0.5)).when(m < 200, 0.005 * (speed / 0.5) * (200 - m) / 150).otherwise(far)
    return F.when((distance_km <= 2.0) & (rate < 0), value).otherwise(0.0)


def dam_annual(in_zone: Column) -> Column:
    return F.when(F.coalesce(in_zone, F.lit(False)), DAM_RATE).otherwise(0.0)


def wildfire_annual(p30: Column) -> Column:
    return F.when(p30 > 0, annual_from(p30)).otherwise(0.0)


def wildfire_underestimate(p30: Column, zone: Column) -> Column:
    return F.coalesce(zone.isin("Very High", "High") & (p30 < 0.05), F.lit(False))


def snap_vs30(v: Column) -> Column:
    """The nearest supported value, the lower on ties."""
    return F.array_min(F.transform(F.array(*[F.lit(x) for x in VS30_VALUES]), lambda x: F.struct(F.abs(v - x).alias("d"), x.alias("v"))))["v"]


def integrate_curve(x: Column, y: Column, retrofitted: bool = False) -> Column:
    """Annual damage: the probability of each bin by the fragility at its middle, and the tail."""
    n = F.size(x) - 1
    mids = F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: (a + b) / 2)
    mass = F.zip_with(F.slice(y, 1, n), F.slice(y, 2, n), lambda a, b: a - b)
    bins = F.zip_with(mids, mass, lambda m, p: F.when(p > 0, p * fragility(pga_to_mmi(m))).otherwise(0.0))
    tail = F.greatest(F.element_at(y, -1), F.lit(0.0)) * fragility(pga_to_mmi(F.element_at(x, -1)))
    return (F.aggregate(bins, F.lit(0.0), lambda a, b: a + b) + tail) * (0.3 if retrofitted else 1.0)


def exceedance_at(x: Column, y: Column, level: float = 0.1) -> Column:
    """Linear in the first bin that has the level; 0 if none has."""
    n = F.size(x) - 1
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(x, i).alias("x0"), F.get(x, i + 1).alias("x1"), F.get(y, i).alias("y0"), F.get(y, i + 1).alias("y1")))
    hit = F.get(F.filter(steps, lambda s: (s["x0"] <= level) & (s["x1"] >= level)), F.lit(0))
    return F.coalesce(hit["y0"] + F.try_divide(level - hit["x0"], hit["x1"] - hit["x0"]) * (hit["y1"] - hit["y0"]), F.lit(0.0))


def liquefaction_annual(exceedance: Column, in_zone: Column) -> Column:
    return F.when(in_zone, exceedance * 0.30 * 0.40).otherwise(0.0)


def aviation_risk(distance_km: Column) -> Column:
    return F.when(distance_km < 0.5, "High").when(distance_km < 1, "Moderate").when(distance_km < 2, "Elevated").otherwise("Low")


def traffic_risk(distance_m: Column, aadt: Column) -> Column:
    return F.when((distance_m < 100) & (aadt > 100_000), "Severe").when((distance_m < 200) & (aadt > 20_000), "Elevated").otherwise("Low")


def combined_p30(annuals: Column) -> Column:
    """30-year probability of any of the hazards."""
    return 1 - F.pow(F.aggregate(annuals, F.lit(1.0), lambda a, p: a * (1 - F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))), F.lit(30.0))


def combined_band(p: Column) -> Column:
    return F.when(p < 0.05, "low").when(p < 0.15, "moderate").when(p < 0.30, "elevated").otherwise("high")


def mmi_roman(mmi: Column) -> Column:
    names = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.least(F.greatest(half_up(mmi), F.lit(1)), F.lit(10)).cast("int"))
