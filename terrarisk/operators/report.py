"""The site report: all structural hazards of a site and both states of retrofit, from the columns that joins bring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrarisk.functions import hazard as H
from terrarisk.operators.quantiles import exact_percentiles

HAZARDS = ["earthquake", "wildfire", "flood", "tsunami", "landslide", "dam", "erosion"]


def other_hazards(sites: DataFrame) -> DataFrame:
    """sites with landslide_tier, wildfire_low and an annual probability for each of HAZARDS but earthquake.

    Needs fire_p30, fire_zone, fld_zone, in_tsunami, elevation, coast_km, deposit (in a mapped one), confidence, velocity,
    slide_zone, n10, tract_rate, in_dam, shore_km, shore_rate.
    """
    c = F.col
    tier = H.landslide_tier(c("deposit"), c("confidence"), c("velocity"), c("slide_zone"), c("n10"))
    return sites.withColumn("landslide_tier", tier).withColumns(
        {
            "wildfire": H.wildfire_annual(c("fire_p30")),
            "wildfire_low": H.wildfire_underestimate(c("fire_p30"), c("fire_zone")),
            "flood": H.flood_annual(c("fld_zone")),
            "tsunami": H.tsunami_annual(c("in_tsunami"), c("elevation"), c("coast_km")),
            "landslide": H.landslide_annual(c("landslide_tier"), c("n10"), c("tract_rate")),
            "dam": H.dam_annual(c("in_dam")),
            "erosion": H.erosion_annual(c("shore_km"), c("shore_rate")),
        }
    )


def structural(sites: DataFrame) -> DataFrame:
    """other_hazards with earthquake and earthquake_retrofitted; needs also xs, ys (hazard curve; NULL: no earthquake term)
    and liquefaction (in the zone)."""
    c = F.col
    liquefaction = H.liquefaction_annual(H.exceedance_at(c("xs"), c("ys")), c("liquefaction"))
    shaking = lambda retrofit: F.when(c("xs").isNull(), 0.0).otherwise(1 - (1 - H.integrate_curve(c("xs"), c("ys"), retrofit)) * (1 - liquefaction))
    return other_hazards(sites).withColumns({"earthquake": shaking(False), "earthquake_retrofitted": shaking(True)})


def site_report(sites: DataFrame) -> DataFrame:
    """site_id, the annual probabilities, and the 30-year probability of any hazard without and with a retrofit."""
    own = structural(sites)
    other = [h for h in HAZARDS if h != "earthquake"]
    total = lambda quake: H.combined_p30(F.array(quake, *other))
    return own.select("site_id", *[F.col(h).alias(f"{h}_annual") for h in HAZARDS], "landslide_tier", "wildfire_low", total("earthquake").alias("p30"), total("earthquake_retrofitted").alias("p30_retrofitted"))


def portfolio_percentiles(reports: DataFrame, dims: list[str], threshold: float) -> DataFrame:
    """dims, n, n_over (p30 above the threshold) and the exact percentiles p50 and p90 of p30 of each group."""
    counts = reports.groupBy(*dims).agg(F.count("*").alias("n"), F.count_if(F.col("p30") > threshold).alias("n_over"))
    p = exact_percentiles(reports, "p30", [0.5, 0.9], dims).groupBy(*dims).agg(*[F.max(F.when(F.col("q") == q, F.col("percentile"))).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"))])
    same = [counts[d].eqNullSafe(p[d]) for d in dims]
    return counts.join(p, same, "left").select(*[counts[d] for d in dims], "n", "n_over", "p50", "p90")
