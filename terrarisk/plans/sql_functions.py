"""SQL functions for SQL users: the scalar formulas under names that spark.sql can call."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

FUNCTIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": "2 * 6371 * asin(least(1, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "p_horizon(annual DOUBLE, years DOUBLE)": "1 - pow(1 - annual, years)",
    "pga_to_mmi(pga DOUBLE)": "CASE WHEN pga <= 0 THEN 1D WHEN log10(pga * 980.665) < 1.57 THEN 1.78 + 1.55 * log10(pga * 980.665) ELSE -1.60 + 3.70 * log10(pga * 980.665) END",
    "ground_motion(magnitude DOUBLE, distance_km DOUBLE, vs30 DOUBLE)": "exp(0.4473D + CASE WHEN magnitude <= 5.5 THEN 0.4856D ELSE -0.1091D END * (magnitude - 5.5D) + (-1.243D + 0.1489D * (magnitude - 4.5D)) * ln(sqrt(distance_km * distance_km + 28.09D)) - 0.00344D * (sqrt(distance_km * distance_km + 28.09D) - 1D) - 0.6D * ln(least(vs30, 1500D) / 760D))",
    "fragility(mmi DOUBLE)": "CASE WHEN mmi < 5 THEN 0D WHEN mmi < 6 THEN 0.01D + 0.04D * (mmi - 5) WHEN mmi < 7 THEN 0.05D + 0.1D * (mmi - 6) WHEN mmi < 8 THEN 0.15D + 0.2D * (mmi - 7) WHEN mmi < 9 THEN 0.35D + 0.25D * (mmi - 8) WHEN mmi < 10 THEN 0.6D + 0.2D * (mmi - 9) ELSE 0.8D END",
    "flood_annual(zone STRING)": "CASE WHEN zone IN ('V', 'VE') THEN 0.006D WHEN zone IN ('AE', 'A', 'AH', 'AO', 'A99', 'AR') THEN 0.004D WHEN zone = 'D' THEN 0.0015D WHEN zone = 'X' THEN 0.00002D ELSE 0.000005D END",
}


@udtf(returnType="ci bigint, cj bigint")
class CoverCells:
    """The grid cells that a box, grown by buffer, touches: a row each, none for a box with a NULL."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, cell: float, buffer: float = 0.0):
        if None in (xmin, ymin, xmax, ymax, cell, buffer):
            return
        for i in range(math.floor((ymin - buffer) / cell), math.floor((ymax + buffer) / cell) + 1):
            for j in range(math.floor((xmin - buffer) / cell), math.floor((xmax + buffer) / cell) + 1):
                yield i, j


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    spark.udtf.register("cover_cells", CoverCells)
