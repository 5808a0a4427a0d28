"""Table operators: column resolution, normalisation, aggregates, windows and lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrarisk.functions import text as T
from terrarisk.operators.quantiles import exact_percentiles


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One select of canonical names: an alias as written first, then without case, then without punctuation; else NULL."""
    bare = lambda s: re.sub(r"[ .]", "_", s.lower())

    def find(names: list[str]) -> str | None:
        for same in (lambda s: s, str.lower, bare):
            for n in names:
                for c in df.columns:
                    if same(c) == same(n):
                        return c
        return None

    found = {k: find([k, *v]) for k, v in aliases.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])


def select_by_keyword(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Columns whose name holds a keyword; all if none does."""
    kept = [c for c in df.columns if any(k in c.lower() for k in keywords)]
    return df.select(*(kept or df.columns))


def detect_class_column(df: DataFrame, classes: dict) -> str | None:
    """The first text column with a value of the dictionary, found in one pass."""
    columns = [c for c, t in df.dtypes if t == "string"]
    hits = df.agg(*[F.max(F.lower(F.trim(c)).isin(list(classes))).alias(c) for c in columns]).first()
    return next((c for c in columns if hits[c]), None)


def null_sentinels(df: DataFrame, limit: float = -999) -> DataFrame:
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")}
    return df.select(*[F.when(F.col(c) > limit, F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns])


def union_sources(tagged: dict[str, DataFrame]) -> DataFrame:
    out = None
    for tag, df in tagged.items():
        df = df.withColumn("origin", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def normalize_address(df: DataFrame) -> DataFrame:
    """Display fields of raw addresses; rows without number, street or city, or outside the state's box, go."""
    street, city = T.normalize_street(F.col("street")), T.title_case(F.trim("city"))
    number, unit = F.trim("number"), F.trim(F.coalesce("unit", F.lit("")))
    line = F.concat_ws(" ", number, street, F.when(unit != "", F.concat(F.lit("#"), unit)))
    tail = F.concat(F.lit(", CA"), F.when(F.trim("postcode") != "", F.concat(F.lit(", "), F.trim("postcode"))).otherwise(""))
    out = df.withColumns({"address": line, "city": city, "postcode": F.trim("postcode"), "display": F.concat(line, F.lit(", "), city, tail), "lat": F.bround("lat", 6), "lon": F.bround("lon", 6)})
    return out.filter((F.trim("number") != "") & (F.trim("street") != "") & (F.col("city") != "") & F.col("lat").between(32.5, 42.0) & F.col("lon").between(-124.5, -114.0))


def dedupe_addresses(df: DataFrame) -> DataFrame:
    """The first per address and city, without case, in file and line order."""
    w = Window.partitionBy(F.lower("address"), F.lower("city")).orderBy("file_name", "line_no")
    return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def weighted_lep(horizons: DataFrame) -> DataFrame:
    """Thickness-weighted value per component; a horizon without a value still adds its thickness."""
    thick = F.col("hzdepb_r") - F.col("hzdept_r")
    return horizons.groupBy("cokey").agg(F.try_divide(F.sum(F.col("lep_r") * thick), F.sum(thick)).alias("lep"))


def dominant_row(df: DataFrame, key: str, share: str, seq: str, columns: list[str]) -> DataFrame:
    """The row with the largest share per key, the first by seq on ties."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(share), -F.col(seq))).alias("r")).select(key, "r.*")


def displacement_trend(stack: DataFrame, keys: list[str], t: str, v: str, least: int = 4, min_span: float = 1.0) -> DataFrame:
    """Least-squares slope, intercept and residual per pixel; at least `least` values over min_span (a year)."""
    x, y = F.when(F.col(v).isNotNull(), F.col(t)), F.col(v)
    g = stack.groupBy(*keys).agg(F.count(v).alias("n"), (F.max(x) - F.min(x)).alias("span"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    residual = F.sqrt(F.greatest((F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n"), F.lit(0.0)))
    return g.filter((F.col("n") >= least) & (F.col("span") >= min_span)).select(*keys, "n", (F.col("slope") * 1000).alias("velocity_mm_yr"), "intercept", (residual * 1000).alias("residual_mm"))


def fair_share(policies: Column, units: Column) -> Column:
    return F.coalesce(F.least(F.greatest(F.try_divide(F.coalesce(policies, F.lit(0)).cast("double"), units), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def histogram(df: DataFrame, v: Column, edges: list[float]) -> DataFrame:
    """Counts by half-open bins; bin 0 is under the first edge."""
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: v >= e)).cast("long")
    return df.filter(v.isNotNull()).groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))


def even_subsample(df: DataFrame, frame: str, order: str, n: int = 8, min_years: float = 1.0) -> DataFrame:
    """At most n rows per frame, evenly over its dates; all rows of a frame that spans under min_years."""
    w = Window.partitionBy(frame)
    k = df.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("m", F.count("*").over(w)).withColumn("years", F.datediff(F.max(order).over(w), F.min(order).over(w)) / 365.25)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("m") - 1) / (n - 1)))
    return k.filter((F.col("m") <= n) | (F.col("years") < min_years) | F.array_contains(wanted, F.col("i").cast("long"))).drop("i", "m", "years")


def prefix_search(addresses: DataFrame, queries: DataFrame, limit: int = 6, key_lengths: tuple[int, ...] = (2, 3, 4, 5), salts: int = 64) -> DataFrame:
    """Per query its first addresses that start with it, without case; queries under two characters find nothing.

    A query joins on its first characters, as many of key_lengths as it has; an address has a row for each of them. The
    first `limit` of each of `salts` parts of a query's matches are found before they meet.
    """
    low, ql = F.lower("address"), F.lower("q")
    cut = lambda v: F.transform(F.filter(F.array(*[F.lit(n) for n in key_lengths]), lambda n: F.length(v) >= n), lambda n: F.substring(v, F.lit(1), n))
    q = queries.select("q").distinct().withColumn("ql", ql).filter(F.length("ql") >= min(key_lengths)).withColumn("k", F.element_at(cut(F.col("ql")), -1))
    a = addresses.withColumn("low", low).withColumn("k", F.explode(cut(F.col("low"))))
    met = a.join(q, "k").filter(F.col("low").startswith(F.col("ql"))).withColumn("salt", F.pmod(F.xxhash64("address_id"), F.lit(salts)))
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("low", "address_id"))).filter(F.col("rank") <= limit)
    return first(first(met, "q", "salt"), "q").select("q", "rank", "address_id", "address")


# Short forms in addresses.
ABBREVIATIONS = {"st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "rd": "road", "ct": "court", "pl": "place", "n": "north", "s": "south", "e": "east", "w": "west"}


def fuzzy_prefix_match(q: Column, candidate: Column) -> Column:
    """Words of q are, in order, prefixes of words of the candidate, the first of its first word; short forms are spelled out."""
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    cw = words(candidate)

    def fits(short: Column, long: Column) -> Column:
        return long.startswith(short) | F.coalesce(long.startswith(F.try_element_at(full, short)), F.lit(False)) | F.coalesce(F.try_element_at(full, long).startswith(short), F.lit(False))

    def step(state: Column, w: Column) -> Column:
        # the place after the next fitting word, or -1
        at = F.array_min(F.filter(F.sequence(F.lit(0), F.size(cw) - 1), lambda i: (i >= state) & fits(w, F.get(cw, i)) & ((state > 0) | (i == 0))))
        return F.when((state < 0) | at.isNull(), F.lit(-1)).otherwise(at + 1)

    return (F.size(cw) > 0) & (F.size(words(q)) > 0) & (F.aggregate(words(q), F.lit(0), step) > 0)


def upsert_latest(cache: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row per key of both."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return cache.unionByName(new).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


# The box of the state that is served.
SERVED = {"south": 32.5, "north": 42.0, "west": -124.5, "east": -114.0}


def geocode_resolve(requests: DataFrame, cache: DataFrame, index: DataFrame) -> DataFrame:
    """requests (request_id, key, lat, lon) with source, lat, lon and outside.

    A request's own coordinates come first, then the cache's for its key, then the index's; else it is unresolved. What
    lies outside the served box is marked. cache and index have one row per key.
    """
    side = lambda df, n: df.select("key", F.struct("lat", "lon").alias(n))
    met = requests.join(side(cache, "_cache"), "key", "left").join(side(index, "_index"), "key", "left")
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    source = F.when(given, "given").when(F.col("_cache").isNotNull(), "cache").when(F.col("_index").isNotNull(), "index").otherwise("unresolved")
    place = F.when(given, F.struct("lat", "lon")).otherwise(F.coalesce("_cache", "_index"))
    outside = ~in_bounds(place["lat"], place["lon"])
    return met.select("request_id", source.alias("source"), place["lat"].alias("lat"), place["lon"].alias("lon"), outside.alias("outside"))


def validate_table(df: DataFrame, bad: dict[str, Column], rows: tuple[int, int] | None = None) -> DataFrame:
    """rule, n_bad: rows at which each rule's condition holds, and row_count: 1 if their number is out of bounds."""
    counts = [F.count_if(F.coalesce(condition, F.lit(False))).alias(rule) for rule, condition in bad.items()]
    if rows:
        counts.append((~F.count("*").between(*rows)).cast("long").alias("row_count"))
    return df.agg(*counts).unpivot([], [*bad, *(["row_count"] if rows else [])], "rule", "n_bad")


def in_bounds(lat: Column, lon: Column) -> Column:
    """The served box, its borders included."""
    return lat.between(SERVED["south"], SERVED["north"]) & lon.between(SERVED["west"], SERVED["east"])


def row_filter(rules: dict[str, tuple]) -> Column:
    """Column -> (kind, value ...): matches (regex), between (low, high), least (value), among (values), none_of (values;
    NULL stays). Parts that Parquet understands are pushed down to it."""
    kinds = {
        "matches": lambda c, pattern: F.regexp_like(c, F.lit(pattern)),
        "between": lambda c, low, high: c.between(low, high),
        "least": lambda c, value: c >= value,
        "among": lambda c, values: c.isin(list(values)),
        "none_of": lambda c, values: c.isNull() | ~c.isin(list(values)),
    }
    out = F.lit(True)
    for name, (kind, *values) in rules.items():
        out = out & kinds[kind](F.col(name), *values)
    return out


def apply_corrections(df: DataFrame, column: str, corrections: DataFrame) -> DataFrame:
    """df with `column` replaced where corrections (raw, corrected) has it as written; before any spelling out."""
    fixes = corrections.select(F.col("raw").alias(column), F.col("corrected").alias("_corrected"))
    return df.join(fixes, column, "left").withColumn(column, F.coalesce("_corrected", column)).select(df.columns)


def median_per_cell(points: DataFrame, value: str, cells_per_degree: int = 10, most: int = 65535) -> DataFrame:
    """i, j, v: the median of points (lat, lon) in each cell, cut to a whole number that fits 16 bits."""
    at = [F.floor(F.col(c) * cells_per_degree).alias(n) for c, n in (("lat", "i"), ("lon", "j"))]
    return points.groupBy(*at).agg(F.least(F.median(value).cast("long"), F.lit(most)).alias("v"))


def merge_max(frames: DataFrame, key: str, frame: str, value: str, columns: list[str]) -> DataFrame:
    """For each key the columns of the frame with the largest value, of the first frame on ties; NULL values go."""
    best = F.max_by(F.struct(*columns), F.struct(value, -F.col(frame)))
    return frames.filter(F.col(value).isNotNull()).groupBy(key).agg(best.alias("r")).select(key, "r.*")


def tract_rate(tracts: DataFrame, state: str = "CA") -> DataFrame:
    """tractfips, rate: frequency times loss rate of a state's tracts; tracts without a frequency go."""
    return tracts.filter((F.col("stateabbrv") == state) & F.col("lnds_afreq").isNotNull()).select("tractfips", (F.col("lnds_afreq") * F.col("lnds_hlrb")).alias("rate"))


def landslide_rate_by_n10(points: DataFrame, classes: int = 82) -> DataFrame:
    """n10, n, share: points (n10, lat, lon) of the served box by susceptibility class, all classes; the last holds what lies above."""
    known = points.filter(F.col("n10").isNotNull() & in_bounds(F.col("lat"), F.col("lon")))
    k = known.groupBy(F.least(F.greatest(F.col("n10").cast("long"), F.lit(0)), F.lit(classes - 1)).alias("n10")).agg(F.count("*").alias("n"))
    total = k.agg(F.sum("n").alias("total"))  # one row
    n = F.coalesce("n", F.lit(0))
    return points.sparkSession.range(classes).withColumnRenamed("id", "n10").join(k, "n10", "left").join(F.broadcast(total)).select("n10", n.alias("n"), (n.cast("double") / F.col("total")).alias("share"))


def n10_histogram(values: DataFrame, width: int = 5) -> DataFrame:
    """bin, n: classes 0 to width - 1 are the first bin."""
    return values.filter("n10 is not null").groupBy(F.ceil((F.col("n10") + 1) / width).alias("bin")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, value: str) -> DataFrame:
    """One row on a numeric column: n, nulls, lo, hi, mean, med, std and p90."""
    v = F.col(value)
    return df.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.median(v).alias("med"), F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(0.9)).alias("p90"))


def whole_profile(df: DataFrame, value: str) -> DataFrame:
    """One row on a numeric column: n, nulls, n_distinct, negative, zero, positive, lo, hi, mean, std, p10, med and p90,
    all exact; no aggregate holds all values. NaN counts as a value but not in the percentiles."""
    v = F.col(value)
    counts = df.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("positive"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    distinct = df.select(v).filter(v.isNotNull()).distinct().agg(F.count("*").alias("n_distinct"))
    p = exact_percentiles(df, value, [0.1, 0.5, 0.9])
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("percentile")))
    return counts.join(F.broadcast(distinct)).join(F.broadcast(p.agg(at(0.1).alias("p10"), at(0.5).alias("med"), at(0.9).alias("p90"))))  # a row each


def value_counts(df: DataFrame, dims: dict[str, str], top: int | None = None) -> DataFrame:
    """dim, value, n for each column of dims (name -> column), in one pass; the `top` most frequent of each if given."""
    columns = list(dict.fromkeys(dims.values()))
    g = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)])
    names = {c: n for n, c in dims.items()}
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        dim, value = F.when(F.col(f"_g{i}") == 0, names[c]).otherwise(dim), F.when(F.col(f"_g{i}") == 0, F.col(c).cast("string")).otherwise(value)
    out = g.select(dim.alias("dim"), F.coalesce(value, F.lit("none")).alias("value"), "n")
    if top is None:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("dim").orderBy(F.col("n").desc(), "value"))).filter(F.col("_r") <= top).drop("_r")


def census_policy_join(units: DataFrame, policies: DataFrame) -> DataFrame:
    """zip, housing_units and pif, 0 for zips without policies."""
    return units.select("zip", "housing_units").join(policies.select("zip", "pif"), "zip", "left").select("zip", "housing_units", F.coalesce("pif", F.lit(0)).cast("long").alias("pif"))


def top_n_zips(policies: DataFrame, n: int = 10) -> DataFrame:
    """The n zips with the most policies, ties by zip."""
    return policies.filter("pif is not null").orderBy(F.col("pif").desc(), "zip").limit(n).select("zip", F.col("pif").cast("long").alias("pif"))


def policy_trend(wide: DataFrame, years: list[int]) -> DataFrame:
    """zip, year, pif and the change from the year before, from a column pif_<year> for each year."""
    long = wide.select("zip", *[F.col(f"pif_{y}").cast("long").alias(str(y)) for y in years]).unpivot("zip", [str(y) for y in years], "year", "pif").withColumn("year", F.col("year").cast("long"))
    return long.withColumn("change", F.col("pif") - F.lag("pif").over(Window.partitionBy("zip").orderBy("year")))


def frame_order(frames: DataFrame, west: str = "lon", n: int = 2) -> DataFrame:
    """frame_id and its western end, the n most western frames in order."""
    return frames.groupBy("frame_id").agg(F.min(west).alias("west")).orderBy("west", "frame_id").limit(n)
