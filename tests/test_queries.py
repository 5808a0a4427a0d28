"""Registered queries against their SQL on DuckDB, on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from terrarisk.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)

    def plain(df):
        df = df[columns].copy()
        for c in columns:
            if df[c].dtype == object:
                df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v))
            elif df[c].dtype == bool:
                df[c] = df[c].astype(str)
            else:
                df[c] = df[c].astype(float).round(5) + 0.0
        return df.sort_values(columns).reset_index(drop=True)

    a, b = plain(a), plain(b)
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype == object:
            assert (a[c] == b[c]).all(), c
        else:
            assert np.allclose(a[c].fillna(-1e9), b[c].fillna(-1e9), atol=2e-6), c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_nested_loops(spark):
    """The operators' own plans; the derived tables multiply by literal rows."""
    from terrarisk.functions.geometry import GEOMETRY
    from terrarisk.operators import raster, spatial

    sites = spark.createDataFrame([(1, 34.0, -118.0, 1, 34.0, -118.5)], "site_id long, lat double, lon double, tile_id long, south double, west double")
    layer = spark.createDataFrame([(1, 1, [([[(0.0, 0.0), (1.0, 1.0)]],)])], f"poly_id long, seq long, parts {GEOMETRY}")
    pixels = spark.createDataFrame([(1, 0, 0, 1.0)], "tile_id long, row long, col long, value double")
    points = sites.select(sites.site_id.alias("feature_id"), "lat", "lon")
    for df in (
        spatial.zone_lookup(sites.select("site_id", "lat", "lon"), layer, ["poly_id"]),
        spatial.zone_exists(sites, layer),
        spatial.nearest_of(spatial.line_distances(sites, layer, "poly_id", 20.0), "poly_id"),
        spatial.point_distances(sites, points, "feature_id", 5.0),
        spatial.nearest_centroid(points, points.withColumnRenamed("feature_id", "zip"), "feature_id", "zip"),
        raster.sample_bilinear(sites, pixels, 40, 40),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["m2_kfold_auc", "m4_feature_importance", "m7_response_surface", "m8_interp_trilinear", "m9_scenario_scores"])
def test_models(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name == "m2_kfold_auc":
        assert len(got) == 5 and got["auc"].min() > 0.75
    if name in ("m7_response_surface", "m8_interp_trilinear"):
        assert got["p"].between(0, 1).all()


def test_works_without_llm(tmp_path):
    """A copy without both llm folders and the pipeline: the entry imports and has all other queries."""
    repo = Path(__file__).resolve().parent.parent
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", ".tmp")
    shutil.copytree(repo, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; print('N', len(e.queries()), len(e.oracle_sql()), [k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert f"N {len(QUERIES)} {len(ORACLES)} []" in said.stdout
