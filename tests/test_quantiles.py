"""Exact percentiles, and exports in exact chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarisk.operators.quantiles import exact_percentiles
from terrarisk.sources import files as X

QS = [0.0, 0.1, 0.5, 0.77, 1.0]


@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_percentiles(spark, kind):
    rng = np.random.default_rng(1)
    v = {"spread": rng.lognormal(0, 3, 5000), "ties": np.where(rng.random(5000) < 0.6, 7.0, rng.integers(0, 40, 5000)), "one": np.array([3.0])}[kind]
    rows = [(int(i % 3) if i % 3 else None, float(x)) for i, x in enumerate(v)] + [(1, None), (2, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g int, x double").withColumn("q", F.lit("own")).withColumn("lo", F.lit(1))
    got = {r.q: (r.n, r.percentile) for r in exact_percentiles(df, "x", QS, limit=20).collect()}
    assert set(got) == set(QS) and all(got[q][0] == len(v) and np.isclose(got[q][1], np.percentile(v, 100 * q), rtol=1e-12) for q in QS)
    by = {(r.g, r.q): r.percentile for r in exact_percentiles(df, "x", QS, ["g"], limit=20).collect()}
    groups = {g: [x for k, x in rows if k == g and x is not None and x == x] for g in (None, 1, 2)}
    assert set(by) == {(g, q) for g, xs in groups.items() if xs for q in QS}
    assert all(np.isclose(p, np.percentile(groups[g], 100 * q), rtol=1e-12) for (g, q), p in by.items())
    none = exact_percentiles(df.limit(0), "x", [0.5]).collect()
    assert [(r.n, r.percentile) for r in none] == [(0, None)]


def test_exact_chunks(spark, tmp_path):
    """Chunks over the borders of ranges: sizes, order, ties by the other columns, quotes, an empty table."""
    df = spark.range(1003).select((F.col("id") * 7919 % 500).alias("k"), F.concat(F.lit("o'"), F.col("id").cast("string")).alias("v")).repartition(7)
    X.export_chunks(df, f"{tmp_path}/out", "k", 100)
    folders = sorted((tmp_path / "out").glob("chunk=*"), key=lambda p: int(p.name[6:]))
    lines = []
    for i, folder in enumerate(folders):
        files = list(folder.glob("part-*"))
        own = files[0].read_text().splitlines()
        assert len(files) == 1 and len(own) == (100 if i < 10 else 3)
        lines += own
    want = sorted((r.k, r.v) for r in df.collect())
    assert lines == [f"INSERT INTO t (k, v) VALUES ('{k}', '{v.replace(chr(39), chr(39) * 2)}');" for k, v in want]
    assert sorted(r._row for r in X.numbered(df, ["k"]).collect()) == list(range(1003))
    X.export_chunks(df.limit(0), f"{tmp_path}/none", "k", 100)
    assert not list((tmp_path / "none").glob("chunk=*"))
