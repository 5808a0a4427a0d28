"""Files of one large value read by ranges, and tables laid out for prefixes."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrarisk.sources import files as X
from terrarisk.sources import splits
from terrarisk.sources.sorted_text import files_of_prefix, prefix_lookup, write_sorted

CHARACTERS = ["a", '"', "\\", "{", "}", "[", "]", ",", ":", "é", " ", "\n"]


def text(rnd):
    return "".join(rnd.choice(CHARACTERS) for _ in range(rnd.randint(0, 30)))


def collection(rnd, n):
    """Features amid members that look like them, in strings and elsewhere."""
    features = [{"type": "Feature", "properties": {"k": str(i), "t": text(rnd)}, "geometry": {"type": "Point", "coordinates": [i, 1.5]}} for i in range(n)]
    return features, {"type": "FeatureCollection", "crs": {"properties": {"features": [{"no": 1}]}}, "name": '"features":[', "other": [{"type": "Feature"}], "features": features, "after": [{"q": text(rnd)}]}


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_ranges_have_the_state_of_a_whole_scan(monkeypatch, size):
    monkeypatch.setattr(splits, "BLOCK", 5)
    rnd = random.Random(size)
    raw = json.dumps(collection(rnd, 12)[1], ensure_ascii=False).encode()
    f = pa.BufferReader(raw)
    quoted, depth = False, 0
    for start in range(0, len(raw), size):
        flips, outside, inside = splits._effect(f, start, min(start + size, len(raw)))
        depth += inside if quoted else outside
        quoted ^= flips
        plain_quoted, plain_depth, escaped = False, 0, False
        for ch in raw[: start + size].decode("utf-8", "ignore"):
            if plain_quoted:
                plain_quoted, escaped = (plain_quoted, False) if escaped else (ch != '"', ch == "\\")
            else:
                plain_quoted, plain_depth = ch == '"', plain_depth + (ch in "{[") - (ch in "}]")
        assert (quoted, depth) == (plain_quoted, plain_depth)
    assert (quoted, depth) == (False, 0)


@pytest.mark.parametrize("split_bytes", [900, 1 << 20])
def test_elements_of_a_collection(spark, tmp_path, split_bytes):
    features, whole = collection(random.Random(3), 120)
    (tmp_path / "a b.json").write_text(json.dumps(whole, ensure_ascii=False), "utf-8")
    (tmp_path / "none.json").write_text('{"features": [ ]}')
    (tmp_path / "other.json").write_text('{"x": [1, 2]}')
    (tmp_path / "nulls.json").write_text(json.dumps({"features": [None, {"k": 1}]}, indent=2))
    (tmp_path / "empty.json").write_text("")
    read = splits.json_elements(spark, str(tmp_path), "features", split_bytes)
    got = {}
    for r in read.collect():
        got.setdefault(os.path.basename(r.path), []).append((r.seq, json.loads(r.value)))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {"a b.json": list(enumerate(features)), "nulls.json": [(0, None), (1, {"k": 1})]}
    if split_bytes == 900:  # several tasks read the one file
        assert read.filter(F.col("path").contains("a b")).select(F.spark_partition_id()).distinct().count() > 5
    rows = X.read_features(spark, str(tmp_path / "a b.json"), "l", split_bytes).orderBy("seq").collect()
    assert [(r.seq, r.props["k"], r.props["t"], r.parts[0].rings[0][0].x) for r in rows] == [(i, str(i), f["properties"]["t"], float(i)) for i, f in enumerate(features)]


def test_pairs_of_an_object(spark, tmp_path):
    rnd = random.Random(5)
    pairs = {text(rnd) + str(i): rnd.random() for i in range(150)}
    (tmp_path / "kv.json").write_text(json.dumps(pairs))
    assert {r.key: r.value for r in X.read_kv_json(spark, str(tmp_path), 500).collect()} == pairs


def test_prefix_opens_only_its_files(spark, tmp_path):
    rows = [(i, f"{i % 500:03d} Oak St") for i in range(2000)] + [(5000 + i, "777 Hot Rd") for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, address string")
    path = f"file://{tmp_path}/sorted"
    write_sorted(df, path, "address", "id", 10)
    for prefix in ("12", "123 OAK", "777", "4", "zz", "%", ""):
        low = prefix.lower()
        plain = sorted((a.lower(), i) for i, a in rows if a and len(prefix) >= 2 and a.lower().startswith(low))
        assert [(r.address.lower(), r.id) for r in prefix_lookup(spark, path, prefix, "id").collect()] == plain[:6]
        assert sorted((r.address.lower(), r.id) for r in prefix_lookup(spark, path, prefix, "id", None).collect()) == plain
    total = spark.read.parquet(f"{path}/rows").inputFiles()
    found = prefix_lookup(spark, path, "123", "id")
    assert len(found.inputFiles()) == len(files_of_prefix(spark, path, "123", 6)) <= 2 < len(total)
    assert len(files_of_prefix(spark, path, "777")) > len(files_of_prefix(spark, path, "777", 6))  # a frequent text fills several
