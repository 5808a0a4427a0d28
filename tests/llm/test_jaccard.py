"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from terrarisk.llm import jaccard_join
from terrarisk.llm.common import table
from terrarisk.llm.components import components


def brute(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), low[root(i)]) for i, (doc, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for base in range(8):
        words = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 120, 300]))]
        for _ in range(25):  # chains of edits from unedited to far apart
            copy = list(words)
            for _ in range(r.randrange(0, 8)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    common = " ".join(r.choice(vocabulary) for _ in range(30))
    out += [common + " " + " ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    out += [None, "", " \n", "a", "A", "a b", "a b c", "A b\tC", "a b c d", "é É", "x " * 50, "x " * 70]
    out += out[:20]
    return list(enumerate(out, 1))


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_links(spark, rows, batch):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = jaccard_join.jaccard_components(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == brute(rows)


def test_small_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = jaccard_join.jaccard_components(docs.withColumn("key", jaccard_join.F.lit(1))).collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, int(x)) for x in range(101, 180)] + [(int(a) + 500, int(b) + 500) for a, b in r.integers(0, 300, (200, 2))]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)


def test_group_of_near_copies(spark):
    """2,000 copies of one text with up to four edits each, as in a copied notice, and 100 rows without an id."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(2000):
        copy = list(words)
        for _ in range(r.randrange(5)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        rows.append((i + 1, " ".join(copy)))
    got = {x.doc_id: x for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    sets = {d: frozenset(tuple(t.split()[i : i + 4]) for i in range(97)) for d, t in rows}
    base = frozenset(tuple(words[i : i + 4]) for i in range(97))
    # a copy links with another if few shingles differ; all that link meet in one component
    linked = {}
    by = sorted(sets, key=lambda d: -len(sets[d] & base))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, a in enumerate(by):
        for b in by[:k]:
            if root(a) != root(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    for d in sets:
        linked.setdefault(root(d), []).append(d)
    assert all(got[d].component_id == min(group) for group in linked.values() for d in group)


def test_near_copies_meet_by_pivots(spark, monkeypatch):
    """1,500 copies of one text, most pairs of which are near the threshold: star rounds join them, and what is taken whole
    makes few pairs."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(1500):
        copy = list(words)
        for _ in range(r.randrange(1, 7)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        rows.append((i + 1, " ".join(copy)))
    made = []
    whole = jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *rest: (made.append(pairs.count()), whole(pairs, *rest))[1])
    jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert made[-1] < 1000


def test_rows_without_ids(spark):
    rows = [(None, "a b c d e f g h")] * 60 + [(None, f"t{i} u v w x y z") for i in range(40)] + [(5, "a b c d e f g h"), (6, "t1 u v w x y z"), (6, "quite another text under one id"), (None, None), (7, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert sum(r.component_id == 5 for r in got) == 61 and sum(r.component_id == 6 for r in got) == 3
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted({(str(d), t or "") for d, t in [(5, rows[0][1]), (6, "t1 u v w x y z"), (6, "quite another text under one id"), (None, None), (7, None), *[(None, f"t{i} u v w x y z") for i in range(40) if i != 1]]})


def test_sets_too_far_apart_make_no_pair(spark):
    """Of two sets of 100 with one shared shingle at the start of their prefixes only those of like signatures are met."""
    own = "n int, pos int, rank int, level int, " + ", ".join(f"{c} long" for c in jaccard_join.SHORT)
    kinds = ", ".join(f"{side}{x}" for side in ("a_", "b_") for x in own.split(", "))
    near, far = [100, 1, 1, 1, 0, 0, 0, 0], [100, 1, 1, 1, -1, 0, 0, 0]  # 64 bits differ, 16 shingles may
    both = spark.createDataFrame([tuple(near + near), tuple(near + far)], kinds)
    assert [r.met for r in both.selectExpr(f"{jaccard_join.may_link('a_', 'b_', 85)} AS met").collect()] == [True, False]


def test_folded_signatures():
    """A short signature differs in no more bits than the sets in shingles."""
    r = np.random.default_rng(4)
    for n in (1, 30, 700, 40_000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], r.integers(0, 1 << 63, n // 9).astype(np.uint64)]))
        x, y = (np.array(jaccard_join.folded(jaccard_join.signature(s))) for s in (a, b) if len(s)) if len(b) else (np.zeros(4, int), np.zeros(4, int))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
