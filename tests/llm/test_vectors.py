"""Operators on embeddings and language: brute force, numpy's eigenvectors, held-out accuracy."""

import zlib

import numpy as np
import pytest

from terrarisk.llm import bond, language_id, vectors, whitening
from terrarisk.llm.common import table

SF = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")
ROWS = "vec_id long, label int, embedding array<float>, x string, _v int, score double, anchor int, share int, place int, d int"


def odd_rows(spark, dims=64, n=130, levels=3):
    """Vectors of few different values, so that ties abound, repeated ones, and rows that take no part."""
    r = np.random.default_rng(5)
    extra = ("x", 1, 2.0, 3, 4, 5, 6)
    rows = [(i, int(r.integers(0, 3)), [float(v) for v in r.integers(-levels, levels + 1, dims) / 64], *extra) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2], *extra) for i in range(20)] + [rows[3], rows[100], (None, 1, rows[5][2], *extra)]
    bad = [None, [], [None] * dims, [NAN] * dims, [INF] + [0.0] * (dims - 1), [1.0] * (dims - 1)]
    rows += [(500 + i, 1, v, *extra) for i, v in enumerate(bad)] + [(600, None, rows[0][2], *extra)]
    return spark.createDataFrame(rows, ROWS)


def brute_negatives(rows):
    usable = []
    for r in rows:
        v = r.embedding
        if r.label is not None and v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v):
            moved = (r.label + 1) % 10 if r.vec_id is not None and r.vec_id % 7 == 0 else r.label
            usable.append((r.vec_id, moved, np.floor(256 * np.array(v, float)).astype(int)))
    out, last = [], 1 << 63
    for a in {(i, m, tuple(x)) for i, m, x in usable if i is not None and i % 100 == 0}:
        score = [(-int(np.array(a[2]) @ x), last if i is None else i, i, m) for i, m, x in usable if i != a[0]]
        same, other = sorted((s[:2], s[2]) for s in score if s[3] == a[1]), sorted((s[:2], s[2]) for s in score if s[3] != a[1])
        for (p, _), pid in [(s[0], s[1]) for s in same[:5]]:
            inside = [(s, i) for s, i in other if 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(a[0], pid, k + 1, i, -p, -s[0]) for k, (s, i) in enumerate(inside[:5])]
    return out


def key(t):
    return tuple(-1 if v is None else v for v in t)


@pytest.mark.parametrize("levels", [1, 3, 40])
def test_hard_negatives(spark, levels, monkeypatch):
    rows = odd_rows(spark, levels=levels)
    want = sorted(brute_negatives(rows.collect()), key=key)
    assert want
    got = lambda **more: sorted((tuple(r) for r in bond.hard_negatives(rows.repartition(3), **more).collect()), key=key)
    assert got() == want
    assert got(block=1) == want
    monkeypatch.setattr(bond, "BLOCK", 16)
    assert got() == want
    assert bond.hard_negatives(rows.limit(0)).count() == 0
    assert bond.hard_negatives(rows.filter("vec_id >= 500")).count() == 0


def test_scan_prunes(spark):
    """A planted near copy: the scan drops most rows before all dimensions are read, and finds it."""
    r = np.random.default_rng(2)
    x = r.integers(-40, 40, (4000, 64))
    anchor = np.where(np.arange(64) < 8, 200, 1)
    x[17] = anchor
    block, left = bond.Block(np.arange(4000), np.zeros(4000, int), x), []

    def keep(lower, upper):
        stay = upper >= bond.kth(lower, 1)
        left.append(int(stay.sum()))
        return stay

    alive, score = block.scan(anchor, np.arange(4000), keep)
    assert left[0] < 40 and alive.tolist() == [17] and score.tolist() == [int(anchor @ anchor)]


def test_large_components(spark):
    big = [(i, i % 2, [3e5 * (1 + i % 3), -2e5, float(i)]) for i in range(0, 300, 4)] + [(1, 0, [1e300, 0.0, 0.0])]
    rows = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    for r in bond.hard_negatives(rows).collect():
        assert 80 * r.positive_score <= 100 * r.negative_score <= 100 * r.positive_score
    x = vectors.scaled(rows, "embedding", 256)[0].filter("vec_id = 1").first().x
    assert x == [1 << 26, 0, 0]


def test_whitening(spark):
    for rows, k in ((table(spark, SF, "embeddings"), 16), (odd_rows(spark), 16), (odd_rows(spark).limit(5), 4)):
        ok = [r for r in rows.collect() if r.embedding is not None and len(r.embedding) == 64 and all(c is not None and np.isfinite(c) for c in r.embedding)]
        x = np.array([np.floor(64 * np.array(r.embedding, float)).astype(int) + 1_000_000 for r in ok])
        fit = np.unique(x, axis=0)
        n, total = len(fit), fit.sum(0)
        centred = (n * fit - total).astype(float) / n
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        got = whitening.whiten(rows).toPandas()
        assert sorted(got["component"].unique()) == list(range(1, k + 1)) and len(got) == len(ok) * k and (got["n"] == n).all()
        assert got["identity_error"].max() < 1e-9
        own = {(-1 if r.vec_id is None else r.vec_id): i for i, r in enumerate(ok)}
        w = (n * x - total).astype(float) / n @ axes[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
        for c in range(k):
            part = got[got["component"] == c + 1]
            at = [own[-1 if v != v else int(v)] for v in part["vec_id"]]
            assert np.allclose(np.abs(part["whitened"]), np.abs(w[at, c]), atol=1e-6)
            assert (part["deviation"].astype(int).to_numpy() == ((n * x - total) ** 2).sum(1)[at]).all()
            assert np.allclose(part["explained"], values[::-1][c] / values.sum(), rtol=1e-9)


def test_whitening_of_little(spark):
    rows = odd_rows(spark)
    assert whitening.whiten(rows.limit(0)).count() == 0
    assert whitening.whiten(rows.filter("vec_id = 3")).count() == 0  # one vector: no variance
    assert whitening.whiten(rows.filter("vec_id in (500, 501, 502, 503, 504)")).count() == 0


def spectrum(values, seed):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 5, 40), np.array([3.0, 3, 2, 1, 1]), np.r_[2 + 1e-9 * np.arange(10), 1 + 1e-5 * np.arange(30)], np.array([4.0, 0, 0]), np.r_[5, 5 + 1e-14, 5 + 2e-14, np.linspace(1, 2, 20)], np.array([0.0, 0, 0])])
def test_spectrum_slicing(values):
    a, want = spectrum(values, 3), np.sort(values)[::-1]
    for s in (0.3, 1.7, 4.2):
        assert whitening.above(a, s) == (values > s).sum()
    got = whitening.leading(a, 16)
    assert len(got) == min(16, (want > 1e-12).sum())
    q = np.array([v for _, v in got]).reshape(len(got), len(a))
    assert np.allclose([v for v, _ in got], want[: len(got)], atol=1e-13)
    assert np.allclose(q @ q.T, np.eye(len(got)), atol=1e-12)
    assert all(np.linalg.norm(a @ v - e * v) < 1e-12 for e, v in got)


def test_letter_trigrams(monkeypatch):
    text = "Ab c. été 中文 x" * 50
    number = lambda t: (ord(t[0]) * int(language_id._CODE) + ord(t[1])) * int(language_id._CODE) + ord(t[2])
    plain: dict[int, int] = {}
    padded = " " + text.lower() + " "
    for i in range(1, len(padded) - 1):
        t = ["\0" if not c.isalpha() else c for c in padded[i - 1 : i + 2]]
        if t[1] != "\0":
            plain[number(t)] = plain.get(number(t), 0) + 1
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(language_id, "PIECE", piece)
        grams, counts = language_id.trigrams(text)
        assert dict(zip(grams.tolist(), counts.tolist())) == plain
    signs = 1 - 2.0 * language_id.letter_signs(np.array([0, 97, 98]), 1024)
    a, b, end = signs[1], signs[2], signs[0]
    want = np.roll(end, 2) * np.roll(a, 1) * b * 3 + np.roll(a, 2) * np.roll(b, 1) * end
    grams = np.array([number("\0ab"), number("ab\0")])
    assert np.allclose(language_id.bundle(grams, np.array([3, 1]), 1024), want)
    assert abs(signs @ signs.T / 1024 - np.eye(3)).max() < 0.15


def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    odd = [(-1, None, "en"), (-2, "", "en"), (-3, "12 + 3", "de"), (-4, "word " * 300_000, None), (-5, "same", "fr"), (-5, "same", "fr"), (None, "the", "en")]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).selectExpr("*", "1 as score", "'q' as lang_pred", "2 as k", "3 as v", "4 as held_out")
    got = language_id.identify(both).collect()
    assert len(got) == both.count()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [(r.lang_pred, lang[r.doc_id]) for r in got if r.doc_id in lang and r.held_out]
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([p == t for p, t in held]) > 0.97
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (-1, -2, -3)} == {("und", 0.0)}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == -5}) == 1
    assert language_id.identify(both.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(both.filter("doc_id < 0 and lang = 'en'")).collect()} == {"und"}
