"""Trained operators: exact parts against plain versions, and held-out accuracy."""

import html
import random
import re
import time

import numpy as np
import pytest

from terrarisk.llm import html_extract, toxicity, weak_label
from terrarisk.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labeller():
    return html_extract.labeller()


def test_pages_exact(spark, labeller):
    pages = table(spark, SF, "pages")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<div class=sidebar>"), (-4, None, "<script>if (a < b) '</p>'")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages.unionByName(odd).withColumn("text", html_extract_lit(1))).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))
    assert all(got[k].text == "" and got[k].n_chars == 0 for k in (-1, -2, -3, -4))
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def html_extract_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_blocks():
    page = "<body>a &amp; b<nav><a href='>'>x</a><a>y</a></nav><p>one<br> two <b>three<p>four<li>five<li>six<!-- <p>no --><script>'<p>'</script> seven</body>"
    assert [t for _, t, _ in html_extract.blocks(page)] == ["a & b", "xy", "one two three", "four", "five", "six", "seven"]
    assert html_extract.blocks(page)[1][2] == 1.0


def test_blocks_in_linear_time():
    """Pages of a megabyte that make a backtracking reader quadratic."""
    began = time.time()
    assert len(html_extract.blocks('<a "' * 250_000)) == 1
    assert html_extract.blocks('<a "' * 100_000 + "'>") == []  # one tag, whose quotes don't close
    assert len(html_extract.blocks("<div>x" * 100_000 + "</b>" * 100_000)) == 100_000
    html_extract.blocks("<p><table>" + "<div>" * 150_000)
    html_extract.blocks("<!" * 500_000)
    assert time.time() - began < 60


def test_plain_divs_without_article(labeller):
    """Pages whose article is in a plain div."""
    r, found, wanted = random.Random(5), 0, 0
    for _ in range(40):
        body = [" ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "nunc"]) for _ in range(r.randint(25, 60))).capitalize() + "." for _ in range(r.randint(3, 6))]
        page = f"<html><body><div class='menu'><ul>{''.join(f'<li><a href=/x>{w}</a></li>' for w in ('home', 'news', 'about'))}</ul></div><div class='content'><h1>Title of it</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div class='footer'><p>&copy; 2020 us</p></div></body></html>"
        text = html_extract.extract_texts([page], labeller)[0]
        found += sum(b in text for b in body) - text.count("home") - text.count("2020")
        wanted += len(body)
    assert found / wanted > 0.95


def test_labeller_on_unseen_layouts(labeller):
    r, right, n = random.Random(77), 0, 0
    for _ in range(120):
        page, labels = html_extract.made_page(r)
        found = html_extract.blocks(page)
        p = labeller.probabilities([html_extract.block_vectors(found)])[0]
        right += ((p >= 0.5) == np.array(labels)).sum()
        n += len(labels)
    assert right / n > 0.985


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    cell = html_extract.Lstm(3, 4, rng)
    x, mask = rng.standard_normal((5, 2, 3)).astype(np.float32), np.ones((5, 2), np.float32)
    mask[3:, 1] = 0
    target = rng.standard_normal((5, 2, 4)).astype(np.float32)
    keep: list = []
    cell.forward(x, mask, keep)
    dw, _ = cell.backward(x, target, keep)
    for i, j in ((0, 0), (2, 7), (5, 15), (6, 9)):
        base = cell.w[i, j]
        cell.w[i, j] = base + 1e-2
        up = (cell.forward(x, mask) * target).sum()
        cell.w[i, j] = base - 1e-2
        down = (cell.forward(x, mask) * target).sum()
        cell.w[i, j] = base
        assert abs((up - down) / 2e-2 - dw[i, j]) < 2e-2 * max(1, abs(dw[i, j]))


def test_batches_do_not_matter(labeller, monkeypatch):
    r = random.Random(3)
    pages = [html_extract.block_vectors(html_extract.blocks(html_extract.made_page(r)[0])) for _ in range(9)] + [np.zeros((0, 118), np.float32)]
    together = labeller.probabilities(pages)
    monkeypatch.setattr(html_extract, "BATCH_BLOCKS", 1)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together, labeller.probabilities(pages)))


ODD = [(-1, None), (-2, ""), (-3, " \n"), (-4, "a"), (-5, "word " * 30_000), (-6, "same"), (-6, "same")]


def test_weak_labels(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    both = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("score", html_extract_lit("x"))
    got = weak_label.weak_label_classifier(both).collect()
    assert len(got) == both.count()
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (-1, -2, -3))
    assert len({(r.vote_pattern, r.score) for r in got if r.doc_id == -6}) == 1
    kept = {r.doc_id: r.kept for r in got}
    pairs = [(kept[r.doc_id], r.quality) for r in table(spark, SF, "labels").collect()]
    good = [k for k, q in pairs if q == 1]
    bad = [k for k, q in pairs if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4
    assert weak_label.weak_label_classifier(both.limit(0)).count() == 0


def test_em_recovers_labellers():
    rng = np.random.default_rng(4)
    m = len(weak_label.LABELLERS)
    given = np.array([[[0.7, 0.2, 0.1], [0.05, 0.2, 0.75]]] * m)
    truth = rng.random(20_000) < 0.8
    counts = {}
    for y in truth:
        p = weak_label.pattern(tuple(rng.choice(3, p=given[j, int(y)]) for j in range(m)))
        counts[p] = counts.get(p, 0) + 1
    found, post = weak_label.fit_labellers(counts)
    assert np.abs(found - given).max() < 0.05
    n = sum(counts.values())
    assert abs(sum(k * post[p] for p, k in counts.items()) / n - 0.8) < 0.02


def test_toxicity_models_do_not_mix():
    """A worker that scores with one model after another uses the dictionaries of each."""
    train = lambda word: toxicity.Model(b" plain words of a text " * 20, b" plain words of a text " * 20 + word * 5, np.zeros(7), np.ones(7), np.ones(8))
    fresh = {}
    for word in (b" qqzzxxyy ", b" kkjjhhgg "):
        fresh[word] = toxicity.score(b"a qqzzxxyy b kkjjhhgg kkjjhhgg", train(word))
    for k in range(20):
        word = (b" qqzzxxyy ", b" kkjjhhgg ")[k % 2]
        assert toxicity.score(b"a qqzzxxyy b kkjjhhgg kkjjhhgg", train(word)) == fresh[word]
    assert len(set(fresh.values())) == 2


def test_toxicity(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text"), table(spark, "/root/testdata/sf0.1", "labels")
    both = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    out = toxicity.toxicity(both, labels)
    got = {r.doc_id: r for r in out.drop("text").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[-1].score == got[-2].score == got[-3].score
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    s, y = np.array([x for x, _ in held]), np.array([t for _, t in held])
    assert np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]) > 0.85
    none = toxicity.toxicity(both.limit(5), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(both.limit(0), labels).count() == 0


def test_word_table():
    """What is told of a word in one number, and features of whole texts, against plain counts."""
    import zlib
    from collections import Counter

    def shape(w):
        for kind, by in ((rb"[a-z\x80-\xff]", b"x"), (rb"[A-Z]", b"X"), (rb"[0-9]", b"9"), (rb"(.)\1+", rb"\1\1")):
            w = re.sub(kind, by, w)
        return w[:12]

    words = "Aa bb  bb 12,345 x ## #a .;: \u00e9\u00e9\u00e9\u00e9 ABCabc123 bb bb".encode().split() + [b"q" * 200, b"#" * 70]
    own = [zlib.crc32(w) % weak_label.BUCKETS for w in words]
    shapes = [zlib.crc32(b"shape " + shape(w)) % weak_label.BUCKETS for w in words]
    count = Counter(own + shapes + [(a * 31 + b * 17 + 7) % weak_label.BUCKETS for a, b in zip(shapes, shapes[1:])])
    count[5] += sum(a == b for a, b in zip(own, own[1:]))
    at, weight = weak_label.features(told := weak_label.word_table(words))
    assert at.tolist() == sorted(k for k, v in count.items() if v)
    assert np.allclose(weight * np.sqrt(sum(v * v for v in count.values())), [count[k] for k in at.tolist()])
    assert (told >> weak_label._LENGTH).tolist() == [len(w) for w in words]
    assert [w for w, x in zip(words, told) if x & weak_label._BARE] == [b"##", b".;:", b"#" * 70]
