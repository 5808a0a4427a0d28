"""The pipeline's stages against plain versions on the small table."""

from test_exact import brute_decontaminate

import corpus_pipeline
from terrarisk.llm import quality_rules, weak_label
from terrarisk.llm.common import table, written


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.unionByName(docs.limit(3)).cache()
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), "stage")
        assert out.columns == columns
        seen.append((docs, out))
        docs = out
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    rules = quality_rules.quality_rules(seen[0][0], table(spark, sf_dir, "labels"))
    assert ids(seen[0][1]) == ids(rules.filter("kept"))
    assert ids(seen[1][1]) == ids(weak_label.weak_label_classifier(seen[1][0]).filter("kept"))
    assert ids(seen[2][1]) == brute_near([(r.doc_id, r.text) for r in seen[2][0].collect()])
    rows = [(r.doc_id, r.text) for r in seen[3][0].collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert ids(seen[3][1]) == sorted(d for d, _, hit, *_ in brute_decontaminate(rows, items) if not hit)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(docs)


def brute_near(rows):
    """One id of each group at 5 words and 0.8."""
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted(low.values())


def test_near_duplicates_at_five_words(spark, sf_dir):
    words = [f"w{i}" for i in range(200)]
    edited = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(words))
    # four edits in 200 words: 0.815 on five words, 0.849 on four; five edits: 0.774 on five words
    rows = [(1, edited()), (2, edited(20, 60, 100, 140)), (3, " ".join(f"x{i}" for i in range(90))), (4, None), (5, "a b c d"), (6, "A b c d"), (7, "a b c e")]
    far = [(8, edited(10, 50, 90, 130, 170).replace("w", "v")), (9, edited().replace("w", "v"))]
    docs = spark.createDataFrame(rows + far, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()) == brute_near(rows + far) == [1, 3, 4, 5, 7, 8, 9]
    small = table(spark, sf_dir, "documents").select("doc_id", "text")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, small, sf_dir).collect()) == brute_near([tuple(r) for r in small.collect()])


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_rows_are_judged_one_by_one(spark, sf_dir):
    """Null ids, two texts under one id, and columns called as the operators' own."""
    good = [r.text for r in table(spark, sf_dir, "documents").collect() if r.text and len(r.text.split()) > 120][:6]
    item = table(spark, sf_dir, "benchmark").filter("length(text) > 80").first().text
    rows = [(None, good[0], "x"), (None, good[1], "y"), (1, good[2], "z"), (1, good[3], "z"), (1, good[3], "z"), (None, good[4] + " " + item, "c"), (2, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("hit_id", quality_rules.F.lit(3)).withColumn("kept", quality_rules.F.lit("own"))
    near = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert near.columns == docs.columns
    assert sorted(r.text or "" for r in near.collect()) == sorted({r[1] or "" for r in rows})
    clean = corpus_pipeline.without_benchmark(spark, near, sf_dir).collect()
    assert sorted(r.text or "" for r in clean) == sorted({r[1] or "" for r in rows if r[2] != "c"})
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.keep_classified):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema["score"].dataType.simpleString() == "string"
        assert {r.kept for r in out.collect()} <= {"own"}
