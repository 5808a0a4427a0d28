"""Operators with exact results, against plain versions on the small tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarisk.llm import chat_format, decontaminate, packing, quality_rules, token_file, warc
from terrarisk.llm.common import marked, remove, shared_dir, table

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three one two three one two three"), (5, "one two three one two three one two three"),
    (6, "x  y   z\n\n end \n\r\n  tab\tq 'tis it's <|endoftext|> \x00 éÉ #$%|<> "), (7, "word " * 9000), (8, "\n".join(["same line here", "same line here", "", "  ", "other"])), (9, "a\xa0b 　c"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    odd = spark.createDataFrame([(100_000 + i, t, "en", None, None, "extra") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    return table(spark, sf_dir, "documents").unionByName(odd, allowMissingColumns=True)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_rules_base(spark, docs, texts, sf_dir):
    got = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels")).collect()
    want = []
    for doc, text in texts:
        w = words(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert sorted(want) == sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def plain_scores(texts, good, buckets):
    """The mean log ratio by plain counts, a document's own left out of both multinomials."""
    raw, target = Counter(), Counter()
    grams = {}
    for doc, text in texts:
        grams[doc] = Counter(quality_rules.ngram_buckets(text.encode().split(), buckets).tolist()) if text.split() else Counter()
        raw.update(grams[doc])
        if doc in good:
            target.update(grams[doc])
    n, t, out = raw.total(), target.total(), {}
    for doc, own in grams.items():
        length, total, trusted = own.total(), 0.0, doc in good
        for b, k in own.items():
            p = (raw[b] - k + 0.5) / (n - length + 0.5 * buckets)
            q = (target[b] - k * trusted + buckets * p) / (t - length * trusted + buckets)
            total += k * math.log(q / p)
        out[doc] = total / length if length else 0.0
    return out


@pytest.mark.parametrize("table_bytes", [quality_rules.TABLE_BYTES, 0])
def test_quality_rules_score(spark, docs, texts, sf_dir, table_bytes):
    """Both ways, with the counts broadcast and with the n-grams dealt out, against plain counts."""
    labels = table(spark, sf_dir, "labels")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    want = plain_scores(texts, good, 20_000)
    got = quality_rules.quality_rules(docs, labels, buckets=20_000, chunk_bits=9, table_bytes=table_bytes).collect()
    assert len(got) == len(texts)
    assert all(abs(r.llr - want[r.doc_id]) < 1e-6 for r in got)


def test_quality_rules_codes():
    n = np.array([0, 1, 2, 32767, 32768, 32769, 10**6, 10**12])
    back = quality_rules.decoded(quality_rules.coded(n))
    assert (back[:5] == n[:5]).all() and (abs(back / np.maximum(n, 1) - 1)[5:] < 1e-3).all()


def test_quality_rules_on_a_larger_corpus(spark):
    """Buckets follow the corpus: with 2^14 of them, 0.59 of the bad documents were rejected here."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    grams = quality_rules.n_grams(docs)
    assert quality_rules.bucket_count(grams) >= grams / quality_rules.GRAMS_A_BUCKET > 1 << 14
    assert quality_rules.bucket_count(64 * grams) >= 63 * quality_rules.bucket_count(grams)
    rows = quality_rules.quality_rules(docs.select("doc_id", "text"), labels).filter("n_words >= 50").join(labels, "doc_id").select("llr", "quality").collect()
    low = lambda q: np.mean([r.llr < quality_rules.THRESHOLD for r in rows if r.quality == q])
    print(grams, quality_rules.bucket_count(grams), low(0), low(1), np.median([r.llr for r in rows if r.quality == 1]))
    assert low(0) > 0.9 and low(1) < 0.01


def test_quality_rules_without_rows(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert {r.llr for r in quality_rules.quality_rules(docs, labels.limit(0)).select("llr").distinct().collect()} == {0.0}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute_decontaminate(texts, items):
    out = []
    for doc, text in texts:
        w, hit, found = item_words(text), set(), []
        for item, body in items:
            v = item_words(body or "")
            if not v:
                continue
            n = min(10, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins]
            if at:
                found.append(str(item))
                hit.update(i + k for i in at for k in range(n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontaminate(spark, docs, texts, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()] + [(900, "one two three"), (901, None), (902, "!!"), (903, "Thing"), (904, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert sorted(tuple(r) for r in got) == brute_decontaminate(texts, items)
    assert any(r.contaminated for r in got)
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_decontaminate_repeated_items_and_rounds(spark, docs, texts):
    """Rows of one item_id are one item, null ones count but aren't named, and rounds of any size find the same."""
    bench = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (7, "word word"), (8, "one two"), (None, "one two"), (9, "same line here")], "item_id int, text string")
    hashes = {1: hashlib.sha256(b"7,8").hexdigest()}
    one = sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()), key=str)
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench, round_bytes=1).collect()), key=str) == one
    five = [r for r in one if r[0] == 100_005]
    assert len(five) == 2 and all(r[1:] == (9, 9, 3, hashes[1], True) for r in five)


def test_decontaminate_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (None, "x a b c", 2), (None, "q", 3), (1, "a b c", 4), (1, "q", 5), (1, "q", 5)], "doc_id int, text string, items long")
    bench = spark.createDataFrame([("i", "A b")], "item_id string, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == [("1", 1, 0), ("1", 1, 0), ("1", 3, 2), ("None", 1, 0), ("None", 3, 2), ("None", 4, 2)]


def test_decontaminate_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "d c b a"), (None, "q a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    exact = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()}
    near = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, bench, slop=1).collect()}
    assert exact == {1: False, 2: True, 3: False, None: True}
    assert near == {1: True, 2: True, 3: False, None: True}


def test_one_index_answers_any_benchmark(spark, docs, texts):
    """The index holds every term with its positions, knows no benchmark, and stays for further ones."""
    path = f"{shared_dir(spark)}/index"
    decontaminate.build_index(marked(docs), path)
    index = spark.read.parquet(path)
    words = [w for _, t in texts for w in decontaminate.words_of((t or "").encode())]
    held = {bytes(r.term): r.n for r in index.filter(F.length("term") > 0).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert held == dict(Counter(words))
    assert index.filter(F.length("term") > 0).filter("n * 4 <> length(postings)").count() == 0
    long = max(texts, key=lambda t: len(t[1] or ""))[1]
    for items in ([(1, " ".join(long.split()[:30]))], [(2, "word word"), (3, "no such words anywhere qqqq")], [(4, long)]):
        got = decontaminate.find_indexed(index, spark.createDataFrame(items, "item_id long, text string")).drop("ident", "twin").collect()
        assert sorted(map(tuple, got)) == brute_decontaminate(texts, items)
    remove(spark, path)


def test_index_of_many_segments(spark, docs, texts):
    """Segments of any size give the same; a document longer than a segment is one by itself."""
    path = f"{shared_dir(spark)}/index"
    decontaminate.build_index(marked(docs), path, segment_words=2000)
    index = spark.read.parquet(path)
    assert index.select("segment").distinct().count() > 8
    items = [(1, "one two three"), (2, " ".join(max(texts, key=lambda t: len(t[1] or ""))[1].split()[5:40]))]
    got = decontaminate.find_indexed(index, spark.createDataFrame(items, "item_id long, text string")).drop("ident", "twin").collect()
    assert sorted(map(tuple, got)) == brute_decontaminate(texts, items)
    remove(spark, path)


@pytest.fixture(scope="module")
def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [(doc, np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")) for doc, text in texts]


def test_token_file(spark, docs, encoded):
    for shard_ids in (token_file.SHARD_IDS, 5000):
        got = token_file.token_files(docs, shard_ids=shard_ids).orderBy("start").collect()
        want, start = [], 0
        for doc, ids in sorted(encoded, key=lambda x: x[0]):
            want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert [tuple(r) for r in got] == want
    assert token_file.token_files(docs.limit(0)).count() == 0


def test_token_file_without_ids(spark, docs, encoded):
    """Documents without an id come first, in shards of their own; shards end by documents too."""
    none = spark.createDataFrame([(None, "word one"), (None, None), (None, "a")], "doc_id long, text string")
    got = token_file.read_tokens(token_file.write_tokens(docs.select("doc_id", "text").unionByName(none), path := shared_dir(spark), shard_docs=50), path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 3 + sorted(d for d, _ in encoded)
    assert got[0].n_tokens == 1 and got[3].start == sum(r.n_tokens for r in got[:3])
    want = sorted((d, zlib.crc32(ids.tobytes())) for d, ids in encoded)
    assert sorted((r.doc_id, r.ids_crc32) for r in got[3:]) == want


def test_token_file_random_access(spark, docs, encoded):
    from pyarrow import fs

    path = shared_dir(spark)
    manifest = token_file.write_tokens(docs, path, shard_ids=20_000).orderBy("shard").collect()
    by_doc = sorted(encoded, key=lambda x: x[0])
    files, folder = fs.FileSystem.from_uri(path)
    at = 0
    for row in manifest:
        shard = token_file.Shard(files.open_input_file(f"{folder}/{row.file}"))
        for i in range(0, shard.n, 7):
            assert shard.doc_ids.select(i) + shard.first_id == by_doc[at + i][0]
            assert (shard.tokens(i) == by_doc[at + i][1]).all()
        at += shard.n
    assert at == len(by_doc)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (3000, 10**9), (257, 256), (20_000, 7), (9000, 10**12)):
        v = np.sort(rng.integers(0, top, n))
        e = token_file.EliasFano.from_bytes(token_file.EliasFano.encode(v).to_bytes())
        assert (e.decode() == v).all()
        assert [e.select(i) for i in range(0, n, 3)] == v[::3].tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, n), (max(0, n - 1), n)):
            assert (e.values(a, b) == v[a:b]).all()
        assert len(e.to_bytes()) <= 64 + n * (2 + math.log2(max(2, top / max(n, 1)))) / 8 + n / 32 + n / 8


def test_packing(spark, docs, encoded):
    for block in (packing.BLOCK_ITEMS, 40):
        got = packing.pack(docs, block_items=block).collect()
        want = []
        for doc, ids in encoded:
            begin, size = 0, len(ids) % 2048 or 2048
            for piece in range(-(-len(ids) // 2048)):
                want.append((doc, piece, begin, size, zlib.crc32(ids[begin : begin + size].tobytes())))
                begin, size = begin + size, 2048
        assert sorted(tuple(r)[:5] for r in got) == sorted(want)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for rows in bins.values():
            at = 0
            for offset, length in sorted(rows):
                assert offset == at
                at += length
            assert at <= 2048
        sizes = np.array([r.length for r in got])
        assert len(bins) <= packing.lower_bound(sizes, 2048) * 1.02 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_genetic_steps():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 120)
    a, b = (packing.Bins(sizes, 100) for _ in range(2))
    a.best_fit(rng.permutation(120).tolist())
    b.best_fit(rng.permutation(120).tolist())
    for child in (packing.crossover(a, b, rng), packing.crossover(b, a, rng)):
        packing.mutate(child, rng)
        assert sorted(i for x in child.items.values() for i in x) == list(range(120))
        assert all(sizes[x].sum() == 100 - child.free[k] for k, x in child.items.items())
        assert min(child.free.values()) >= 0
    best = packing.evolve(sizes, [], 100, 1, generations=30)
    assert best.max() + 1 <= len(a.items)


def test_crossover_improves_on_best_fit():
    """Triples that fill a bin exactly, which best-fit decreasing doesn't find."""
    rng = np.random.default_rng(0)
    triples = []
    for _ in range(20):
        a = rng.integers(26, 45)
        b = rng.integers(26, min(70, 100 - a - 20))
        triples += [a, b, 100 - a - b]
    sizes = np.array(triples)
    best_fit = packing.Bins(sizes, 100)
    best_fit.best_fit(np.argsort(-sizes, kind="stable").tolist())
    found = packing.evolve(sizes, [], 100, 5, generations=25, population=8)
    assert np.bincount(found, sizes).max() <= 100
    assert packing.lower_bound(sizes, 100) == 20 <= found.max() + 1 < len(best_fit.items)


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,0)", "string"])
def test_chat_conversation_ids_and_ties(spark, kind):
    """Ids of other types; turns of one number and role go by text."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", None), (1, 1, "assistant", "x"), (2, 0, "assistant", ""), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id", chat_format.F.col("conv_id").cast(kind))
    got = chat_format.chat_format(df)
    assert got.schema["conv_id"].dataType.simpleString() == kind
    said = {str(r.conv_id): r.turns_sha256 for r in got.collect()}
    assert said["1"] == hashlib.sha256(b"user\n\nuser\na\nuser\nb\nassistant\nx\n").hexdigest() and set(said) == {"1", "2", "None"}
    placed = chat_format.placed(chat_format.format_turns(df)).filter("conv_id is not null").orderBy("conv_id", "first").collect()
    assert [r.first for r in placed][0] == 0 and [r.text for r in placed] == [None, "a", "b", "x", ""]
    assert all(b.first == a.first + len(a.ids) for a, b in zip(placed, placed[1:]) if a.conv_id == b.conv_id)


def test_chat_format(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    probe = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe), (-2, 0, "assistant", None), (-2, 1, None, "  <\\|x <\\\\| <| |> \n\n "), (-2, 1, "assistant", "tie"), (-3, None, "a\nb\\n", "z"), (None, 0, "assistant", "é <|"), (None, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", chat_format.F.lit(1))
    got = {r.conv_id: r for r in chat_format.chat_format(df).collect()}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (-1 if r[1] is None else r[1], r[2] is not None, r[2] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars >= len(said)
    for t in ("<|", "<\\|", "a<<||", "", "<\\\\|im_end|>"):
        assert "<|" not in chat_format.escape(t) and chat_format.unescape(chat_format.escape(t)) == t


def test_warc(spark, sf_dir):
    marker = "x" * 120 + "WARC/1.1\r\nWARC-Type: response\r\nWARC-Segment-Number: 4\r\n\r\nzz WARC/1.1\r\n"
    extra = [(-1, "http://a b\r\nc", None), (-2, None, ""), (-3, "u", marker), (-4, "u", marker), (-5, "u", "é" * 90_000), (-6, "v", "é" * 90_000), (-7, "w", "short"), (-8, "w", "short"), (-9, "x", "y" * 100), (-9, "x", "y" * 100), (None, "n", "y" * 100)]
    pages = table(spark, sf_dir, "pages").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string")).withColumn("digest", warc.F.lit(1))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for p, h in rows:
        if p is not None and len(h) >= 100:
            first[h] = min(first.get(h, p), p)
    want = sorted((str(p), len(h), hashlib.sha256(h).hexdigest(), *(("response", None) if h not in first or first[h] == p else ("revisit", first[h]))) for p, h in rows)
    for size in (warc.SEGMENT_BYTES, 700):
        got = warc.warc_round_trip(pages, size).collect()
        assert all(r.complete for r in got)
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_damage(spark):
    body = warc.chunked(b"abc" * 50, 7)
    assert warc.dechunked(body) == b"abc" * 50
    assert warc.dechunked(body[:40]) is None and warc.dechunked(b"zz\r\n") is None
    path = shared_dir(spark)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Segment-Number", 1)]
    block = warc._HTTP + body
    parts = [warc.record(head, block[:90]), warc.record([("WARC-Type", "continuation"), ("WARC-Record-ID", "<b>"), ("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", len(block) + 1)], block[90:])]
    spark.createDataFrame([(p.decode(),) for p in parts], "value string").write.option("lineSep", "\r\n").text(path)
    row = warc.read_warc(spark, path, with_payload=True).collect()[0]
    assert not row.complete and row.payload is None


def test_quality_rules_with_clashing_columns(spark, sf_dir):
    """Extra columns under the names of the operator's own and of its results."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    names = ["_trusted", "_id", "_bucket", "_key", "_llr", "_own0", "key", "trusted", "a.b", "chunk"]
    more = docs.select("doc_id", *[quality_rules.F.lit(i).alias(n) for i, n in enumerate(names)], "text", quality_rules.F.lit("x").alias("kept"))
    got = quality_rules.quality_rules(more, labels)
    assert got.columns == ["doc_id", *names, "text", *quality_rules._NEW]
    rows = got.collect()
    assert all(list(r[1 : len(names) + 1]) == list(range(len(names))) for r in rows)
    assert {(r.doc_id, r.llr, r.kept) for r in rows} == {(r.doc_id, r.llr, r.kept) for r in quality_rules.quality_rules(docs, labels).collect()}
    for switch in (0, 1 << 30):  # by a shuffle and by a broadcast
        assert {r.kept for r in quality_rules.quality_rules(more, labels, table_bytes=switch).select("kept").collect()} <= {True, False}


def test_warc_null_ids_and_urls(spark):
    """Results depend on a row's own payload and the ids that have it, not on how many rows there are."""
    big = "y" * 80_003
    rows = [(1, "http://a", big), (None, None, big), (5, None, "z" * 200), (None, "http://n", "w" * 300), (None, "http://n", "w" * 300), (7, "http://b", "z" * 200), (7, "http://b", "q" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first", "3 AS refers_to", "4 AS n")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.url) for r in warc.warc_round_trip(pages, 9000).collect()), key=str)
    want = [(1, 80003, "response", None, "http://a"), (0, 80003, "revisit", 1, None), (5, 200, "response", None, None), *[(0, 300, "response", None, "http://n")] * 2, (7, 200, "revisit", 5, "http://b"), (7, 70000, "response", None, "http://b")]
    assert got == sorted(want, key=str)


def test_bins_keep_their_free_space():
    """Crossover takes bins over with the free space that they had; every item stays in one bin."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(300, 1100, 500)
    people = []
    for _ in range(2):
        people.append(packing.Bins(sizes, 2048))
        people[-1].best_fit(rng.permutation(500).tolist())
    child = packing.crossover(*people, rng)
    packing.mutate(child, rng)
    child.add_bin([], 2048)
    assert sorted(i for items in child.items.values() for i in items) == list(range(500))
    assert all(child.free[b] == 2048 - sizes[items].sum() for b, items in child.items.items() if items)
