"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Eight heuristic labellers vote good (2), bad (0) or abstain (1) on every document. The vote patterns are counted over
all documents (at most 3**8 rows), and expectation-maximisation on them estimates each labeller's vote distribution
given the hidden class, and so a posterior for every pattern. A hashed linear scorer is fitted to the posteriors of a
bounded sample of documents (`max_train`), and every document is scored and kept if its score reaches `threshold`.

Defined results: null and empty texts get no votes but abstentions, score 0 and are not kept; repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, column_bytes, give_back, map_batches, text_batches, with_columns, written

BAD, ABSTAIN, GOOD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "repeats", "lines", "word_length", "sentences", "short_words", "bare_marks")
BUCKETS = 1 << 13
MAX_TRAIN = 6000
THRESHOLD = 0.5
_SYMBOLS, _UPPER, _LOWER, _ENDS = b"#*$%&|<>{}[]=\\^~_@", bytes(range(65, 91)), bytes(range(97, 123)), b".?!"
_HIGH = bytes(range(0x80, 0x100))


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(text: bytes, words: list[bytes], told: np.ndarray) -> tuple[int, ...]:
    """The labellers' votes, in the order of LABELLERS; told is what word_table says of the words."""
    n = len(words)
    if not n:
        return (ABSTAIN,) * len(LABELLERS)
    size = len(text)
    count = lambda chars: size - len(text.translate(None, chars))
    symbols, upper, lower, ends = count(_SYMBOLS) / n, count(_UPPER), count(_LOWER + _HIGH), count(_ENDS) / n
    distinct = len(set(words)) / n
    runs = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    length = told >> _LENGTH
    mean = int(length.sum()) / n
    short = int(np.count_nonzero(length <= 4)) / n
    bare = int(np.count_nonzero(told & _BARE)) / n
    return (
        _vote(symbols > 0.15, symbols < 0.02),
        _vote(upper > 0.4 * (upper + lower), upper < 0.15 * (upper + lower)),
        _vote(runs > 0.1 or (n >= 50 and distinct < 0.15), runs < 0.02),
        _vote(len(lines) >= 3 and again > 0.4, again < 0.1),
        _vote(mean < 2 or mean > 14, 3 <= mean <= 9),
        _vote(ends > 0.6 or (n >= 60 and ends == 0), 0.02 <= ends <= 0.34),
        _vote(n >= 30 and short < 0.08, short > 0.25),
        _vote(bare > 0.15, bare < 0.01),
    )


def pattern(v: tuple[int, ...]) -> int:
    """Votes as one number, in base 3."""
    out = 0
    for x in v:
        out = 3 * out + x
    return out


def fit_labellers(counts: dict[int, int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted patterns: P(vote | class) as [labeller, class, vote], and P(good | pattern) of all patterns."""
    m = len(LABELLERS)
    all_votes = np.array([[p // 3 ** (m - 1 - j) % 3 for j in range(m)] for p in range(3**m)])
    n = np.zeros(3**m)
    for p, k in counts.items():
        n[p] = k
    given = np.empty((m, 2, 3))
    # a bad document fails in few ways; a good one hardly ever gets a bad vote
    given[:, 0], given[:, 1] = (0.3, 0.2, 0.5), (0.003, 0.2, 0.797)
    prior = 0.85
    for _ in range(rounds):
        log = np.stack([np.log(given[np.arange(m), c, all_votes]).sum(1) for c in (0, 1)], 1) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if not n.sum():
            break
        prior = float(np.clip((n * post).sum() / n.sum(), 0.5, 0.995))
        for j in range(m):
            for v in range(3):
                at = all_votes[:, j] == v
                given[j, 0, v], given[j, 1, v] = (n * (1 - post))[at].sum() + 0.5, (n * post)[at].sum() + 0.5
            given[j] /= given[j].sum(1, keepdims=True)
    return given, post


#: Kinds of letters: capitals, other letters, digits; marks stand for themselves.
_KINDS = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_AGAIN = re.compile(rb"(.)\1+")
_shapes = Cache(lambda kinds: zlib.crc32(b"shape " + _AGAIN.sub(rb"\1\1", kinds)[:12]) % BUCKETS << _BITS, __name__)


#: A word as one number: its bucket, its shape's bucket, whether it is bare marks, and its length in bytes.
_BITS = BUCKETS.bit_length() - 1
_BARE, _LENGTH = 1 << 2 * _BITS, 2 * _BITS + 1


def _told(word: bytes) -> int:
    bare = not word.translate(None, _SYMBOLS + b".,;:-!?'\"()/+")
    return zlib.crc32(word) % BUCKETS | _shapes[word.translate(_KINDS)] | bare * _BARE | len(word) << _LENGTH


_words = Cache(_told, __name__)


def word_table(words: list[bytes]) -> np.ndarray:
    """The number of each word."""
    _words.ready()
    _shapes.ready()
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words))


def features(told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word shapes, shape pairs and repeats, as (buckets, weights); the weights have length 1."""
    own, shape = told & BUCKETS - 1, told >> _BITS & BUCKETS - 1
    count = np.bincount(own, minlength=BUCKETS) + np.bincount(shape, minlength=BUCKETS)
    count += np.bincount((shape[:-1] * 31 + shape[1:] * 17 + 7) % BUCKETS, minlength=BUCKETS)
    count[5] += np.count_nonzero(own[:-1] == own[1:])
    at = np.flatnonzero(count)
    k = count[at]
    weight = k / np.sqrt((k.astype(float) ** 2).sum()) if len(k) else k.astype(float)
    return at, weight


def fit_scorer(rows: list[tuple[bytes, bytes, float]], passes: int = 12, rate: float = 2.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on posteriors, by AdaGrad over rows (buckets and weights in bytes, posterior) in a seeded order; the last weight is the bias."""
    w, g = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x, y = np.frombuffer(rows[i][0], "<u2").astype(np.int64), np.frombuffer(rows[i][1], "<f4").astype(float), rows[i][2]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))
            d = (p - y) * x + decay * w[at]
            g[at] += d * d
            w[at] -= 0.1 * rate * d / np.sqrt(g[at])
            g[-1] += (p - y) ** 2
            w[-1] -= 0.1 * rate * (p - y) / np.sqrt(g[-1])
    return w


def weak_label_classifier(docs: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """docs with vote_pattern, posterior, score and kept."""
    text_batches(docs.sparkSession)
    share = max_train / max(docs.count(), 1)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            rows = []
            for text in column_bytes(batch, "text"):
                told = word_table(words := text.split())
                p = pattern(votes(text, words, told))
                counts[p] += 1
                if words and zlib.crc32(text) < share * 2**32:  # the sample is drawn by content, alike at every partitioning
                    at, x = features(told)
                    rows.append((p, zlib.crc32(text), at.astype("<u2").tobytes(), x.astype("<f4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["pattern", "n", "at", "x"])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.nulls(len(counts), pa.binary()), pa.nulls(len(counts), pa.binary())], names=["pattern", "n", "at", "x"])

    voted = written(docs.select("text").mapInArrow(vote, "pattern long, n long, at binary, x binary"), "votes")
    counts = {r[0]: r[1] for r in voted.filter("at is null").groupBy("pattern").agg(F.sum("n")).collect()}  # at most 3**8 rows
    given, post = fit_labellers(counts)
    # copies are taken once, and the smallest hashes, so that the sample is bounded whatever the corpus repeats
    sample = voted.filter("at is not null").groupBy("n").agg(F.min_by(F.struct("pattern", "at", "x"), "pattern").alias("r")).orderBy("n").limit(max_train).select("r.*").collect()
    # in bytes to the driver and decoded row by row: as lists of numbers the sample takes ten times the memory there
    weights = fit_scorer([(r.at, r.x, post[r.pattern]) for r in sample])
    del sample
    give_back()

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        patterns, scores = [], []
        for text in column_bytes(batch, "text"):
            told = word_table(words := text.split())
            patterns.append(pattern(votes(text, words, told)))
            at, x = features(told)
            scores.append(1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -30, 30))) if words else 0.0)
        score = np.array(scores, float)
        return with_columns(batch, {"vote_pattern": pa.array(patterns, pa.int64()), "posterior": pa.array(post[patterns]), "score": pa.array(score), "kept": pa.array(score >= threshold)})

    new = "vote_pattern long, posterior double, score double, kept boolean"
    names = {x.split()[0] for x in new.split(", ")}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names), new])
    return map_batches(docs, judge, schema)
