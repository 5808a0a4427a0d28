"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary labelled text; the other holds the same content and what zstandard's trainer
finds in toxic text. A window of a text is compressed with both, between a lead-in and a tail that both hold, so that
block headers are paid and matches are allowed up to the window's end. The bytes that the toxic dictionary saves,
counted at thresholds calibrated on labelled text, give the score of a document.

The trainer is shown the windows of toxic text that are several times as common there as in ordinary text, counting a
word once for each pair of neighbours, so that copies of a document count once. Labels are read only from the training
folds, from a bounded sample (`max_docs` a class, texts of at most `max_chars`); every document is scored on its whole
text. A worker keeps the savings of a bounded number of windows.

Defined results: null and empty texts have one score, that of a text without savings; without labels of both classes
every score is 0; repeated rows get equal scores; a null doc_id is no label's, so its row is held out; of several texts under a labelled doc_id one is learnt from, and a document labelled both ways is
toxic; columns called as the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, LOWER, column_bytes, map_batches, text_batches, with_columns

FOLDS = 5
MAX_DOCS = 2500
MAX_CHARS = 50_000
ORDINARY_BYTES, TOXIC_BYTES = 16384, 2048
MORE_COMMON = 8
BEYOND_CHANCE = 12.0
THRESHOLDS = (2, 3, 4, 5, 6)
_ENDS = b".,;:!?\"'()|"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias

    def digest(self) -> bytes:
        """Of the dictionaries: a worker that is used again knows by it whether it holds those of this model."""
        if not hasattr(self, "_digest"):
            self._digest = hashlib.sha256(len(self.ordinary).to_bytes(8, "big") + self.ordinary + self.toxic).digest()
        return self._digest


def windows(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _contexts(texts: list[bytes]) -> dict[bytes, int]:
    """For each word, the number of different pairs of neighbours."""
    found = defaultdict(set)
    for text in texts:
        w = windows(text)
        for a, b, c in zip([b"", *w], w, [*w[1:], b""]):
            found[b.strip(_ENDS)].add(zlib.crc32(a + b"\n" + c))
    return {w: len(s) for w, s in found.items()}


def _train(size: int, samples: list[bytes], **how) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(dict.fromkeys(samples))[:size]


def train_dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """The contents of both dictionaries, without the lead-in."""
    base = _train(ORDINARY_BYTES, [t.translate(LOWER) for t in ordinary if len(t) > 8], k=128, d=8, f=18, accel=4)
    there, here = _contexts(ordinary), _contexts(toxic)
    rate = sum(here.values()) / max(1, sum(there.values()))
    expected = {w: rate * (there.get(w, 0) + 1) for w in here}
    # far beyond chance (the tail of a Poisson count, as a logarithm), and several times as common
    marked = {w for w, k in here.items() if len(w) >= 3 and k >= MORE_COMMON * expected[w] and k * np.log(k / expected[w]) - k + expected[w] >= BEYOND_CHANCE}
    samples = [b"".join(b" %b " % w for w in windows(t) if w.strip(_ENDS) in marked) for t in toxic]
    return base, base + _train(TOXIC_BYTES, [s for s in samples if len(s) > 8], k=20, d=6, f=16)


class Savings(Cache):
    """window -> bytes that the toxic dictionary saves."""

    def __init__(self, model: Model):
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(
            5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
            strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=14, chain_log=14, search_log=5,
        )
        lead = (model.ordinary[-48:] or b" ").rjust(48)
        tail = lead[:12]

        def compressor(content: bytes):
            held = zstandard.ZstdCompressionDict(content + lead, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress

        plain, toxic = compressor(model.ordinary), compressor(model.toxic)

        def saved(window: bytes) -> int:
            text = lead + b" %b " % window + tail
            return len(plain(text)) - len(toxic(text))

        super().__init__(saved, __name__)


def features(text: bytes, savings: Savings) -> np.ndarray:
    """Largest savings, and windows at each threshold as logarithms."""
    savings.ready()
    w = windows(text)
    d = np.sort(np.fromiter(map(savings.__getitem__, w), np.int64, len(w)))[::-1] if w else np.zeros(1, np.int64)
    at = np.searchsorted(-d, [-t for t in THRESHOLDS], "right")
    return np.array([min(d[0], 10), np.clip(d[:3], 0, 10).sum(), *np.log1p(at)])


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model | None:
    # a document that is labelled both ways counts as toxic
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(max_docs).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(max_docs))
    # at most 2 * max_docs rows, so that this side has a bounded size; of texts under one doc_id the first one by hash
    met = docs.select("doc_id", "text").filter(F.length("text").between(1, max_chars)).join(F.broadcast(chosen), "doc_id")
    rows = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id").collect()
    by = {y: [r.text.encode() for r in rows if r.toxic == y] for y in (0, 1)}
    if len(by[0]) < 2 or len(by[1]) < 2:
        return None
    model = Model(*train_dictionaries(by[0], by[1]), np.zeros(0), np.zeros(0), np.zeros(0))
    savings = Savings(model)
    x = np.array([features(t, savings) for y in (0, 1) for t in by[y]])
    y = np.repeat([0.0, 1.0], [len(by[0]), len(by[1])])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton's steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.5 * np.append(w[:-1], 0)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), grad)
    model.weights = w
    return model


_ready: dict[bytes, Savings] = {}


def score(text: bytes, model: Model) -> float:
    key = model.digest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = Savings(model)
    z = (features(text, _ready[key]) - model.mean) / model.scale
    return float(1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30))))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs with held_out, score and predicted."""
    text_batches(docs.sparkSession)
    model = fit(docs, labels, folds, max_docs, max_chars)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([score(t, model) if model else 0.0 for t in column_bytes(batch, "text")], float)
        held = [i is None or zlib.crc32(str(i).encode()) % folds == 0 for i in batch.column("doc_id").to_pylist()]
        return with_columns(batch, {"held_out": pa.array(held, pa.bool_()), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    new = "held_out boolean, score double, predicted int"
    names = {x.split()[0] for x in new.split(", ")}
    return map_batches(docs, judge, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names), new]))
