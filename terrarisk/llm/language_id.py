"""Language identification with hyperdimensional profiles.

Every letter has a random vector of D signs, drawn from its code point by a hash. A trigram of letters within a word
(word ends count as a letter) is bound into one vector: its letters' vectors, rotated by their place, multiplied
component by component. A document is the bundle (sum) of its trigrams' vectors, a language the bundle of its learnt
documents, and a document gets the language whose prototype has the largest cosine with it.

Sums are of whole numbers: each task bundles its documents by language and Spark adds the tasks' bundles, so the
prototypes don't depend on the partitions. Languages beyond what fits a task are not foreseen: a prototype has D numbers.

Defined results: a null text, and one without a letter, get `und` and score 0, and so does every text if nothing was
learnt; equal cosines go to the language that sorts first; a null doc_id is held out; the lang column is read for learning
only; repeated rows are equal; extra columns, whatever they are called, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, column_bytes, mixed, text_batches

DIMENSIONS = 1024
#: Trigrams that are bound at once, and characters of a text that are numbered at once.
BOUND, PIECE = 4096, 1 << 20
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
_CODE = np.int64(1) << np.int64(21)  # above every code point


def letter_signs(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """0/1 vectors of code points (0: a word's end), a row each."""
    words = letters.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dimensions // 64, dtype=np.uint64)[None, :]
    return np.unpackbits(mixed(words + np.uint64(0x9E3779B97F4A7C15)).view(np.uint8), axis=1)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    kinds, place = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() if c < 0xD800 or 0xDFFF < c <= 0x10FFFF else False for c in kinds.tolist()], bool)[place]


_BASIC = np.array([chr(c).isalpha() for c in range(0x3000)])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams around the letters of a text, as numbers, and how often each occurs."""
    text, held = text.lower(), []
    for at in range(0, len(text), PIECE):
        before = text[at - 1] if at else " "
        codes = np.frombuffer((before + text[at : at + PIECE + 1]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        if at + PIECE >= len(text):
            codes = np.append(codes, 0)
        letter = _BASIC[codes] if codes.max() < len(_BASIC) else _is_letter(codes)
        codes = np.where(letter, codes, 0)
        held.append(np.unique(((codes[:-2] * _CODE + codes[1:-1]) * _CODE + codes[2:])[letter[1:-1]], return_counts=True))
    return held[0] if len(held) == 1 else _together(held)


def bundle(grams: np.ndarray, counts: np.ndarray, dimensions: int) -> np.ndarray:
    """The sum of the trigrams' vectors, times their counts."""
    total = np.zeros(dimensions)
    for at in range(0, len(grams), BOUND):
        g, n = grams[at : at + BOUND], counts[at : at + BOUND]
        parts = [g // (_CODE * _CODE), g // _CODE % _CODE, g % _CODE]
        letters = np.unique(np.concatenate(parts))
        signs = letter_signs(letters, dimensions)
        bits = np.zeros((len(g), dimensions), np.uint8)
        for turn, p in zip((2, 1, 0), parts):
            bits ^= np.roll(signs, turn, axis=1)[np.searchsorted(letters, p)]
        total += n.sum() - 2.0 * (n.astype(np.float32) @ bits.astype(np.float32) if n.sum() < 1 << 24 else n.astype(float) @ bits.astype(float))
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def merged(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of several texts together."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        held.append(trigrams(text))
        if sum(len(g) for g, _ in held) > 1 << 18:
            grams, counts = _together([(grams, counts), *held])
            held = []
    return _together([(grams, counts), *held])


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in held)]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, place, np.concatenate([np.zeros(0, np.int64), *(n for _, n in held)]))
    return grams, counts


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """docs (lang, text): the languages, sorted, and their bundles, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        Cache.only("language")
        for batch in batches:
            texts, by_lang = column_bytes(batch, "text"), {}
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                got = bundle(*merged(texts[i].decode("utf-8", "replace") for i in rows), dimensions)
                total[lang] = total.get(lang, 0) + got
        if total:
            names = sorted(total)
            k = np.tile(np.arange(dimensions, dtype=np.int32), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, dimensions).tolist(), pa.string()), pa.array(k), pa.array(np.concatenate([total[x] for x in names]).astype(np.int64))], names=["lang", "k", "v"])

    added = docs.mapInArrow(run, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v")).toArrow()
    langs = sorted(set(added.column("lang").to_pylist()))
    out = np.zeros((len(langs), dimensions))
    at = {x: i for i, x in enumerate(langs)}
    out[[at[x] for x in added.column("lang").to_pylist()], added.column("k").to_numpy()] = added.column("v").to_numpy()
    return langs, out


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine with the language's prototype, 0 if negative)."""
    spark = docs.sparkSession
    text_batches(spark)
    taken = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    langs, proto = prototypes(taken.filter("not held_out and lang is not null and text is not null").select("lang", "text"), dimensions)
    size = np.linalg.norm(proto, axis=1)
    unit = proto / np.where(size > 0, size, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Cache.only("language")
        for batch in batches:
            lang, score = [], []
            for text in column_bytes(batch, "text"):
                grams, counts = trigrams(text.decode("utf-8", "replace"))
                if not len(grams) or not langs:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                v = bundle(grams, counts, dimensions)
                cosine = unit @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cosine))
                lang.append(langs[best])
                score.append(float(min(max(cosine[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return taken.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
