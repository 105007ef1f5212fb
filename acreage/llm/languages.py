"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has ROWS rows of 64 bits, bit l standing for language l; every WIDTH languages have such a plane of
rows. An n-gram is looked up at the same HASHES rows of each plane; the AND of these rows names all languages of the plane whose
filter holds it. A text's languages are scored by the popcount of their bit over the text's n-grams, corrected for the false
positives that the fill of that language's slice predicts.

A language's filter holds the n-grams whose relative frequency in it is at least SHARE of the sum over languages. Frequencies
are counted on a bounded sample: about SAMPLE training documents of each language, drawn by a digest of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.llm import pretokens as T
from acreage.llm import text as X
from acreage.session import cut

ROWS, HASHES = 1 << 18, 3
#: Training documents of a language at most (expected number of the draw).
SAMPLE = 5_000
SHARE, LEAST = 0.4, 3
#: Languages of a plane.
WIDTH = 63
CHARS = 1 << 19


def gram_keys(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: (first row, row after the last, keys of letter 3-grams over word bounds, row of each key)."""
    first = 0
    while first < len(texts):
        last, size, parts = first, 0, []
        while last < len(texts) and (last == first or size < CHARS):
            parts.append((texts[last] or "").lower() + "\n")
            size += len(parts[-1])
            last += 1
        points = T.code_points("".join(parts))
        letter = T.classes()[points] == T.LETTER
        signs = np.where(letter, points, 32).astype(np.uint64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        row = np.repeat(np.arange(last - first), [len(p) for p in parts])[keep]
        signs = signs[keep]
        same = row[:-2] == row[2:] if len(row) > 2 else np.zeros(0, bool)
        keys = (signs[:-2] << np.uint64(42)) | (signs[1:-1] << np.uint64(21)) | signs[2:] if len(row) > 2 else np.zeros(0, np.uint64)
        yield first, last, keys[same], row[:-2][same] if len(row) > 2 else row[:0]
        first = last


def places(keys: np.ndarray) -> np.ndarray:
    """Rows of each key, one line per hash."""
    h = X.mix(keys + np.uint64(0x632BE59BD9B4E019))
    return np.stack([((h >> np.uint64(20 * j)) & np.uint64(ROWS - 1)).astype(np.int64) for j in range(HASHES)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) summed over (lang, text) rows, summed in the tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                keys = np.concatenate([k for _, _, k, _ in gram_keys([t for t, x in zip(texts, langs) if x == lang])])
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages, most frequent first, the filter's planes of rows, and each slice's false positive rate."""

    def __init__(self, languages: list[str], planes: np.ndarray):
        self.languages, self.planes = languages, planes
        bits = ((planes[i // WIDTH] >> np.uint64(i % WIDTH)) & np.uint64(1) for i in range(len(languages)))
        self.false_rate = np.minimum(np.array([np.count_nonzero(b) / ROWS for b in bits]) ** HASHES, 0.99)

    def score(self, at: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of ``size`` texts: its n-grams, its best language, and the share of that language's score."""
        total = np.bincount(row, minlength=size).astype(float)
        best, most, whole = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        for first in range(0, len(self.languages), WIDTH):
            rows = self.planes[first // WIDTH]
            mask = rows[at[0]]
            for line in at[1:]:
                mask &= rows[line]
            hit = np.flatnonzero(mask)
            mask, of = mask[hit], row[hit]
            for i in range(first, min(first + WIDTH, len(self.languages))):
                hits = np.bincount(of, weights=(mask >> np.uint64(i - first)) & np.uint64(1), minlength=size)
                right = np.maximum(0.0, hits - total * self.false_rate[i]) / (1.0 - self.false_rate[i])
                whole += right
                ahead = right > most
                best[ahead], most[ahead] = i, right[ahead]
        return total, best, np.where(whole > 0, most / np.maximum(whole, 1e-12), 0.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = np.zeros(len(texts))
        for first, last, keys, row in gram_keys(texts):
            total, best, scores[first:last] = self.score(places(keys), row, last - first)
            for i in range(last - first):
                text = texts[first + i]
                known = self.languages and text and bool((T.classes()[T.code_points(text)] == T.LETTER).any() if not total[i] else True)
                names.append(self.languages[best[i]] if known else "und")
                if not known:
                    scores[first + i] = 0.0
        return names, scores


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of (doc_id, lang, text) rows. To the driver come a row per language and the filter's rows, 2 MB for WIDTH languages."""
    counts = cut(docs.groupBy("lang").count())
    languages = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").collect()]
    planes = np.zeros((-(-len(languages) // WIDTH), ROWS), np.uint64)
    if not languages:
        return Model([], planes)
    limits = counts.select("lang", F.floor(F.least(F.lit(1.0), F.lit(sample) / F.col("count")) * (1 << 30)).alias("limit"))
    drawn = docs.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1 << 30)) < F.col("limit"))  # a row per language
    grams = cut(gram_counts(drawn))
    size = grams.groupBy("lang").agg(F.sum("n").alias("size"))
    rated = grams.join(F.broadcast(size), "lang").withColumn("rate", F.col("n") / F.col("size"))  # a row per language
    whole = rated.groupBy("gram").agg(F.sum("rate").alias("whole"))
    chosen = rated.join(whole, "gram").filter((F.col("rate") >= SHARE * F.col("whole")) & (F.col("n") >= LEAST))
    number = {x: i for i, x in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            plane, bit = np.divmod(np.array([number[x] for x in batch.column(1).to_pylist()], np.int64), WIDTH)
            columns = [np.tile(plane, HASHES), at.ravel(), np.tile(np.left_shift(1, bit), HASHES)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["plane", "place", "mask"])

    cells = chosen.select("gram", "lang").mapInArrow(work, "plane long, place long, mask long").groupBy("plane", "place").agg(F.bit_or("mask").alias("mask")).toArrow()
    planes[cells.column("plane").to_numpy(), cells.column("place").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return Model(languages, planes)


def predict(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` (the first ones), lang_pred and score."""
    shared = X.small_batches(docs).sparkSession.sparkContext.broadcast(model)
    place = len(carry)
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, place):
            names, scores = shared.value.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(names, pa.string()), pa.array(scores)], names=[*carry, "lang_pred", "score"])

    return docs.select(*carry, text_col).mapInArrow(work, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of ``docs``.

    Learns from documents that are not held out and have a language and a text. Cases: null texts and texts without a letter are
    ``und`` with score 0; texts whose n-grams no filter holds get the most frequent language with score 0; null ids are neither
    held out nor learnt from; without any label all is ``und``; repeated rows are predicted alike; other columns are ignored.
    """
    base = docs.select("doc_id", held_out().alias("held_out"), "text", "lang")
    model = train(base.filter("not held_out and doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text"))
    return predict(base, model, ["doc_id", "held_out"])
