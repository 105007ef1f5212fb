"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a chunk wherever hash + 1 is a multiple of the block size, 3 * 2**k; each chunk
gives one of 64 signs. The block size is the smallest for which a text has at most MOST_CHUNKS chunk ends, and the fingerprint
also holds the signature of the doubled size, so texts of up to twice the number of chunks can be compared. Two signatures of
one block size are compared by edit distance, and only if they share a run of RUN signs.

Each document is compared with its successor in descending doc_id. Documents are dealt into ranges of doc_id; the first document
of a range also goes to the end of the range before it. So texts are shuffled once, and a task holds one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.llm import text as X

WINDOW, MOST_CHUNKS, RUN = 16, 64, 7
#: The signs of a signature.
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
RANGES_PER_PARTITION = 8


def fingerprints(texts: list[bytes | None]) -> list[str]:
    """"block size:signature:signature at twice the block size" of each text; an empty text has empty signatures."""
    out = []
    for _, _, blob, starts, ends in X.blobs(texts):
        sums = X.prefix_sums(blob)
        n = len(blob)
        at = np.arange(n)
        opening = np.zeros(n, np.int64)
        opening[starts[starts < n]] = starts[starts < n]
        opening = np.maximum.accumulate(opening)
        value = X.span_hashes(sums, np.maximum(at - WINDOW + 1, opening), at + 1) | np.uint64(1 << 62)
        value = value + np.uint64(1)
        triggers = np.flatnonzero(value % np.uint64(3) == 0)
        rest = value[triggers]
        low = rest & (~rest + np.uint64(1))
        level = np.log2(low.astype(np.float64)).astype(np.int64)
        lo, hi = np.searchsorted(triggers, starts), np.searchsorted(triggers, ends)
        bounds, sizes, slots = [], [], []
        for i in range(len(starts)):
            own = level[lo[i] : hi[i]]
            k = 0
            if len(own) > MOST_CHUNKS:
                above = np.cumsum(np.bincount(own)[::-1])[::-1]  # chunk ends at each level or more
                k = int(np.argmax(np.append(above, 0) <= MOST_CHUNKS))
            for j in (k, k + 1):
                stops = triggers[lo[i] : hi[i]][own >= j] + 1
                if ends[i] > starts[i] and (not len(stops) or stops[-1] < ends[i]):
                    stops = np.append(stops, ends[i])
                bounds.append(stops)
                slots.append(np.append(starts[i], stops[:-1]) if len(stops) else stops)
            sizes.append(3 << k)
        stop, start = np.concatenate(bounds).astype(np.int64), np.concatenate(slots).astype(np.int64)
        signs = SIGNS[(X.span_hashes(sums, start, stop) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
        cut = np.concatenate(([0], np.cumsum([len(b) for b in bounds])))
        out += [f"{size}:{signs[cut[2 * i] : cut[2 * i + 1]]}:{signs[cut[2 * i + 1] : cut[2 * i + 2]]}" for i, size in enumerate(sizes)]
    return out


def comparable(a: str, b: str) -> list[tuple[str, str]]:
    """Pairs of signatures of one block size that share a run of RUN signs (of all signs, if one has fewer)."""
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    pairs = [(a1, b1), (a2, b2)] if x == y else [(a1, b2)] if x == 2 * y else [(a2, b1)] if y == 2 * x else []
    found = []
    for s, t in pairs:
        run = min(RUN, len(s), len(t))
        if run and not {s[i : i + run] for i in range(len(s) - run + 1)}.isdisjoint(t[i : i + run] for i in range(len(t) - run + 1)):
            found.append((s, t))
    return found


def likeness(a: str, b: str, pairs: str) -> Column:
    """0 to 1: 1 for equal fingerprints, else the best of 1 - distance / longer length over the comparable signatures."""
    best = F.array_max(F.transform(F.col(pairs), lambda p: 1.0 - F.levenshtein(p["_1"], p["_2"]) / F.greatest(F.length(p["_1"]), F.length(p["_2"]))))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce(best, F.lit(0.0)))


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by the first as many of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_PAIRS = pa.list_(pa.struct([("_1", pa.string()), ("_2", pa.string())]))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row of ``docs``.

    The next document is the next by descending doc_id (equal ids by text, null ids last), after the last the first; a single
    document follows itself. Cases: null texts are empty; empty texts have the fingerprint "3::" and likeness 1 to one another;
    repeated rows follow each other; other columns are ignored; an empty table gives an empty table.
    """
    spark = X.small_batches(docs).sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    found = base.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    limits = [int(x) for x in sorted(set(found), reverse=True)]  # as many as ranges
    over = F.array(*[F.lit(x).cast("long") for x in limits]) if limits else F.array().cast("array<long>")
    place = F.when(F.col("doc_id").isNull(), len(limits) + 1).otherwise(F.size(F.filter(over, lambda x: x > F.col("doc_id"))))
    heads = sorted(base.select("doc_id", place.alias("r")).groupBy("r").agg(F.max("doc_id").alias("head")).collect())  # a row per range
    before = {row["head"]: heads[i - 1]["r"] for i, row in enumerate(heads)}
    ahead = F.lit(None).cast("int")
    for start in range(0, len(before), 64):
        known = {k: r for k, r in list(before.items())[start : start + 64] if k is not None}
        if known:
            ahead = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), F.col("doc_id")), ahead)
    if None in before:
        ahead = F.when(F.col("doc_id").isNull(), before[None]).otherwise(ahead)
    own, copy = F.struct(place.alias("r"), F.lit(False).alias("extra")), F.struct(ahead.alias("r"), F.lit(True).alias("extra"))
    dealt = base.select("*", F.inline(F.when(ahead.isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = dealt.repartition("r").sortWithinPartitions("r", "extra", F.col("doc_id").desc_nulls_last(), "text").select("r", "extra", "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in X.pieces(batches, 3):
            part = held + list(zip(*[c.to_pylist() for c in batch.columns]))
            if len(part) < 2:
                held = part
                continue
            held = part[-1:]
            keep = [i for i in range(len(part) - 1) if not part[i][1]]
            texts = [row[3] for row in part]
            marks = fingerprints([t.encode() for t in texts])
            for at in range(0, len(keep), 2048):
                some = keep[at : at + 2048]
                changed = [edited(texts[i], texts[i + 1]).encode() for i in some]
                marks2 = fingerprints(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[i][2] for i in some], pa.int64()), pa.array([len(texts[i]) for i in some], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                        pa.array([marks[i] for i in some]), pa.array(marks2), pa.array([marks[i + 1] for i in some]),
                        pa.array([comparable(marks[i], m) for i, m in zip(some, marks2)], _PAIRS), pa.array([comparable(marks[i], marks[i + 1]) for i in some], _PAIRS),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "p1", "p2"],
                )

    pairs = "array<struct<_1: string, _2: string>>"
    out = rows.mapInArrow(work, f"doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, p1 {pairs}, p2 {pairs}")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", "p1").alias("near_edited"), likeness("fingerprint", "next_fingerprint", "p2").alias("near_next"),
    )
