"""Token counts: pieces are counted once per distinct pre-token and summed over each document's pre-token frequencies.

  1. One scan finds the frequent pre-tokens of the corpus (``frequent``), at most HEAD of them. Their pieces are counted once and
     broadcast as two arrays of at most HEAD entries, whatever the corpus.
  2. A second scan turns every document into the sum over its frequent pre-tokens and the (pre-token, frequency) pairs of the
     others. These are written once; a row key made there ties both parts, so repeated documents do not mix.
  3. The distinct rest is counted once per pre-token, joined to the pairs and summed by row.

No ids are made for a document, and the choice of frequent pre-tokens changes the cost only, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm import pretokens as T
from acreage.llm import text as X
from acreage.session import cut

HEAD = 1 << 18
#: A pre-token is a candidate for the head where it stands this often in one batch of texts.
SEEN = 4
CHARS = 1 << 19
#: Fixed value: the special string of the vocabulary, one token wherever it stands.
SPECIALS = ["<|endoftext|>"]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, row after the last, joined text, segment starts, their rows, special strings per row."""
    first = 0
    while first < len(texts):
        last, size, parts, owner = first, 0, [], []
        special = []
        while last < len(texts) and (last == first or size < CHARS):
            pieces = T.split_specials(texts[last] or "", SPECIALS)
            special.append(len(pieces) // 2)
            for piece in pieces[::2]:
                if piece:
                    parts.append(piece)
                    owner.append(last - first)
                    size += len(piece)
            last += 1
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64) if parts else np.empty(0, np.int64)
        yield first, last, "".join(parts), starts, np.array(owner, np.int64), np.array(special, np.int64)
        first = last


def _pieces(joined: str, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = T.code_points(joined)
    starts = T.token_starts(points, segments, blank_joins=True)
    return starts, T.piece_hashes(points, starts)


def frequent(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """(token) of the pre-tokens counted most, at most ``head``: counts are summed in the tasks, then over all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[int, int] = {}
            text: dict[int, str] = {}
            for _, _, joined, segments, _, _ in _runs(batch.column(0).to_pylist()):
                if not joined:
                    continue
                starts, hashes = _pieces(joined, segments)
                ends = np.append(starts[1:], len(joined))
                found, at, n = np.unique(hashes, return_index=True, return_counts=True)
                for h, i, c in zip(found.tolist(), at.tolist(), n.tolist()):
                    if h in count:
                        count[h] += c
                    else:
                        count[h] = c
                        text[h] = joined[starts[i] : ends[i]]
            keep = [h for h, c in count.items() if c >= SEEN and len(text[h]) <= 64]
            yield pa.RecordBatch.from_arrays([pa.array([text[h] for h in keep], pa.string()), pa.array([count[h] for h in keep], pa.int64())], names=["token", "n"])

    summed = cut(docs.mapInArrow(work, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    room, least = head, None
    for row in sorted(summed.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a thousand levels at most
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    return summed.filter(F.lit(False) if least is None else level >= least).select("token")


def piece_counts(tokens: DataFrame, path: str) -> DataFrame:
    """(token, pieces): each pre-token is encoded once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = T.encode_pieces(path, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64())], names=["token", "pieces"])

    return tokens.select("token").mapInArrow(work, "token string, pieces long")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row per row of ``docs``.

    n_tokens is the number of ids the tokenizer file at ``path`` gives for the whole text without added tokens; special strings
    inside the text are one token each. Cases: null and empty texts have 0; repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty table.
    """
    base = X.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = piece_counts(frequent(base.select("text"), head), path).toArrow()  # at most ``head`` rows
    names = known.column("token").to_pylist()
    joined_names = "".join(names)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in names])[:-1])).astype(np.int64) if names else np.empty(0, np.int64)
    hashes = T.piece_hashes(T.code_points(joined_names), begin) if names else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    table = base.sparkSession.sparkContext.broadcast((hashes[order], known.column("pieces").to_numpy()[order].astype(np.int32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = table.value
        row_key = (TaskContext.get().partitionId()) << 40
        for batch in X.pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            known_sum = np.zeros(len(texts), np.int64)
            rest: list = [None] * len(texts)
            for first, last, joined, segments, owners, special in _runs(texts):
                known_sum[first:last] = special
                if not joined:
                    continue
                starts, hashes = _pieces(joined, segments)
                ends = np.append(starts[1:], len(joined))
                found, back = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
                hit = keys[at] == found if len(keys) else np.zeros(len(found), bool)
                pieces = np.where(hit, counts[at], 0) if len(keys) else np.zeros(len(found), np.int64)
                row = owners[np.searchsorted(segments, starts, "right") - 1]
                known_sum[first:last] += np.bincount(row, weights=pieces[back], minlength=last - first).astype(np.int64)
                other = np.flatnonzero(~hit[back])
                pair, where, n = np.unique(row[other] * len(found) + back[other], return_index=True, return_counts=True)
                for r, i, c in zip((pair // len(found)).tolist(), other[where].tolist(), n.tolist()):
                    own = rest[first + r]
                    if own is None:
                        own = rest[first + r] = []
                    own.append((joined[starts[i] : ends[i]], c))
            size = [len(t.encode()) if t else 0 for t in texts]
            rows = np.arange(row_key, row_key + len(texts))
            row_key += len(texts)
            pairs = pa.array([[{"token": t, "n": c} for t, c in own] if own else None for own in rest], pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(size, pa.int64()), pa.array(known_sum), pairs], names=["row", "doc_id", "n_bytes", "known", "rest"])

    rows = cut(base.mapInArrow(work, "row long, doc_id long, n_bytes long, known long, rest array<struct<token string, n long>>"))
    pairs = rows.filter("rest is not null").select("row", F.inline("rest"))
    counted = piece_counts(pairs.select("token").distinct(), path)
    sums = pairs.join(counted, "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    return rows.drop("rest").join(sums, "row", "left").select("doc_id", "n_bytes", total).withColumn("over_limit", F.col("n_tokens") > limit)
