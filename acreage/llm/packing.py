"""Hierarchical multi-length packing of token ids.

A document's whole windows of LONGEST ids stand alone; what is left of it is routed to the shortest context tier that holds it.
Tiers are packed from long to short: each opens a window per document, fills the gap with the largest pieces of shorter tiers that
fit, and closes the last gap by cutting the next larger piece, whose rest goes back to its own tier. So every window is full. The
few ids left at the end of a partition are cut into windows of powers of two. Windows of one tier are dealt in equal numbers to
step groups, each of STEP_TOKENS ids of one context size, so steps cost alike.

Packing needs nothing but the documents of the same partition, so it is a narrow step: no shuffle, no limit on the corpus, and a
lost task is redone alike.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm import pretokens as T
from acreage.llm import text as X

LONGEST = 4096
TIERS = [4096, 2048, 1024, 512]
STEP_TOKENS = 1 << 15
END = 2
#: Ids held by a task before it packs.
CHUNK = 1 << 20
CHARS = 1 << 19
#: Bytes of ids in a batch of pieces.
OUT_BYTES = 1 << 22
#: Distinct words a worker remembers.
CACHE = 1 << 20
#: The vocabulary's special strings and their ids.
SPECIALS = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}


class Encoder:
    """Ids of whole texts as the tokenizer file gives them; each distinct word is encoded once while it stays in the cache."""

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        """Known words: sorted hashes, first id and number of ids of each in ``flat``."""
        self.keys, self.first, self.count, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids = T.encode_pieces(self.path, texts)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.flat) + np.cumsum(count) - count
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.first, self.count = np.insert(self.keys, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.flat = np.concatenate([self.flat, *ids])

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (so a final capital sigma becomes the ordinary small one)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _words(self, joined: str, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each word, its ids' number, and all ids."""
        points = T.code_points(joined)
        starts = T.token_starts(points, segments, blank_joins=False)
        hashes = T.piece_hashes(points, starts)
        ends = np.append(starts[1:], len(points))
        word = T.classes()[points[starts]] != T.BLANK
        starts, ends, hashes = starts[word], ends[word], hashes[word]
        found, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        place = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        known[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == found[place < len(self.keys)]
        if not known.all():
            new = np.flatnonzero(~known)
            self.learn(found[new], [joined[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            place = np.searchsorted(self.keys, found)
        n = self.count[place][back]
        first = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.first[place][back] - first, n) + np.arange(int(n.sum()))]
        return starts, n, ids

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of every text, in order, in runs of about CHARS characters."""
        first = 0
        while first < len(texts):
            parts, specials, counts, size, last = [], [], [], 0, first
            while last < len(texts) and (last == first or size < CHARS):
                pieces = T.split_specials(texts[last] or "", list(SPECIALS))
                counts.append(len(pieces))
                for j, piece in enumerate(pieces):
                    specials.append(SPECIALS[piece] if j % 2 else None)
                    parts.append("" if j % 2 else self.normal(piece))
                    size += len(parts[-1])
                last += 1
            lengths = np.array([len(p) for p in parts], np.int64)
            ends = np.cumsum(lengths)
            starts, n, ids = self._words("".join(parts), (ends - lengths)[lengths > 0])
            total = np.concatenate(([0], np.cumsum(n)))
            lo, hi = total[np.searchsorted(starts, ends - lengths)], total[np.searchsorted(starts, ends)]
            at = 0
            for c in counts:
                own = [np.array([specials[j]], np.uint32) if specials[j] is not None else ids[lo[j] : hi[j]] for j in range(at, at + c)]
                yield own[0] if c == 1 else np.concatenate(own)
                at += c
            first = last


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Pool:
    """Pieces by length; a bit mask tells which lengths are there, so best fits cost no search."""

    def __init__(self) -> None:
        self.by_length: list[list] = [[] for _ in range(LONGEST + 1)]
        self.mask = 0

    def add(self, piece: tuple) -> None:
        if not self.by_length[piece[2]]:
            self.mask |= 1 << piece[2]
        self.by_length[piece[2]].append(piece)

    def _pop(self, length: int) -> tuple:
        own = self.by_length[length]
        piece = own.pop()
        if not own:
            self.mask ^= 1 << length
        return piece

    def largest(self, most: int) -> tuple | None:
        low = self.mask & ((2 << most) - 1)
        return self._pop(low.bit_length() - 1) if low else None

    def next_larger(self, than: int) -> tuple | None:
        high = self.mask >> (than + 1)
        return self._pop((high & -high).bit_length() + than) if high else None


def pack(pool: Pool, last: bool) -> Iterator[tuple[int, list[tuple]]]:
    """(window size, pieces) until the pool cannot fill a window; ``last`` also empties the pool into powers of two.

    A piece is (document, start, length, ...); equal tuples but for start and length stay together when one is cut.
    """

    def filled(window: list[tuple], gap: int) -> int:
        while gap:
            piece = pool.largest(gap)
            if piece is None:
                piece = pool.next_larger(gap)
                if piece is None:
                    return gap
                doc, start, length = piece
                pool.add((doc, start + gap, length - gap))
                piece = (doc, start, gap)
            window.append(piece)
            gap -= piece[2]
        return 0

    open_ids: list[tuple] = []
    for tier in TIERS:
        least = tier // 2 if tier > TIERS[-1] else 0
        while True:
            seed = pool.largest(tier)
            if seed is None:
                break
            if seed[2] <= least:
                pool.add(seed)
                break
            window = [seed]
            if filled(window, tier - seed[2]):
                open_ids = window  # the pool is empty now
                break
            yield tier, window
    for piece in open_ids:
        pool.add(piece)
    if last:
        left = sum(length * len(own) for length, own in enumerate(pool.by_length))
        while left:
            size = 1 << (left.bit_length() - 1)
            window = []
            filled(window, size)
            yield size, window
            left -= size


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long"


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, window, step_group.

    A document is the ids of its whole text and the end id. Pieces of a sequence follow each other from offset 0; a sequence has
    ``window`` ids, always a power of two. Cases: null and empty texts are the end id alone; repeated rows are packed one by one;
    null ids stay null; texts of any length are cut; an empty table gives an empty table; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        pool, held, ids_of, doc_ids = Pool(), 0, {}, {}
        sequence = TaskContext.get().partitionId() << 32
        steps: dict[int, list[int]] = {}
        step = sequence
        counter = 0
        rows: list[tuple] = []
        size = 0

        def emit(window: int, pieces: list[tuple]) -> None:
            nonlocal sequence, step, size
            group = steps.setdefault(window, [0, -1])
            if group[0] % max(1, STEP_TOKENS // window) == 0:
                group[1] = step
                step += 1
            group[0] += 1
            offset = 0
            for doc, start, length in pieces:
                ids = ids_of[doc]
                rows.append((doc_ids[doc], start, length, ids[start : start + length].tobytes(), len(ids), sequence, offset, window, group[1]))
                offset += length
            size += 4 * window
            sequence += 1

        def batch_out() -> pa.RecordBatch:
            nonlocal size
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            names = [f.split()[0] for f in _SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
            rows.clear()
            size = 0
            return out

        for batch in X.pieces(batches, 1):
            for key, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                doc_ids[counter], ids_of[counter] = key, ids
                whole = len(ids) // LONGEST
                for j in range(whole):
                    emit(LONGEST, [(counter, j * LONGEST, LONGEST)])
                    if size >= OUT_BYTES:
                        yield batch_out()
                if len(ids) % LONGEST:
                    pool.add((counter, whole * LONGEST, len(ids) % LONGEST))
                else:
                    del doc_ids[counter], ids_of[counter]
                held += len(ids)
                counter += 1
                if held >= CHUNK:
                    for window, pieces in pack(pool, last=False):
                        emit(window, pieces)
                        if size >= OUT_BYTES:
                            yield batch_out()
                    left = {p[0] for pieces in pool.by_length for p in pieces}
                    ids_of = {d: ids_of[d] for d in left}
                    doc_ids = {d: doc_ids[d] for d in left}
                    held = 0
        for window, pieces in pack(pool, last=True):
            emit(window, pieces)
            if size >= OUT_BYTES:
                yield batch_out()
        if rows:
            yield batch_out()

    return X.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, _SCHEMA)
