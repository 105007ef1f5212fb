"""Removal of passages that stand elsewhere, by suffix arrays over the places where texts can be equal.

Any LENGTH-byte string holds GRAM-byte strings; its anchor is the one with the smallest hash (the leftmost of equals). Equal strings
have equal anchors at equal offsets, so texts need to be compared only around equal anchors:

  1. One scan lists every text's stretches, maximal runs of string starts with one anchor, as (anchor, digest, place, length). No text
     is shipped.
  2. Anchors counted once are dropped. A stretch found twice, byte for byte, is repeated as a whole; only one of it goes on.
  3. Where one anchor has several different stretches, their bytes (each once) are brought together. Whole anchors are packed into
     blocks; a suffix array of a block, over symbols that end at white space, puts equal continuations side by side; a string
     start is repeated when a neighbour in the array continues alike up to LENGTH and the bytes before the first symbol agree.
     An anchor with more than STRETCHES different stretches is not brought together: its strings are counted by digest, summed in
     the tasks first, which is exact as well.
  4. Repeated starts are joined per text and cut out. Texts that stand in the table twice or more are removed whole.

Texts move twice, compressed, and only stretches of step 3 are compared. No group is gathered but those of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.llm import text as X
from acreage.llm.suffixes import suffix_array
from acreage.session import cut

LENGTH, GRAM = 200, 32
STRETCHES = 20_000
BLOCK = 1 << 18
#: Longer texts are listed in overlapping slices of this many bytes.
SLICE = 1 << 22
PLACE_BITS = 24
LONGEST_SYMBOL = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values, by minima from block starts and from block ends."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def stretches(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor, digest, place, bytes) of all stretches, in the order of the texts."""
    gram = min(GRAM, length)
    owner, base, parts = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), SLICE):
            owner.append(i)
            base.append(at)
            parts.append(t[at : at + SLICE + length - 1])
    owner, base = np.array(owner, np.int64), np.array(base, np.int64)
    found: list[tuple] = []
    low = np.uint64((1 << PLACE_BITS) - 1)
    for first, _, blob, starts, ends in X.blobs(parts):
        if len(blob) < length:
            continue
        sums = X.prefix_sums(blob)
        at = np.arange(len(blob) - gram + 1)
        grams = X.span_hashes(sums, at, at + gram)
        anchor = (_window_minima((grams & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(blob))))[: len(anchor)]
        inside = np.flatnonzero(np.arange(len(anchor)) + length <= ends[of])
        if not len(inside):
            continue
        a, d = anchor[inside], of[inside]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(fresh)
        lo, hi, a, d = inside[begin], inside[np.append(begin[1:], len(inside)) - 1], a[begin], d[begin]
        digest = X.mix(X.span_hashes(sums, lo, hi + length) ^ (a - lo).astype(np.uint64))
        found.append((owner[first + d], grams[a], digest, base[first + d] + lo - starts[d], hi - lo + length))
    if not found:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(column) for column in zip(*found))


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Flags over the parts laid side by side with one byte between: starts of ``length``-byte strings that start elsewhere as well."""
    blob = b"\0".join(parts) + b"\0"
    data = np.frombuffer(blob, np.uint8)
    stops = np.cumsum([len(p) + 1 for p in parts]) - 1
    symbol_ends = X.SPACE[data]
    symbol_ends[stops] = True
    begin = np.concatenate(([0], np.flatnonzero(symbol_ends) + 1))
    size = np.diff(begin)
    if size.max() > min(LONGEST_SYMBOL, length):  # no usable white space: every byte is a symbol
        begin, size = np.arange(len(data) + 1), np.ones(len(data), np.int64)
        ranks = (data.astype(np.int64) + 1).tolist()
        steps = [0]
    else:
        edges = begin.tolist()
        symbols = [blob[a:b] for a, b in zip(edges, edges[1:])]
        rank = {s: i for i, s in enumerate(sorted(set(symbols)), 1)}
        ranks = [rank[s] for s in symbols]
        steps = range(1, int(size.max()) + 1)
    order = np.empty(len(ranks), np.int64)
    order[np.array(suffix_array(ranks))] = np.arange(len(ranks))
    sums = X.prefix_sums(data)
    stop_of = stops[np.searchsorted(stops, begin[:-1])]
    out = np.zeros(len(data), bool)
    for step in steps:
        suffix = np.arange(len(size)) if not step else np.flatnonzero(size[:-1] >= step) + 1
        own = begin[suffix] - step
        limit = stop_of[suffix - 1] if step else stop_of[suffix]
        fits = own + length <= limit
        suffix, own = suffix[fits], own[fits]
        if len(own) < 2:
            continue
        by_suffix = np.argsort(order[suffix])
        suffix, own = suffix[by_suffix], own[by_suffix]
        onward = X.span_hashes(sums, begin[suffix], own + length)
        group = np.concatenate(([0], np.cumsum(onward[1:] != onward[:-1])))
        before = X.span_hashes(sums, own, begin[suffix])
        inner = np.lexsort((before, group))
        same = (group[inner][1:] == group[inner][:-1]) & (before[inner][1:] == before[inner][:-1])
        out[own[inner[1:][same]]] = True
        out[own[inner[:-1][same]]] = True
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


_LIST = "array<struct<anchor: long, digest: long, place: int, bytes: int>>"


def listed(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, row, text_key, n_bytes, sha256 and stretches of every text; ``row`` is unique and fixed once this is written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in X.pieces(batches, 1):
            texts = [t or b"" for t in X.encoded(batch.column(1).to_pylist())]
            of, anchor, digest, place, size = stretches(texts, length)
            items = pa.StructArray.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))], names=["anchor", "digest", "place", "bytes"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts))))).astype(np.int32)
            columns = [
                batch.column(0), pa.array(np.arange(row, row + len(texts))), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(pa.array(offsets), items),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "text_key", "n_bytes", "sha256", "stretches"])

    return docs.mapInArrow(work, f"doc_id long, row long, text_key binary, n_bytes long, sha256 string, stretches {_LIST}")


def packed_texts(docs: DataFrame, length: int) -> DataFrame:
    """(text_key, packed): each text of ``length`` bytes or more once, compressed for its way through a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in X.pieces(batches, 0):
            texts = [t for t in X.encoded(batch.column(0).to_pylist()) if t and len(t) >= length]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], names=["text_key", "packed"])

    return docs.select("text").mapInArrow(work, "text_key binary, packed binary").groupBy("text_key").agg(F.any_value("packed").alias("packed"))


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for value in batch.column("packed"):
        yield press.decompress(value.as_py())


def _ranges(flags: np.ndarray, rows: np.ndarray, places: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
    begin, end = X.runs(flags)
    of = np.searchsorted(starts, begin, "right") - 1
    keep = wanted[of]
    begin, end, of = begin[keep], end[keep], of[keep]
    shift = places[of] - starts[of]
    return pa.RecordBatch.from_arrays([pa.array(rows[of]), pa.array(begin + shift), pa.array(end - 1 + shift)], names=["row", "lo", "hi"])


def compared(bytes_: DataFrame, length: int) -> DataFrame:
    """(row, lo, hi): repeated starts of the lone stretches, by suffix arrays over blocks of whole anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum([len(p[4]) + 1 for p in part])[:-1]))
            rows, places, lone = (np.array([p[i] for p in part], kind) for i, kind in ((1, np.int64), (2, np.int64), (3, bool)))
            return _ranges(repeated_starts([p[4] for p in part], length), rows, places, starts, lone)

        part: list[tuple] = []
        size = 0
        for batch in batches:
            for item in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= BLOCK and item[0] != part[-1][0]:
                    yield flush()
                    part, size = [], 0
                part.append(item)
                size += len(item[4])
        if part:
            yield flush()

    dealt = bytes_.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "row", "place", "lone", "bytes")
    return dealt.mapInArrow(work, "row long, lo long, hi long")


def counted(bytes_: DataFrame, length: int) -> DataFrame:
    """(row, lo, hi): the same for anchors of very many stretches, by counting each string's digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, row, place, lone, data in zip(*[c.to_pylist() for c in batch.columns]):
                sums = X.prefix_sums(np.frombuffer(data, np.uint8))
                at = np.arange(len(data) - length + 1)
                digest = X.mix(X.span_hashes(sums, at, at + length) ^ np.uint64(anchor & ((1 << 64) - 1)))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array([row] * n, pa.int64()), pa.array(at + place), pa.array([lone] * n)], names=["digest", "row", "lo", "lone"])

    strings = bytes_.select("anchor", "row", "place", "lone", "bytes").mapInArrow(work, "digest long, row long, lo long, lone boolean")
    twice = strings.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return strings.filter("lone").join(twice, "digest", "left_semi").select("row", "lo", F.col("lo").alias("hi"))


def find_repeats(docs: DataFrame, length: int = LENGTH, limit: int = STRETCHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, copies, repeats) of (doc_id, text) documents: ``rows`` as ``listed``; (text_key, n) counts of equal texts; and for
    texts that stand once (text_key, ranges), all string starts that also start elsewhere."""
    rows = cut(listed(X.small_batches(docs), length))
    copies = rows.groupBy("text_key").agg(F.count("*").alias("n"))
    parts = rows.filter(F.size("stretches") > 0).select("row", F.inline("stretches"))
    shared = parts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    parts = cut(parts.join(shared, "anchor", "left_semi"))
    kinds = cut(parts.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "place", "bytes")).alias("one")))
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    shipped = kinds.join(many, "anchor").select("anchor", F.col("one.row").alias("row"), F.col("one.place").alias("place"), F.col("one.bytes").alias("size"), (F.col("n") == 1).alias("lone"), (F.col("kinds") > limit).alias("hot"))
    keys = rows.select("row", "text_key")
    wanted = shipped.join(keys, "row").groupBy("text_key").agg(F.collect_list(F.struct("anchor", "row", "place", "size", "lone", "hot")).alias("parts"))  # of one text

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, own in zip(_unpacked(batch), batch.column("parts").to_pylist()):
                for p in own:
                    out.append((p["anchor"], p["row"], p["place"], p["lone"], p["hot"], text[p["place"] : p["place"] + p["size"]]))
                    size += p["size"]
                if size > 1 << 23:
                    yield slice_batch(out)
                    out, size = [], 0
            if out:
                yield slice_batch(out)

    kinds_of = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]

    def slice_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds_of)], names=["anchor", "row", "place", "lone", "hot", "bytes"])

    texts = packed_texts(docs, length)
    bytes_ = texts.join(wanted, "text_key").select("packed", "parts").mapInArrow(slices, "anchor long, row long, place int, lone boolean, hot boolean, bytes binary")
    bytes_ = cut(bytes_)
    whole = parts.join(kinds.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("row", F.col("place").cast("long").alias("lo"), (F.col("place") + F.col("bytes") - length).cast("long").alias("hi"))
    found = whole.unionByName(compared(bytes_.filter("not hot"), length)).unionByName(counted(bytes_.filter("hot"), length))
    lone_texts = keys.join(copies.filter("n = 1").select("text_key"), "text_key")
    repeats = found.join(lone_texts, "row").groupBy("text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # of one text
    return rows, copies, repeats


def spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that start in the ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def cut_texts(docs: DataFrame, repeats: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(text_key, n_removed, n_spans, kept_sha256, kept) of the texts in ``repeats``; ``kept`` is null unless wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, shas, kept = [], [], [], []
            for text, own in zip(_unpacked(batch), batch.column("ranges").to_pylist()):
                gone = spans(own, length)
                left = b"".join(text[a:b] for a, b in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(text)]))
                removed.append(len(text) - len(left))
                count.append(len(gone))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], names=["text_key", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = packed_texts(docs, length).join(repeats, "text_key").select("text_key", "packed", "ranges")
    return joined.mapInArrow(work, "text_key binary, n_removed long, n_spans long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, limit: int = STRETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per row of ``docs``.

    A byte is removed when a ``length``-byte string that covers it also starts anywhere else, in the same text included; strings are
    judged on the input. Cases: null texts are empty; texts shorter than ``length`` stay whole; equal texts of ``length`` bytes or
    more, repeated rows among them, are removed whole; other columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, copies, repeats = find_repeats(docs, length, limit)
    done = cut_texts(docs, repeats, length, with_text=False).drop("kept")
    joined = rows.select("doc_id", "text_key", "n_bytes", "sha256").join(copies, "text_key").join(done, "text_key", "left")
    gone = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    return joined.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``n_chars`` set anew; all rows stay. A character that a cut splits goes."""
    _, copies, repeats = find_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    done = cut_texts(docs, repeats, length, with_text=True).select(F.col("text_key").alias("k1"), "kept")
    twice = copies.filter("n > 1").select(F.col("text_key").alias("k2"), F.lit("").alias("gone"))
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index('text')}")
    keyed = inner.withColumn("__key", text_key(text))
    joined = keyed.join(done, F.col("__key") == F.col("k1"), "left").join(twice, F.col("__key") == F.col("k2"), "left")
    new = F.when(F.octet_length(text) >= length, F.coalesce("gone", "kept", text)).otherwise(text)
    count = {"text": new, "n_chars": F.coalesce(F.length(new), F.lit(0)).cast(docs.schema["n_chars"].dataType if "n_chars" in names else "long")}
    return joined.select(*[count.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
