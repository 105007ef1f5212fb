"""Vectors as short codes: a codebook for each of 16 parts, nearest entries found by slicing sorted coordinates and intersecting masks.

Nearest entry. For each dimension of a part the 64 entries' coordinates are sorted, and beside every rank stands a uint64 with a bit
for each entry before it. The entries whose coordinate lies within a range are the exclusive or of the masks at its ends, and the AND
over the dimensions is the set of entries in a box. The initial radius of a part is its exact distance to an entry that sits next to it
in the widest dimension, or to the best of a few; the nearest entry can be no farther, so it and all its ties are inside the box of that
radius, and distances are worked out for the candidates alone. Nothing is approximate.

Scale. A round is one scan: every task adds up sums and counts of the entries it chose and ships them as rows (part, entry, place,
sum); only the codebooks themselves, 64 entries of one vector's length, come to the driver and go to the tasks. Vectors are never
shuffled. The errors of equal labels are added before the shuffle and meet the rows by a join that Spark may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.session import cut

#: Parts of a vector, entries of a codebook, rounds, steps per unit of a component.
PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Components stop at this many steps (about a quarter of a million units), so the squared distances of 512 numbers add up in 64 bits.
REACH = 1 << 26
#: Rows a task works on at once.
ROWS = 4096


class Codebook:
    """Entries of one part with the masks of their sorted coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (entries, numbers), int64
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.masks = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=self.masks[1:])
        spread = self.sorted[-1] - self.sorted[0]
        self.widest = np.argsort(-spread, kind="stable")[:2]
        self.order = order

    def distance(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = parts - self.entries[entry]
        return np.einsum("ij,ij->i", apart, apart)

    def radius(self, parts: np.ndarray) -> np.ndarray:
        """Initial radius: the least distance to the entries on both sides in the two widest dimensions, rounded up."""
        best = None
        for j in self.widest:
            at = np.searchsorted(self.sorted[:, j], parts[:, j])
            for side in (at - 1, at):
                d = self.distance(parts, self.order[np.clip(side, 0, len(self.entries) - 1), j])
                best = d if best is None else np.minimum(best, d)
        root = np.sqrt(best.astype(np.float64)).astype(np.int64)
        return root + 1  # a square root is off by less than one

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ from each part by ``radius`` at most in every dimension."""
        found = np.full(len(parts), ~np.uint64(0), np.uint64)
        for j in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, j], parts[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], parts[:, j] + radius, "right")
            found &= self.masks[high, j] ^ self.masks[low, j]
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each part, ties to the lower index."""
        masks = self.candidates(parts, self.radius(parts))
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)  # ascending entries within ascending rows, at least one each
        d = self.distance(parts[row], entry)
        starts = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(d, starts) if len(parts) else d
        hit = np.flatnonzero(d == least[row])
        first = np.ones(len(hit), bool)
        first[1:] = row[hit][1:] != row[hit][:-1]
        return entry[hit[first]], least


def kept_rows(batch: pa.RecordBatch, column: int, length: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(rows kept, their components in steps): vectors of ``length`` finite numbers; without a length, the rows of any that parts fit."""
    vectors = batch.column(column)
    sizes = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = vectors.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    numbers = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(holes | ~np.isfinite(numbers))))
    ends = np.cumsum(sizes)
    fits = (sizes == length) if length else (sizes > 0) & (sizes % PARTS == 0)
    rows = np.flatnonzero(fits & (bad[ends] == bad[ends - sizes]))
    if length is None:
        return rows, None
    at = (ends - sizes)[rows, None] + np.arange(length)
    return rows, np.clip(np.floor(numbers[at] * STEPS), -REACH, REACH).astype(np.int64)


def _first_vectors(vectors: DataFrame, length: int | None) -> list:
    """The kept vectors of the ENTRIES smallest ids, as rows (vec_id, vec); of several with one id the smallest.

    Every batch passes on the ones of its own smallest ids, so the sort gets few rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.filter(batch.column(0).is_valid())
            rows, _ = kept_rows(named, 1, length)
            ids = named.column(0).to_numpy()[rows]
            wanted = np.unique(ids)[:ENTRIES]
            some = [rows[ids == i] for i in wanted]
            best = [min(r, key=lambda j: named.column(1)[int(j)].as_py()) if len(r) > 1 else r[0] for r in some]
            yield named.take(pa.array(best, pa.int64()))

    first = vectors.select("vec_id", "vec").mapInArrow(work, "vec_id long, vec array<double>")
    return first.groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").limit(ENTRIES).collect()


def _books(entries: np.ndarray) -> list[Codebook]:
    """A codebook for each part of ``entries`` (entries, PARTS, numbers)."""
    return [Codebook(np.ascontiguousarray(entries[:, p])) for p in range(PARTS)]


def _assigned(batches: Iterator[pa.RecordBatch], column: int, length: int, books: list[Codebook]) -> Iterator[tuple]:
    """(batch, rows, parts, entries, distances) for slices of kept rows; the last three have a column per part."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            some = batch.slice(start, ROWS)
            rows, numbers = kept_rows(some, column, length)
            parts = numbers.reshape(len(rows), PARTS, length // PARTS)
            found = [books[p].nearest(parts[:, p]) for p in range(PARTS)]
            yield some, rows, parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _moved(vectors: DataFrame, length: int, entries: np.ndarray) -> np.ndarray:
    """The entries after one round: each the mean of the parts assigned to it, rounded down; unused ones as they were."""
    books = _books(entries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(entries) * PARTS, length // PARTS + 1), np.int64)  # the last column counts
        for _, rows, parts, entry, _ in _assigned(batches, 0, length, books):
            place = entry * PARTS + np.arange(PARTS)
            np.add.at(total[:, -1], place.ravel(), 1)
            np.add.at(total[:, :-1], place.ravel(), parts.reshape(len(rows) * PARTS, length // PARTS))
        row, column = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(total[row, column])], names=["slot", "place", "total"])

    found = vectors.select("vec").mapInArrow(work, "slot long, place long, total long").groupBy("slot", "place").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros((len(entries) * PARTS, length // PARTS + 1), np.int64)
    total[found.column("slot").to_numpy(), found.column("place").to_numpy()] = found.column("total").to_numpy()
    mean = total[:, :-1] // np.maximum(total[:, -1:], 1)
    return np.where(total[:, -1:] > 0, mean, entries.reshape(len(mean), -1)).reshape(entries.shape)


def compress(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every kept row, entries): entries[e, p] is entry e of part p, in steps."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    first = _first_vectors(base, None)
    length = len(first[0]["vec"]) if first else 0
    if any(len(r["vec"]) != length for r in first):
        first = _first_vectors(base, length)
    schema = base.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    if not first:
        return base.sparkSession.createDataFrame([], schema), np.empty((0, PARTS, 0), np.int64)
    entries = np.clip(np.floor(np.array([r["vec"] for r in first]) * STEPS), -REACH, REACH).astype(np.int64).reshape(len(first), PARTS, -1)
    for _ in range(rounds):
        entries = _moved(base, length, entries)
    books = _books(entries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _, entry, apart in _assigned(batches, 2, length, books):
            text = entry.astype(np.uint8).tobytes().hex()
            codes = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            kept = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(codes, pa.string()), pa.array(apart.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return base.mapInArrow(work, schema), entries


def decode(code: str, entries: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in units of the components: the middle of each step."""
    return ((entries[list(bytes.fromhex(code)), np.arange(PARTS)] + 0.5) / STEPS).ravel()


def codebooks_digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row per kept row of ``vectors`` (vec_id, embedding, label).

    Rows are kept whose vector has only finite components, and as many as the vector of the smallest kept id whose length the 16 parts
    divide; others, empty vectors among them, cannot be cut into the parts and are dropped like nulls. A null id is coded but never
    starts an entry; of several vectors with one id the smallest starts it. Fewer than 64 ids give fewer entries. Components beyond
    REACH steps count as REACH. Ties go to the lower entry; repeated rows get equal codes; label errors that pass 64 bits are null.
    Other columns are ignored. An empty table gives an empty table.
    """
    coded, entries = compress(vectors)
    rows = cut(coded)
    sums = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(entries)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Assignment and update of every round, as common table expressions."""
    assign = (
        "a{r} AS (SELECT k.rid, k.part, e.entry, d FROM k JOIN LATERAL (SELECT entry, list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d "
        "FROM c{r} c WHERE c.part = k.part) e ON true QUALIFY row_number() OVER (PARTITION BY k.rid, k.part ORDER BY d, e.entry) = 1)"
    )
    move = (
        "m{r} AS (SELECT part, entry, list(y ORDER BY pos) AS x FROM (SELECT part, entry, pos, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS y FROM (SELECT a.part, a.entry, unnest(k.x) AS y, "
        "generate_subscripts(k.x, 1) AS pos FROM a{p} a JOIN k USING (rid, part)) GROUP BY ALL) GROUP BY part, entry), "
        "c{r} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{p} c LEFT JOIN m{r} m USING (part, entry))"
    )
    steps = [assign.format(r=0)]
    for r in range(1, ROUNDS + 1):
        steps += [move.format(r=r, p=r - 1), assign.format(r=r)]
    return ", ".join(steps)


#: Plain definition for a second engine: all distances, ties by entry.
ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({STEPS} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), k AS (
  SELECT rid, part, q[part * len(q) // {PARTS} + 1:(part + 1) * len(q) // {PARTS}] AS x FROM v, range({PARTS}) g(part)
), s AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v WHERE vec_id IS NOT NULL QUALIFY entry < {ENTRIES}
), c0 AS (
  SELECT part, entry, x FROM k JOIN s USING (rid)
), {_rounds_sql()}, o AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid
), b AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM v JOIN o USING (rid) JOIN b ON true
"""
