"""Near-duplicate classes: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidate edges.

Steps
  1. One scan turns every text into its shingle set's digest and its band values (``sketches``). Sets are never shipped here.
  2. Equal sets become one class, named by its smallest doc_id, so copies cost one row from there on.
  3. Classes that share a band value share a bucket. In a round each bucket proposes edges from a hub to its members only, so
     a bucket of m classes gives m - 1 pairs and not m * m / 2. The first hub is the member met in the largest buckets, the
     original of a family of copies. Every edge is confirmed on the full sets.
  4. Links merge components. A bucket whose members lie in several components stays open; its hub leaves it and the next
     round takes the smallest components' members as hubs, sixteen times as many a round. A bucket closes only when all its
     members are in one component or all pairs across components were tried, so the stars lose no link.

Recall: the chance that a pair at the limit shares no band is (1 - s**rows)**bands, below 1e-8 for the defaults.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm import text as X
from acreage.session import cut, first_per_key

BINS = 160
PARITY_WORDS = 32
EDGES_PER_TASK = 256


def _probes(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin the fixed random sequence of bins it may borrow from."""
    grid = np.arange(bins * tries, dtype=np.uint64).reshape(bins, tries)
    return (X.mix(grid + np.uint64(0x51ED270B)) % np.uint64(bins)).astype(np.int64)


def densify(values: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Optimal densification: each empty bin takes the value of the first non-empty bin of its own random sequence.

    ``values`` and ``empty`` have a row per text with at least one shingle and a column per bin.
    """
    bins = values.shape[1]
    probes, out = _probes(bins), values.copy()
    rows, cols = np.nonzero(empty)
    for t in range(probes.shape[1]):
        if not len(rows):
            break
        lender = probes[cols, t]
        full = ~empty[rows, lender]
        out[rows[full], cols[full]] = values[rows[full], lender[full]]
        rows, cols = rows[~full], cols[~full]
    if len(rows):  # no lender in 64 tries: the first non-empty bin after it
        for i, j in zip(rows, cols):
            full = np.flatnonzero(~empty[i])
            out[i, j] = values[i, full[np.searchsorted(full, j) % len(full)]]
    return out


def band_values(sets: list[np.ndarray], rows: int, bins: int = BINS) -> np.ndarray:
    """Band hashes, a row per set; the band's number is part of its hash."""
    edges = np.array([-(-(i << 64) // bins) for i in range(bins)], np.uint64)
    values, empty = np.empty((len(sets), bins), np.uint64), np.empty((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = np.append(np.searchsorted(s, edges), len(s))
        empty[i] = at[:-1] == at[1:]
        values[i] = s[np.minimum(at[:-1], len(s) - 1)]
    dense = densify(values, empty).reshape(len(sets), bins // rows, rows)
    total = np.arange(1, bins // rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    total = np.broadcast_to(total, (len(sets), bins // rows)).copy()
    for j in range(rows):
        total = X.mix(total + dense[:, :, j])
    return total.view(np.int64)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, words: int = 5, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set, null when empty), bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, 1):
            count, keys, slots, sets = [], [], [], []
            for i, own in X.shingle_sets(X.encoded(batch.column(1).to_pylist(), lower=True), words):
                count.append(len(own))
                keys.append(_digest(own) if len(own) else None)
                if len(own):
                    slots.append(i)
                    sets.append(own)
            bands: list = [None] * len(count)
            for at in range(0, len(sets), 1024):
                for i, row in zip(slots[at : at + 1024], band_values(sets[at : at + 1024], rows)):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_SKETCH)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, own, parity): sorted shingle hashes of the classes in ``wanted`` (rep, set_key), and the parity of their number in each
    of 64 * PARITY_WORDS hash cells. A repeated id with another text is left out by its digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, 2):
            keys, reps = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            ids, sets, parity = [], [], []
            for i, own in X.shingle_sets(X.encoded(batch.column(2).to_pylist(), lower=True), words):
                if _digest(own) == keys[i]:
                    ids.append(reps[i])
                    sets.append(own.tobytes())
                    cells = np.bincount((own & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS)
                    parity.append(np.packbits(cells & 1, bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.array(parity, pa.list_(pa.int64()))], names=["rep", "own", "parity"])

    found = wanted.join(docs, wanted.rep == docs.doc_id).select("rep", "set_key", "text").mapInArrow(work, "rep long, own binary, parity array<long>")
    return found.dropDuplicates(["rep"])


def unique_shingles(sets: DataFrame) -> DataFrame:
    """(rep, n, u, parity): size of each set and how many of its shingles no other set holds, at least.

    Counted on 32 bits of the hashes: two shingles that fall together only make u smaller, which keeps the bound below valid.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, own = batch.column(0).to_pylist(), batch.column(1)
            at, size = 0, 0
            parts: list[np.ndarray] = []
            for i in range(batch.num_rows):
                parts.append((np.frombuffer(own[i].as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                size += len(parts[-1])
                if size > 1 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(reps[at : i + 1], np.int64), [len(x) for x in parts])), pa.array(np.concatenate(parts))], names=["rep", "shingle"])
                    at, size, parts = i + 1, 0, []

    alone = sets.select("rep", "own").mapInArrow(work, "rep long, shingle int").groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    count = alone.groupBy("rep").agg(F.count("*").alias("u"))
    return sets.select("rep", "parity", (F.length("own") / 8).cast("long").alias("n")).join(count, "rep", "left").select("rep", "n", F.coalesce("u", F.lit(0)).alias("u"), "parity")


def may_link(percent: int, own: str = "", other: str = "hub_"):
    """Whether two sets can be linked at all, by two exact bounds: shingles that one set alone holds are outside the intersection and
    inside the union; and every cell whose parities differ holds a shingle of one set only."""
    n1, n2, u1, u2 = (F.col(f"{side}{name}") for name in ("n", "u") for side in (own, other))
    common = F.least(n1 - u1, n2 - u2)
    apart = sum((F.bit_count(F.col(f"{own}parity")[i].bitwiseXOR(F.col(f"{other}parity")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    return (100 * common >= percent * F.greatest(n1 + u2, n2 + u1)) & ((100 + percent) * apart <= (100 - percent) * (n1 + n2))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, rep) with 100 * intersection >= percent * union, counted on the full sets.

    A hub's edges are dealt into parts of about EDGES_PER_TASK; the hub's set goes once to each part and then its members'
    sets stream past it, so a hub of any degree needs the memory of two sets.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / EDGES_PER_TASK).alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"))
    heads = dealt.select("hub", "part").distinct().join(sets.select(F.col("rep").alias("hub"), "own"), "hub").select("hub", "part", F.lit(None).cast("long").alias("rep"), "own")
    rows = heads.unionByName(dealt.join(sets.select("rep", "own"), "rep").select("hub", "part", "rep", "own")).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("rep").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            hubs, reps, own = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            a, b = [], []
            for i in range(batch.num_rows):
                other = np.frombuffer(own[i].as_buffer(), np.uint64)
                if reps[i] is None:
                    head = other.copy()
                    continue
                if 100 * min(len(head), len(other)) < percent * max(len(head), len(other)):
                    continue
                both = np.concatenate((head, other))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    a.append(hubs[i])
                    b.append(reps[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["hub", "rep"])

    return rows.mapInArrow(work, "hub long, rep long")


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rep, label) after joining the components that the links (hub, rep) connect; the smaller label wins.

    Each pass hooks a component to its smallest neighbour, jumps one step on, and contracts the edges, all by joins and
    minimum aggregates; a hub of any degree is never gathered.
    """
    a, b = labels.toDF("hub", "x"), labels.toDF("rep", "y")
    edges = cut(links.join(a, "hub").join(b, "rep").filter("x <> y").select("x", "y").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("up")))
        above = up.toDF("up", "top")
        jump = cut(up.join(above, "up").select(F.col("x").alias("label"), "top"))
        labels = cut(labels.join(jump, "label", "left").select("rep", F.coalesce("top", "label").alias("label")))
        one, two = jump.toDF("x", "x2"), jump.toDF("y", "y2")
        edges = cut(edges.join(one, "x").join(two, "y").filter("x2 <> y2").select(F.col("x2").alias("x"), F.col("y2").alias("y")).distinct())
    return labels


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``.

    Two texts are linked when their distinct shingles of ``words`` words (A-Z lower-cased, white-space words; fewer words are
    one shingle) have 100 * intersection >= percent * union. component_id is the smallest doc_id reachable over links.

    Cases: null, empty and blank texts have n_shingles 0 and are alone (component_id = doc_id). Equal sets are always linked.
    Repeated rows get the same values; two texts under one doc_id count as one node only where both name their class. A null
    doc_id gets the smallest doc_id of its equal copies' component, null if there is none, and kept is then false. An empty
    table gives an empty table. Other columns are ignored.
    """
    docs = X.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = 5 if percent >= 85 else 4
    drawn = cut(sketches(docs, words, rows))
    classes = cut(drawn.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    members = classes.select(F.explode("bands").alias("bucket"), "rep")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = cut(members.join(shared, "bucket").distinct())
    labels = open_.select("rep").distinct().select("rep", F.col("rep").alias("label"))
    if not open_.isEmpty():
        labels = cut(labels)
        sets = cut(full_sets(docs, classes.join(labels, "rep", "left_semi").select("rep", "set_key"), words))
        mass = open_.groupBy("rep").agg(F.sum("n").alias("mass"))
        facts = unique_shingles(sets).filter(100 * (F.col("n") - F.col("u")) >= percent * F.col("n")).join(mass, "rep")
        open_ = cut(open_.select("bucket", "rep").join(facts, "rep").select("bucket", "rep", F.col("rep").alias("label"), "n", "u", "parity", "mass"))
        hubs = open_.groupBy("bucket").agg(F.max(F.struct("mass", (-F.col("rep")).alias("r"), "n", "u", "parity")).alias("top"))
        hubs = hubs.select("bucket", (-F.col("top.r")).alias("hub"), (-F.col("top.r")).alias("hub_label"), F.col("top.n").alias("hub_n"), F.col("top.u").alias("hub_u"), F.col("top.parity").alias("hub_parity"))
        tried, many = None, 1
        while True:
            hubs = cut(hubs)
            found = open_.join(hubs, "bucket").filter((F.col("rep") != F.col("hub")) & (F.col("label") != F.col("hub_label")) & may_link(percent))
            pairs = found.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"), "hub", "rep").dropDuplicates(["a", "b"])
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = cut(pairs)
            tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
            labels = merge_labels(labels, confirm(pairs.select("hub", "rep"), sets, percent))
            done = hubs.select("bucket", F.col("hub").alias("rep"))
            rest = open_.drop("label").join(done, ["bucket", "rep"], "left_anti").join(labels, "rep")
            torn = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
            open_ = cut(rest.join(torn, "bucket", "left_semi"))
            if open_.isEmpty():
                break
            many *= 16
            sizes = open_.groupBy("bucket", "label").agg(F.count("*").alias("size"))
            ranked = first_per_key(open_.join(sizes, ["bucket", "label"]), ["bucket"], [F.col("size"), F.col("rep")], many)
            hubs = ranked.select("bucket", F.col("rep").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"), F.col("u").alias("hub_u"), F.col("parity").alias("hub_parity"))
    named = classes.select("set_key", "rep").join(labels, "rep", "left").select(F.col("set_key").alias("class_key"), F.coalesce("label", "rep").alias("class_id"))
    out = drawn.join(named, drawn.set_key == named.class_key, "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: Ids beyond this many are told by a key like rows without an id, whose keys start here.
FIRST_KEY = 1 << 62


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One document of each class of near duplicates, with all its columns: the one with the smallest doc_id, nulls last.

    Rows with an id of their own are told by it; only rows without an id, and those that share one, are written with a key, so that
    they are judged as well. Texts without a shingle (null, empty, blank) are alone and stay; of repeated rows among them (equal
    doc_id and text) one stays, unless the doc_id is null. Of other repeated rows one stays. Columns may have any names beside
    doc_id and text. An empty table gives an empty table.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}")
    rows = inner.select("*", doc_id.alias("id"))
    plain = F.col("id").isNotNull() & F.col("id").between(-FIRST_KEY, FIRST_KEY - 1)
    shared = cut(rows.filter(plain).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("shared_id")))
    own, odd = rows.filter(plain), rows.filter(~F.coalesce(plain, F.lit(False)))
    if odd.select("id").isEmpty():
        odd = odd.limit(0)  # texts are not read for it
    if not shared.isEmpty():
        same = F.col("id") == F.col("shared_id")
        own, odd = own.join(shared, same, "left_anti"), odd.unionByName(rows.filter(plain).join(shared, same, "left_semi"))
    odd = cut(odd.withColumn("key", F.monotonically_increasing_id() + FIRST_KEY))
    nodes = own.select(F.col("id").alias("doc_id"), text.alias("text")).unionByName(odd.select(F.col("key").alias("doc_id"), text.alias("text")))
    judged = near_duplicates(nodes, percent, words).select(F.col("doc_id").alias("node"), "component_id", (F.col("n_shingles") == 0).alias("blank"))
    named = judged.join(odd.select("key", F.col("id").alias("odd_id")), F.col("node") == F.col("key"), "left")
    name = F.when(F.col("key").isNull(), F.col("node")).otherwise(F.col("odd_id"))
    first = F.min(F.struct(name.isNull().alias("unnamed"), name.alias("name"), "node"))
    kept = cut(named.groupBy("component_id", "blank").agg(first.alias("first")).select(F.col("first.node").alias("node"), "blank"))
    found = odd.join(kept, F.col("key") == F.col("node"))
    alone = found.filter("blank and id is not null").dropDuplicates(["id", f"c{names.index('text')}"])
    out = own.join(kept, F.col("id") == F.col("node"), "left_semi").select(*inner.columns)
    return out.unionByName(found.filter("not blank or id is null").unionByName(alone).select(*inner.columns)).toDF(*names)
